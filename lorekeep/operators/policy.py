"""When an entry is summarized: thresholds, the decision after a change, and re-summarization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.schemas import DEFAULTS, Settings


def below_thresholds(settings: Settings = DEFAULTS) -> Column:
    """Too little to summarize: ``body``, ``message_count``, ``prompt``, ``source_kind``.

    A conversation needs enough messages and characters, a document enough characters, anything else some text.
    """
    need = F.lit(settings.summary_min_chars)
    for kind, n in settings.min_chars_by_kind.items():
        need = F.when(F.col("source_kind") == kind, n).otherwise(need)
    short = F.length("body") < need
    return (
        F.when(F.col("message_count").isNotNull(), (F.col("message_count") < settings.summary_min_messages) | short)
        .when(F.col("prompt") == "document", short)
        .otherwise(F.trim("body") == "")
    )


def decide(inputs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds ``decision`` and ``new_hash`` to changed entries.

    Columns: ``body`` (null without an input), ``message_count, prompt, source_kind``, ``profile`` and ``profile_usable``,
    ``has_native``, and of the stored entry ``summary_status``, ``generator_kind``, ``input_hash`` (null without a record).
    Model and prompt changes never make a summary stale; only the body does.
    """
    done = F.coalesce(F.col("summary_status") == "done", F.lit(False))
    native = F.when(F.col("has_native"), "native").otherwise("none")
    body = F.coalesce("body", F.lit(""))
    i = inputs.withColumn("_hash", X.body_hash(body))
    stored, record = F.col("input_hash"), F.col("generator_kind").isNotNull()
    usable = F.coalesce("profile_usable", F.lit(False))
    kept = (
        F.when(~record, "pending").when(F.col("generator_kind") == "source_native", "pending").when(stored == "", "adopt")
        .when(stored == F.col("_hash"), "keep").when(~stored.startswith("b2:"), "keep").otherwise("pending")
    )
    decision = (
        F.when(F.col("body").isNull() | (F.col("profile") == "native"), native)
        .when(below_thresholds(settings), "skipped")
        .when(usable & done, kept).when(usable, "pending").when(done, "keep").otherwise("pending")
    )
    i = i.withColumn("decision", decision)
    new_hash = F.when(F.col("decision") == "native", X.native_hash(F.lit("native"), F.lit(""), body)).when(F.col("decision") == "adopt", F.col("_hash"))
    return i.withColumn("new_hash", new_hash).drop("_hash")


def resummarize(entries: DataFrame, summaries: DataFrame, inputs: DataFrame, profile: str, force: bool = False) -> DataFrame:
    """Entries with their ``state``: no_raw, already_current or selected.

    ``inputs(entry_id, body, prompt_version)`` are the rebuilt inputs with the prompt version in force.
    """
    s = summaries.select("entry_id", F.col("profile").alias("_p"), F.col("prompt_version").alias("_v"), F.col("input_hash").alias("_h"))
    n = inputs.select("entry_id", "prompt_version", X.body_hash(F.col("body")).alias("_body_hash"))
    j = entries.select(F.col("id").alias("entry_id"), "raw_status").join(s, "entry_id", "left").join(n, "entry_id", "left")
    same = (F.col("_p") == profile) & (F.col("_v") == F.col("prompt_version")) & (F.col("_h") == F.col("_body_hash"))
    state = F.when(F.col("raw_status") != "present", "no_raw").when(F.coalesce(same, F.lit(False)) & ~F.lit(force), "already_current").otherwise("selected")
    return j.select("entry_id", state.alias("state"))


def upgrade_hashes(summaries: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Old input hashes replaced from the rebuilt input: ``(entry_id, input_hash, outcome)`` of the summaries concerned.

    ``rebuilt(entry_id, body, failed)``: a row that failed is left for the next run; without a body the hash is unknown.
    """
    old = summaries.where(
        (F.col("generator_kind") != "source_native") & (F.col("input_hash") != "") & ~F.col("input_hash").startswith("b2:")
    )
    j = old.join(rebuilt, "entry_id", "left")
    outcome = F.when(F.coalesce("failed", F.lit(False)), "deferred").when(F.col("body").isNull(), "unknown").otherwise("upgraded")
    new = F.when(outcome == "deferred", F.col("input_hash")).when(outcome == "unknown", F.lit("")).otherwise(X.body_hash(F.coalesce("body", F.lit(""))))
    return j.select("entry_id", new.alias("input_hash"), outcome.alias("outcome"))
