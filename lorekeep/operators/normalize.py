"""Normalization per source kind: a registry of DataFrame transforms, and re-extraction from stored raw data.

A transform takes the stored segments as rows, ``(entry_id, seq, payload, title, metadata)``, and returns
``(entry_id, kind, origin, text)``. Chats are parsed and rendered line by line; only the text of a section is one value.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.operators import meetings as G
from lorekeep.operators import messages as M
from lorekeep.operators import policy as Y
from lorekeep.operators.skew import cut, joined_text
from lorekeep.operators.upserts import write_sections
from lorekeep.schemas import DEFAULTS, Settings
from lorekeep.sources import pages as W

Normalizer = Callable[[DataFrame], DataFrame]
SECTION_COLUMNS = ["entry_id", "kind", "origin", "text"]


def _extracted(texts: DataFrame) -> DataFrame:
    """``(entry_id, text)`` as extracted details; blank texts give none."""
    return texts.where(F.trim("text") != "").select("entry_id", F.lit("details").alias("kind"), F.lit("extracted").alias("origin"), "text")


def plain(segments: DataFrame) -> DataFrame:
    """Documents and files: the cleaned text is the details."""
    return _extracted(joined_text(segments, ["entry_id"], ["seq"], "payload").select("entry_id", X.clean_text(F.col("text")).alias("text")))


def conversation(labels: DataFrame, tz: str) -> Normalizer:
    """Chats stored as JSON lines: one stamped line per message, in the order of the messages."""

    def run(segments: DataFrame) -> DataFrame:
        lines = segments.select(F.col("entry_id").cast("string").alias("source_id"), "seq", F.posexplode(F.split("payload", "\n")).alias("line_no", "line"))
        spoken = M.with_speaker(M.render_bodies(M.parse_messages(lines), labels), labels)
        text = M.conversation_text(M.conversation_lines(spoken, tz))
        return _extracted(text.select(F.col("source_id").cast("long").alias("entry_id"), "text"))

    return run


def notes(segments: DataFrame) -> DataFrame:
    """Meeting notes: the sections under their headings and the transcript; notes without a known heading are plain text."""
    texts = cut(joined_text(segments, ["entry_id"], ["seq"], "payload").select(F.col("entry_id").alias("source_id"), F.col("text").alias("markdown")), "notes")
    docs, sections = G.parse_notes(texts)
    said = docs.where(F.col("transcript").isNotNull()).select(F.col("source_id").alias("entry_id"), F.col("transcript").alias("text"))
    other = texts.join(docs.select("source_id"), "source_id", "left_anti").select(F.col("source_id").alias("entry_id"), X.clean_text(F.col("markdown")).alias("text"))
    # Under one kind the transcript, as extracted text, goes before generated details.
    told = sections.join(said.select(F.col("entry_id").alias("source_id"), F.lit("details").alias("kind")), ["source_id", "kind"], "left_anti")
    return told.select(F.col("source_id").alias("entry_id"), "kind", "origin", "text").unionByName(_extracted(said.unionByName(other)))


def page(segments: DataFrame) -> DataFrame:
    """Web pages: the Markdown of the main content."""
    html = joined_text(segments, ["entry_id"], ["seq"], "payload")
    found = W.extract_pages(cut(html.select(F.col("entry_id").alias("page_id"), F.lit("").alias("url"), F.col("text").alias("html")), "page-html"))
    return _extracted(found.where(F.col("outcome") == "extracted").select(F.col("page_id").alias("entry_id"), "text"))


def normalizers(labels: DataFrame, tz: str) -> dict[str, Normalizer]:
    """The transform of every source kind; ``labels(user_id, label)`` names the people of chats."""
    chat = conversation(labels, tz)
    return {"slack.thread": chat, "slack.day": chat, "google.meet": notes, "google.doc": plain, "microsoft.file": plain, "web.page": page, "local.file": plain}


def normalize(segments: DataFrame, registry: Mapping[str, Normalizer]) -> DataFrame:
    """Applies the transform of every kind; kinds with the same transform go through it together."""
    by_fn: dict[Normalizer, list[str]] = {}
    for kind, fn in registry.items():
        by_fn.setdefault(fn, []).append(kind)
    out = None
    for fn, kinds in by_fn.items():
        part = fn(segments.where(F.col("source_kind").isin(*kinds))).select(*SECTION_COLUMNS)
        out = part if out is None else out.unionByName(part)
    return out


def reextract(entries: DataFrame, raw: DataFrame, registry: Mapping[str, Normalizer]) -> DataFrame:
    """Sections recomputed from the primary raw segments of the given entries that have raw data."""
    ids = entries.where(F.col("raw_status") == "present").select(F.col("id").alias("entry_id"), "source_kind", "title", "metadata")
    segments = raw.where(F.col("role") == "primary").join(ids, "entry_id").select("entry_id", "source_kind", "seq", "payload", "title", "metadata")
    return normalize(segments, registry)


def reextract_tables(tables: Mapping[str, DataFrame], chosen: DataFrame, registry: Mapping[str, Normalizer], now: datetime, settings: Settings = DEFAULTS) -> dict[str, DataFrame]:
    """Next ``entries`` and ``sections`` after re-extraction of ``chosen`` entries, with what their summaries need now.

    Extracted sections, and generated ones that come from the source itself, are replaced by origin. The decision of the
    summary policy on the new text becomes the summary status: an unchanged text keeps its summary.
    """
    found = cut(reextract(chosen, tables["raw_objects"], registry), "reextracted")
    sections = tables["sections"]
    for origin in ("generated", "extracted"):
        drafts = found.where(F.col("origin") == origin).withColumn("version", F.lit(0))
        sections = write_sections(sections, drafts.select("entry_id", "kind", "text", "version"), origin, replace=True)
    body = found.where((F.col("kind") == "details") & (F.col("origin") == "extracted")).select("entry_id", F.col("text").alias("body"))
    native = found.where(F.col("origin") == "generated").select("entry_id").distinct().withColumn("has_native", F.lit(True))
    done = found.select("entry_id").distinct()
    s = tables["summaries"].select("entry_id", "generator_kind", "input_hash")
    e = tables["entries"].join(done.select(F.col("entry_id").alias("id")), "id", "left_semi").select(F.col("id").alias("entry_id"), "source_kind", "summary_status")
    inputs = e.join(body, "entry_id", "left").join(native, "entry_id", "left").join(s, "entry_id", "left").select(
        "*", F.lit(None).cast("long").alias("message_count"), F.lit("document").alias("prompt"), F.lit("default").alias("profile"), F.lit(True).alias("profile_usable"))
    verdict = Y.decide(inputs.withColumn("has_native", F.coalesce("has_native", F.lit(False))), settings).select(F.col("entry_id").alias("id"), "decision")
    status = F.when(F.col("decision").isin("keep", "adopt"), F.col("summary_status")).when(F.col("decision") == "native", "done").otherwise(F.col("decision"))
    j = tables["entries"].join(verdict, "id", "left")
    hit = F.col("decision").isNotNull()
    new = {"summary_status": status, "updated_at": F.lit(now).cast("timestamp")}
    entries = j.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in tables["entries"].columns])
    return {"entries": entries, "sections": sections}
