"""Import bundles: scan, validation per line, merge into the catalog."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import jsonx
from lorekeep.functions.times import safe_time
from lorekeep.operators import upserts as U
from lorekeep.operators.skew import cut, first_by
from lorekeep.schemas import ACCOUNT_KIND_OF, IMPORT_RECORD, SOURCE_KINDS

# Media types of raw files by extension.
MEDIA_TYPES = {
    "md": "text/markdown", "jsonl": "application/x-ndjson", "json": "application/json", "html": "text/html", "htm": "text/html", "txt": "text/plain",
}


def media_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, ext), F.lit("application/octet-stream"))


def safe_path(path: Column) -> Column:
    """Relative, not empty, without parts that leave the folder."""
    return (path != "") & ~path.startswith("/") & ~path.rlike(r"(^|[/\\])\.\.?([/\\]|$)") & ~path.rlike(r"^[A-Za-z]:")


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """``entries.jsonl`` of a bundle as ``(line_id, line)``: text lines, so that a bad one can be reported as it is."""
    lines = spark.read.text(path).withColumnRenamed("value", "line").where(F.trim("line") != "")
    return lines.select(F.monotonically_increasing_id().alias("line_id"), "line")


def read_manifest(spark: SparkSession, path: str, expected: str, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """The account of each account kind from ``manifest.json``, under the caller's ``overrides``.

    A manifest of another format than ``expected``, or one that is no JSON object, is refused.
    """
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", "format string, accounts map<string,string>").alias("m")).first()
    found = row and row.m
    if not found or found.format is None:
        raise ValueError(f"{path} is no manifest")
    if found.format != expected:
        raise ValueError(f"unsupported bundle format {found.format!r}, expected {expected!r}")
    mapping = dict(found.accounts or {}) | dict(overrides or {})
    unknown = sorted(set(overrides or {}) - set(ACCOUNT_KIND_OF.values()) - {"imap"})
    if unknown:
        raise ValueError(f"no account kind {', '.join(unknown)}")
    return mapping


def account_kind() -> Column:
    known = F.create_map(*[F.lit(x) for kv in ACCOUNT_KIND_OF.items() for x in kv])
    return F.try_element_at(known, F.col("r.source_kind"))


def validate(lines: DataFrame, accounts: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Lines parsed to ``r`` with the resolved ``account_id`` and an ``error`` for those that cannot be imported."""
    p = lines.withColumn("r", F.from_json("line", IMPORT_RECORD, {"mode": "PERMISSIVE"})).withColumn("need", account_kind())
    mapped = F.lit(None).cast("string")
    for kind, account in (mapping or {}).items():
        mapped = F.when(F.col("need") == kind, account).otherwise(mapped)
    p = p.withColumn("account_id", F.coalesce(F.col("r.account"), mapped))
    # All lines of an account share its id, so a shuffled join would give them to one task. The accounts are what a user has
    # set up, a small table whatever the size of the import, and go to the lines.
    a = accounts.select(F.col("id").alias("account_id"), F.col("kind").alias("_kind"))
    p = p.join(F.broadcast(a), "account_id", "left")
    sections = F.coalesce(F.col("r.sections"), F.array())
    bad_raw = F.exists(F.coalesce("r.raw", F.array()), lambda x: ~F.coalesce(safe_path(x["path"]), F.lit(False)))
    ok_kind = (F.col("_kind") == F.col("need")) | ((F.col("need") == "imap") & (F.col("_kind") == "google"))
    error = (
        F.when(F.col("r").isNull() | ~F.coalesce(F.col("r.source_kind").isin(*SOURCE_KINDS), F.lit(False)) | F.col("r.source_id").isNull()
               | F.col("r.title").isNull(), "not a record")
        .when(F.trim("r.source_id") == "", "blank source_id").when(F.trim("r.title") == "", "blank title")
        .when(F.size(sections) == 0, "no sections")
        .when(F.col("account_id").isNull(), F.concat(F.lit("nobody reads kind "), "need"))
        .when(F.col("_kind").isNull(), F.concat(F.lit("account "), "account_id", F.lit(" is unknown")))
        .when(~ok_kind, F.concat(F.lit("account "), "account_id", F.lit(" has kind "), "_kind"))
        .when(bad_raw, "raw path leaves the bundle")
    )
    return p.withColumn("error", error).drop("_kind", "need")


def merge(valid: DataFrame, entries: DataFrame, sections: DataFrame, now: datetime) -> DataFrame:
    """What each good record does: created, updated, unchanged or merged, with the entry values to write.

    An entry with raw data is never replaced: only an earlier ``ingested_at`` and the import reference are filled in. The
    earliest ``ingested_at`` is kept. Of several records of one key the last line counts.
    """
    t = F.lit(now).cast("timestamp")
    keys = ["account_id", "source_kind", "source_id"]
    rec = valid.where(F.col("error").isNull()).select("line_id", "account_id", "r.*").drop("account")
    rec = first_by(rec, keys, F.col("line_id"), descending=True)
    rec = rec.select(
        *keys, "line_id", F.col("source_url").alias("_url"), F.col("title").alias("_title"), safe_time(F.col("source_created_at")).alias("_created"),
        safe_time(F.col("source_updated_at")).alias("_updated"), safe_time(F.col("ingested_at")).alias("_ing"), F.col("metadata").alias("_meta"),
        "sections", "summary", "raw", F.col("summary").isNotNull().alias("_sum"), F.size(F.coalesce("raw", F.array())).alias("_raw"),
    )
    want = F.array_sort(F.transform("sections", lambda s: F.concat_ws("\u0001", s["kind"], F.coalesce(s["origin"], F.lit("generated")), s["text"])))
    have = sections.groupBy(F.col("entry_id").alias("id")).agg(F.array_sort(F.collect_list(F.concat_ws("\u0001", "kind", "origin", "text"))).alias("_have"))
    # By the entry first: new records have no id yet, and a join on it would give them all to one task.
    j = rec.withColumn("_want", want).join(entries.join(have, "id", "left"), keys, "left")
    merged_meta = jsonx.overlay(F.coalesce("metadata", F.lit("{}")), F.col("_meta"))
    ref = jsonx.get("_meta", "import_ref")
    same = (F.col("title") == F.col("_title")) & (_canonical(F.col("metadata")) == _canonical(merged_meta))
    same = same & (F.col("_raw") == 0) & (F.col("_have") == F.col("_want"))
    present = F.col("raw_status") == "present"
    earlier = F.coalesce(F.col("_ing") < F.col("ingested_at"), F.lit(False))
    new_ref = ref.isNotNull() & ~ref.eqNullSafe(jsonx.get("metadata", "import_ref"))
    outcome = (
        F.when(F.col("id").isNull(), "created").when(present & (earlier | new_ref), "merged").when(present, "unchanged")
        .when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("updated")
    )
    generated = F.exists("sections", lambda s: F.coalesce(s["origin"], F.lit("generated")) == "generated")
    write = F.col("outcome").isin("created", "updated")
    out = j.withColumn("outcome", outcome).withColumn("metadata_next", merged_meta)
    return out.select(
        *keys, "line_id", "id", "outcome",
        F.when(write, F.col("_title")).otherwise(F.col("title")).alias("title"),
        F.when(write, F.coalesce("_url", "source_url")).otherwise(F.col("source_url")).alias("source_url"),
        F.when(write, F.coalesce("_created", "source_created_at")).otherwise(F.col("source_created_at")).alias("source_created_at"),
        F.when(write, F.coalesce("_updated", "source_updated_at")).otherwise(F.col("source_updated_at")).alias("source_updated_at"),
        F.when(F.col("outcome") == "unchanged", F.col("ingested_at"))
        .otherwise(F.least(F.col("ingested_at"), F.when(present, F.col("_ing")).otherwise(F.coalesce("_ing", t)))).alias("ingested_at"),
        F.when(write, F.col("metadata_next")).when((F.col("outcome") == "merged") & new_ref,
               jsonx.overlay(F.col("metadata"), F.to_json(F.struct(ref.alias("import_ref"))))).otherwise(F.col("metadata")).alias("metadata"),
        F.when(write, F.when(F.col("_sum") | generated, "done").otherwise("none")).otherwise(F.col("summary_status")).alias("summary_status"),
        F.when(write, F.col("sections")).alias("sections"), F.when(write, F.col("summary")).alias("summary"), F.when(write, F.col("raw")).alias("raw"), F.col("_ing").alias("given_ingested_at"),
    )


def apply_import(tables: dict[str, DataFrame], merged: DataFrame, files: DataFrame, now: datetime) -> dict[str, DataFrame]:
    """Next ``entries, sections, raw_objects, summaries, items`` after an import, to be published as one version.

    ``merged`` comes from ``merge``; ``files(path, sha256, size)`` are the raw files of the bundle as stored. Created and
    updated entries get the imported sections (the higher origin wins a kind, then the later one), raw rows where the
    record has some, their hash and status, and a summary row where the record brings a summary or generated sections;
    their items go. Merged entries change in their times and reference only.
    """
    t = F.lit(now).cast("timestamp")
    keys = ["account_id", "source_kind", "source_id"]
    m = cut(merged, "import-merged")
    fresh = U.new_ids(tables["entries"], m.where(F.col("id").isNull()).select(*keys), keys).withColumnRenamed("id", "_new")
    w = cut(m.join(fresh, keys, "left").withColumn("entry_id", F.coalesce("id", "_new")).drop("id", "_new"), "import-rows")
    written = w.where(F.col("outcome").isin("created", "updated"))
    ids = written.select("entry_id")

    imported = written.select("entry_id", F.posexplode("sections").alias("version", "s")).select(
        "entry_id", "version", "s.kind", F.coalesce("s.origin", F.lit("generated")).alias("origin"), "s.text")
    sections = tables["sections"].join(ids, "entry_id", "left_anti")
    for origin in ("user", "extracted", "generated"):
        sections = U.write_sections(sections, imported.where(F.col("origin") == origin).drop("origin"), origin, replace=False)

    given = written.select("entry_id", "account_id", F.posexplode("raw").alias("pos", "o")).select("entry_id", "account_id", "pos", "o.*")
    raw = given.groupBy("entry_id", "account_id", "role").agg(F.array_sort(F.collect_list(F.struct("pos", "path", "media_type"))).alias("objects"))
    raw = raw.select("entry_id", "account_id", "role", F.posexplode("objects").alias("seq", "o")).select(
        "entry_id", "account_id", "role", F.col("seq").cast("long").alias("seq"), "o.path", F.coalesce("o.media_type", media_type(F.col("o.path"))).alias("media_type"))
    raw = cut(raw.join(files, "path").withColumn("fetched_at", t), "import-raw")
    own = raw.select("entry_id").distinct()
    kept = tables["raw_objects"].join(own, "entry_id", "left_anti")
    raw_objects = kept.unionByName(raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in kept.columns]))
    hashes = U.raw_hashes(raw).select("entry_id", F.col("raw_hash").alias("_hash"))

    done = written.where(F.col("summary_status") == "done")
    g = F.col("summary")
    summary = {
        "generator_kind": F.coalesce(g["generator_kind"], F.lit("unknown")), "provider": F.coalesce(g["provider"], F.lit("unknown")),
        "model": F.coalesce(g["model"], F.lit("unknown")), "input_hash": F.lit("import"), "entry_id": F.col("entry_id"),
        "prompt_version": F.when(~F.coalesce(g["generator_kind"] == "source_native", F.lit(False)), g["prompt_version"]),
        "generated_at": F.coalesce(safe_time(g["generated_at"]), F.col("given_ingested_at"), t),
    }
    old = tables["summaries"].join(ids, "entry_id", "left_anti")
    summaries = old.unionByName(done.select(*[summary.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in old.schema]))
    items = tables["items"].join(ids, "entry_id", "left_anti")

    values = ["title", "source_url", "source_created_at", "source_updated_at", "ingested_at", "metadata", "summary_status"]
    rows = w.where(F.col("outcome") != "unchanged").select(*keys, F.col("entry_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in values], (F.col("outcome") == "created").alias("_made"))
    e = tables["entries"].join(rows, keys, "full_outer").join(hashes.select(F.col("entry_id").alias("_id"), "_hash"), "_id", "left")
    hit = F.col("_id").isNotNull()
    out = {"id": F.coalesce("id", "_id"), **{c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in values}}
    out |= {"updated_at": F.when(hit, t).otherwise(F.col("updated_at")) if "updated_at" in e.columns else None}
    out |= {"raw_status": F.when(F.col("_hash").isNotNull(), "present").otherwise(F.coalesce("raw_status", F.lit("missing"))), "raw_hash": F.coalesce("_hash", "raw_hash") if "raw_hash" in e.columns else None}
    out |= {"origin": F.when(F.coalesce("_made", F.lit(False)), "import").otherwise(F.col("origin")) if "origin" in e.columns else None}
    out |= {"entry_uid": F.coalesce("entry_uid", U.entry_uid()) if "entry_uid" in e.columns else None}
    entries = e.select(*[out[c].alias(c) if out.get(c) is not None else F.col(c) for c in tables["entries"].columns])
    return {"entries": entries, "sections": sections, "raw_objects": raw_objects, "summaries": summaries, "items": items}


def _canonical(c: Column) -> Column:
    """JSON object text with its top-level keys in order."""
    from pyspark.sql import types as T

    m = F.from_json(c, T.MapType(T.StringType(), T.VariantType()))
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.to_json(e["value"])))), "\u0001")


def report(validated: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """Counters of an import: outcomes of good lines and the number of invalid ones."""
    bad = validated.where(F.col("error").isNotNull()).agg(F.count(F.lit(1)).alias("count")).select(F.lit("invalid").alias("outcome"), "count")
    good = validated.where(F.col("error").isNull()).select(F.lit("valid").alias("outcome")) if merged is None else merged.select("outcome")
    return good.groupBy("outcome").agg(F.count(F.lit(1)).alias("count")).unionByName(bad)


def bad_lines(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("error").isNotNull()).select("line_id", "error")
