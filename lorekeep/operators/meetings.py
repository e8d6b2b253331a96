"""Calendar events, meeting notes and listed drive items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lorekeep.functions import jsonx
from lorekeep.functions.times import safe_time

DOC_MIME = "application/vnd.google-apps.document"
EVENT = (
    "struct<status:string,summary:string,start:struct<dateTime:string,date:string>,recurringEventId:string,htmlLink:string,"
    "attendees:array<struct<email:string,displayName:string,self:boolean,responseStatus:string,resource:boolean>>,"
    "attachments:array<struct<mimeType:string,fileId:string,fileUrl:string>>>"
)
# Headings of the notes and what they become.
HEADINGS = {
    "overview": ("概要", "Summary"),
    "decisions": ("決定事項", "Decisions"),
    "action_items": ("次のステップ", "推奨される次のステップ", "Suggested next steps", "Next steps"),
    "details": ("詳細", "Details"),
}
SURVEY = ("これらのメモ", "How did we do", "How is the quality")
_TRANSCRIPT = r"^\s*#\s+(?:\*\*)?\s*(?:📖|🎞)"
_AUTO_TITLE = r"に開始した会議|^会議\s*[0-9０-９]{4}\s*年|^Meeting started|^Meeting\s+[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}"
_TRAILING_DATE = r"\s*[-–—]?\s*[0-9０-９]{4}\s*[/／年.\-][0-9０-９]{1,2}.*$"
_RECURRING = r"(?i)\s*\((?:recurring|定期)\)\s*$"


def calendar_work(events: DataFrame) -> DataFrame:
    """Events as JSON ``(event_id, event)`` to one row per attached document, with the people who did not decline."""
    e = events.select("event_id", F.from_json("event", EVENT).alias("e"))
    people = F.coalesce("e.attendees", F.array().cast("array<struct<email:string,displayName:string,self:boolean,responseStatus:string,resource:boolean>>"))
    gone = F.exists(people, lambda a: F.coalesce(a["self"], F.lit(False)) & F.coalesce(a["responseStatus"] == "declined", F.lit(False)))
    kept = F.filter(people, lambda a: ~F.coalesce(a["responseStatus"] == "declined", F.lit(False)) & ~F.coalesce(a["resource"], F.lit(False)))
    named = F.transform(kept, lambda a: F.named_struct(
        F.lit("name"), F.coalesce(a["displayName"], a["email"], F.lit("")), F.lit("email"), a["email"],
        F.lit("self"), F.coalesce(a["self"], F.lit(False)),
    ))
    on = e.where(~F.coalesce(F.col("e.status") == "cancelled", F.lit(False)) & ~gone)
    rows = on.select("event_id", "e", named.alias("attendees"), F.explode("e.attachments").alias("att"))
    by_url = F.nullif(F.regexp_extract("att.fileUrl", r"/d/([A-Za-z0-9_-]+)", 1), F.lit(""))
    return rows.where(F.col("att.mimeType") == DOC_MIME).select(
        "event_id", F.coalesce("att.fileId", by_url).alias("source_id"), F.col("e.summary").alias("event_title"),
        F.coalesce("e.start.dateTime", "e.start.date").alias("event_start"), F.col("e.recurringEventId").alias("recurring_event_id"),
        F.col("e.recurringEventId").isNotNull().alias("recurring"), F.col("e.htmlLink").alias("event_url"), "attendees",
    ).where(F.col("source_id").isNotNull())


def clean_notes(c: Column) -> Column:
    """Anchors and escapes removed, blank runs cut, ends trimmed."""
    t = F.regexp_replace(c, r"\[(\d{1,2}:\d{2}(?::\d{2})?)\]\(#[^)]*\)", "$1")
    t = F.regexp_replace(t, r"\\([\[\]\-_*#.()!+])", "$1")
    t = F.regexp_replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+\z", "")


def is_auto_title(title: Column) -> Column:
    return F.trim(title).rlike(_AUTO_TITLE)


def strip_trailing_date(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(name), _TRAILING_DATE, ""))


def strip_recurring(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, _RECURRING, ""))


def notes_lines(notes: DataFrame) -> DataFrame:
    """``(source_id, markdown)`` as classified lines of the notes part and of the embedded transcript."""
    lines = notes.select("source_id", F.posexplode(F.split(F.replace("markdown", F.lit("\r\n"), F.lit("\n")), "\n")).alias("i", "l"))
    head = F.regexp_extract("l", r"^\s*(#+) (.*)$", 1)
    label = F.trim(F.regexp_replace(F.trim(F.regexp_extract("l", r"^\s*(#+) (.*)$", 2)), r"^\*+|\*+$", ""))
    label = F.trim(F.regexp_replace(label, r"\\([\[\]\-_*#.()!+])", "$1"))
    kind = F.lit(None).cast("string")
    for k, names in HEADINGS.items():
        kind = F.when((head != "") & label.isin(*names), k).otherwise(kind)
    w = W.partitionBy("source_id").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = lines.select("source_id", "i", "l", F.length(head).alias("level"), label.alias("label"), kind.alias("kind"))
    t = t.withColumn("in_transcript", F.max(F.col("l").rlike(_TRANSCRIPT)).over(w))
    starts = F.col("kind").isNotNull() | (F.col("level") == 1)
    t = t.withColumn("block", F.sum(F.when(~F.col("in_transcript") & starts, 1).otherwise(0)).over(w))
    return t.withColumn("known", F.max(F.when(~F.col("in_transcript"), F.col("kind").isNotNull()).otherwise(False)).over(w))


def _joined(lines: str = "l") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col(lines).alias("l")))), lambda x: x["l"]), "\n")


def parse_notes(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Meeting notes to documents and sections; documents without a known heading are left out.

    Lines of one document are ordered inside its own text, so a group is never larger than one stored document.
    """
    t = notes_lines(notes)
    survey = F.lit(False)
    bare = F.regexp_replace(F.trim("l"), r"^[*_ ]+", "")
    for s in SURVEY:
        survey = survey | bare.startswith(s)
    body = t.where(~F.col("in_transcript") & (F.col("block") > 0))
    kinds = body.groupBy("source_id", "block").agg(F.max_by("kind", F.when(F.col("kind").isNotNull(), -F.col("i"))).alias("section"))
    inside = body.where(F.col("kind").isNull() & ~survey).withColumn("l", F.regexp_replace("l", r"^## ", "### "))
    texts = inside.groupBy("source_id", "block").agg(clean_notes(_joined()).alias("text")).where(F.col("text") != "")
    sec = texts.join(kinds.where(F.col("section").isNotNull()), ["source_id", "block"])
    sections = sec.groupBy("source_id", F.col("section").alias("kind")).agg(F.min_by("text", "block").alias("text")).withColumn("origin", F.lit("generated"))
    header = t.where(~F.col("known") & ~F.col("in_transcript"))
    invited = F.contains("l", F.lit("招待済み")) | F.ltrim("l").startswith("Invited")
    is_title = (F.col("level") == 2)
    link = F.regexp_extract_all("l", F.lit(r"\((https?://[^)\s]+)\)"), F.lit(1))
    head = header.groupBy("source_id").agg(
        F.min_by(F.when(is_title, F.col("label")), F.when(is_title, F.col("i"))).alias("raw_title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(invited, F.struct("i", "l")))), lambda x: x["l"]), "\n").alias("inv"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(~is_title & ~invited, F.struct("i", link.alias("u"))))), lambda x: x["u"])).alias("urls"),
    )
    rest = t.groupBy("source_id").agg(
        F.max("known").alias("is_notes"),
        clean_notes(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("in_transcript"), F.struct("i", "l")))), lambda x: x["l"]), "\n")).alias("notes_text"),
        clean_notes(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("in_transcript") & ~F.col("l").rlike(_TRANSCRIPT), F.struct("i", "l")))), lambda x: x["l"]), "\n")).alias("transcript"),
    )
    parts = F.split("inv", "~~")
    mail = r"\[([^\]]+)\]\(mailto:([^)\s]+)\)"

    def people(odd: int) -> Column:
        picked = F.filter(F.transform(parts, lambda p, i: F.when(i % 2 == odd, p)), lambda p: p.isNotNull())
        return F.flatten(F.transform(picked, lambda p: F.arrays_zip(
            F.transform(F.regexp_extract_all(p, F.lit(mail), F.lit(1)), clean_notes).alias("name"),
            F.regexp_extract_all(p, F.lit(mail), F.lit(2)).alias("email"),
        )))

    none = F.array().cast("array<string>")
    urls = F.coalesce("urls", none)
    title = strip_recurring(F.trim(F.regexp_replace(clean_notes(F.col("raw_title")), r"^\*+|\*+$", "")))
    docs = rest.where("is_notes").join(head, "source_id", "left").select(
        "source_id", title.alias("title"), F.coalesce(is_auto_title(title), F.lit(True)).alias("title_is_auto"),
        F.coalesce(title != F.trim("raw_title"), F.lit(False)).alias("recurring_in_title"),
        people(0).alias("participants"), people(1).alias("absentees"),
        F.try_element_at(F.filter(urls, lambda u: F.contains(u, F.lit("calendar.google.com"))), F.lit(1)).alias("calendar_url"),
        F.try_element_at(F.filter(urls, lambda u: F.contains(u, F.lit("docs.google.com")) & ~F.contains(u, F.lit("calendar.google.com"))), F.lit(1)).alias("transcript_url"),
        "notes_text", F.nullif("transcript", F.lit("")).alias("transcript"),
    )
    return docs, sections.join(docs.select("source_id"), "source_id", "left_semi")


def resolve_meeting(docs: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Title, recurrence and times of a meeting from its notes and the metadata of the event or folder."""
    m = F.col(metadata)
    folder = jsonx.text(m, "folder_name")
    best = F.when(F.col("title").isNotNull() & ~F.col("title_is_auto"), F.col("title")).otherwise(
        F.coalesce(jsonx.text(m, "event_title"), F.nullif(strip_trailing_date(folder), F.lit("")), F.col("title"), F.lit("Meeting"))
    )
    final = strip_recurring(best)
    recurring = (
        F.coalesce(jsonx.get(m, "recurring") == "true", F.lit(False)) | F.col("recurring_in_title") | (final != F.trim(best))
        | F.coalesce(F.contains(F.lower(folder), F.lit("(recurring)")), F.lit(False))
    )
    return docs.withColumns({
        "meeting_title": final, "recurring": recurring,
        "created": F.coalesce(safe_time(jsonx.text(m, "event_start")), safe_time(jsonx.text(m, "created_time"))),
        "updated": safe_time(jsonx.text(m, "modified_time")),
    })


def classify_drive_items(items: DataFrame, unsupported_ext: Sequence[str]) -> DataFrame:
    """Listed drive items ``(item)`` as JSON to ``(outcome, reason, drive_id, item_id, name)``; a remote item is followed."""
    base = F.coalesce(F.get_json_object("item", "$.remoteItem"), F.col("item"))

    def has(key: str) -> Column:
        return F.get_json_object("item", f"$.{key}").isNotNull() | F.get_json_object(base, f"$.{key}").isNotNull()

    item_id, drive = F.get_json_object(base, "$.id"), F.get_json_object(base, "$.parentReference.driveId")
    name = F.coalesce(F.get_json_object(base, "$.name"), F.lit(""))
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    reason = (
        F.when(has("deleted"), "deleted at its source").when(has("folder"), "a folder, not a file")
        .when(has("package"), "a package, not a file").when(item_id.isNull() | drive.isNull(), "drive or item number missing")
        .when(ext.isin(*unsupported_ext), F.concat(F.lit("no reader for ."), ext))
    )
    outcome = F.when(reason.isin("deleted at its source", "drive or item number missing"), "not_found").when(reason.isNotNull(), "not_applicable").otherwise("file")
    return items.select("*", outcome.alias("outcome"), reason.alias("reason"), drive.alias("drive_id"), item_id.alias("item_id"), name.alias("name"))


def export_plan(mime: Column) -> Column:
    """How a listed file is read: exported, downloaded, or unsupported."""
    # Media types that are exported or read as they are.
    exported = (DOC_MIME, "application/vnd.google-apps.spreadsheet", "application/vnd.google-apps.presentation")
    direct = (
        "application/pdf", "application/json", "application/vnd.ms-excel", "application/vnd.oasis.opendocument.spreadsheet",
        "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
        "application/vnd.openxmlformats-officedocument.presentationml.presentation",
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    )
    return (
        F.when(mime.isin(*exported), "export").when(mime.startswith("application/vnd.google-apps."), "unsupported")
        .when(mime.isin(*direct) | mime.startswith("text/"), "download").otherwise("unsupported")
    )
