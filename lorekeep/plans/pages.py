"""Page extraction and document fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.functions.times import iso, safe_date, safe_time
from lorekeep.plans import query
from lorekeep.sources import pages as G

_LETTERS = r"regexp_replace({}, '[^\p{{L}}]', '', 'g')"
_ENTITIES = "replace(replace(replace(replace(replace({}, '&quot;', chr(34)), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_ARTICLE = _ENTITIES.format(r"regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', '', 'g')")


@query(
    "s7_page_extraction",
    f"""SELECT page_id, trim(regexp_replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '\\s+', ' ', 'g')) AS title, 'extracted' AS outcome,
  sha256({_LETTERS.format(_ARTICLE)}) AS letters_hash FROM pages""",
)
def extraction(v):
    """Title and main text of every page (the text is compared by its letters)."""
    d = G.extract_pages(v.table("pages"))
    return d.select("page_id", "title", "outcome", F.sha2(F.encode(F.regexp_replace("text", r"[^\p{L}]", ""), "UTF-8"), 256).alias("letters_hash"))


_OPENING = "AnOpeningParagraphThatIsLongEnoughToBeCountedAsContentByItself"


@query("x3_scored_pages", f"SELECT page_id, sha256('{_OPENING}' || {_LETTERS.format(_ARTICLE)}) AS letters_hash FROM pages")
def scored(v):
    """Pages without an article element and with blocks of links around, so that paragraph scoring picks the content."""
    links = "<div><p><a href='http://l'>" + "links and more links of a block " * 3 + "</a></p><p><a href='http://m'>" + "other links " * 5 + "</a></p></div>"
    html = F.replace("html", F.lit("<article>"), F.lit(f"{links}<div><p>{_OPENING}</p>"))
    pages = v.table("pages").withColumn("html", F.replace(html, F.lit("</article>"), F.lit("</div>" + links)))
    text = F.regexp_replace("text", r"[^\p{L}]", "")
    return G.extract_pages(pages).select("page_id", F.sha2(F.encode(text, "UTF-8"), 256).alias("letters_hash"))


@query(
    "x6_page_lengths",
    "SELECT page_id, length(regexp_replace(" + _ENTITIES.format(
        r"regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', '', 'g'), '(?s)<(head|nav|footer)>.*?</(head|nav|footer)>|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"
    ) + r", '\s', '', 'g')) AS chars FROM pages",
)
def lengths(v):
    """Visible characters per page."""
    return G.page_lengths(G.parse_pages(v.table("pages"))).select("page_id", "chars")


@query(
    "x8_page_provenance",
    r"""SELECT page_id, sha256(encode(html)) AS sha, CAST(octet_length(encode(html)) AS VARCHAR) AS size, trim(regexp_replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '\s+', ' ', 'g')) AS doc_title, 'false' AS truncated FROM pages""",
)
def provenance(v):
    """Hash, size, title and cut flag of the original."""
    d = G.provenance(G.extract_pages(v.table("pages")))
    g = lambda k: F.get_json_object("metadata", f"$.{k}")
    return d.select("page_id", g("original_sha256").alias("sha"), g("original_size").alias("size"), g("doc_title").alias("doc_title"), g("text_truncated").alias("truncated"))


@query(
    "x9_page_changes",
    "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'unchanged' WHEN 2 THEN 'unchanged' WHEN 3 THEN 'unchanged' ELSE 'changed' END AS change FROM pages",
)
def changes(v):
    """New, changed or unchanged by etag, modification time or content hash."""
    i = F.col("page_id")
    cur = v.table("pages").select(
        i, F.concat(F.lit("p"), i.cast("string")).alias("source_id"), F.when(i % 5 == 1, "e1").when(i % 5 == 3, "e2").alias("etag"),
        F.when(i % 5 == 2, "Mon").alias("last_modified"), F.sha2(F.encode("html", "UTF-8"), 256).alias("sha256"))
    prev = cur.where(i % 5 != 0).select("source_id", F.when(i % 5 == 3, "other").otherwise(F.col("etag")).alias("etag"), "last_modified",
                                        F.when(i % 5 == 3, F.col("sha256")).otherwise("old").alias("sha256"))
    return G.changes(prev, cur).select("page_id", "change")


@query(
    "c25_clean_text",
    r"""SELECT doc_id, sha256(encode(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g'))) AS clean_hash FROM documents""",
)
def clean(v):
    """Line ends, control characters, trailing blanks and blank runs (whole documents, compared by hash)."""
    messy = F.concat(F.lit("﻿"), F.replace("text", F.lit("\n"), F.lit(" \r\n")), F.lit("\n\n\u0007\n"))
    return v.table("documents").select("doc_id", F.sha2(F.encode(X.clean_text(messy), "UTF-8"), 256).alias("clean_hash"))


@query(
    "c32_safe_dates",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT00:00:00Z') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 3 THEN strftime(ts - INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%SZ') END AS at_time,
  CASE WHEN event_id % 5 = 1 THEN strftime(ts, '%Y-%m-%d') END AS at_date FROM events""",
)
def dates(v):
    """RFC 3339, local times, leading dates, and text that is no date."""
    i = F.col("event_id")
    raw = (
        F.when(i % 5 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i % 5 == 1, F.date_format("ts", "yyyy-MM-dd"))
        .when(i % 5 == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(i % 5 == 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+09:00'")).otherwise("2024-13-45")
    )
    e = v.events.select("event_id", raw.alias("raw"))
    return e.select("event_id", iso(safe_time(F.col("raw"))).alias("at_time"), safe_date(F.col("raw")).cast("string").alias("at_date"))


@query(
    "c35_document_fields",
    """SELECT id, CASE id % 4 WHEN 0 THEN 'O' || id WHEN 1 THEN 'D' || id WHEN 2 THEN 'F' || id ELSE source_id END AS title, CASE WHEN id % 2 = 0 THEN '2022-03-04T00:00:00Z' ELSE strftime(source_created_at, '%Y-%m-%dT%H:%M:%SZ') END AS created FROM entries""",
    ("entries",),
)
def fields(v):
    """Title and date precedence of documents."""
    i = F.col("id").cast("string")
    n = F.col("id") % 4
    meta = F.to_json(F.struct(
        F.when(n == 0, F.concat(F.lit("O"), i)).when(n == 1, " ").alias("title_override"), F.when(n <= 1, F.concat(F.lit("D"), i)).alias("doc_title"),
        F.when(n <= 2, F.concat(F.lit("F"), i)).alias("title_fallback"), F.when(n == 0, "2022-03-04").alias("date_override"),
        F.when(n == 2, "2022-03-04T00:00:00Z").alias("source_created"),
    ))
    d = G.document_fields(v.entries.withColumn("metadata", meta))
    return d.select("id", "title", iso(F.col("created")).alias("created"))
