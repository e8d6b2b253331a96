"""Bulk page extraction: tasks report what the parser sees; Spark tells chrome, measures, scores, writes and assembles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lorekeep.functions import text as X
from lorekeep.functions import urls as U
from lorekeep.functions.times import iso, safe_time
from lorekeep.operators.skew import cut, first_by
from lorekeep.sources.html import Events

# Elements and roles that hold no content, and elements that stand by themselves.
SKIP = {"script", "style", "noscript", "template", "iframe", "svg", "form", "nav", "footer", "aside", "head", "button", "select", "textarea", "canvas", "object", "embed", "dialog"}
SKIP_ROLES = {"navigation", "banner", "contentinfo", "complementary"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | {
    "#page", "html", "body", "p", "div", "section", "article", "main", "header", "figure", "figcaption", "details", "summary", "dl", "dt", "dd", "address", "fieldset", "center",
    "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "ul", "ol", "li", "pre", "blockquote", "hr",
}
# A table that holds any of these is a layout, not data.
LAYOUT = HEADINGS | {"table", "p", "div", "ul", "ol", "pre"}
RECORD = (
    "page_id long, nodes array<struct<tag:string,path:array<int>,nth:int,attr:map<string,string>>>, texts array<struct<no:int,text:string>>"
)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        seen = [Events(src or "") for src in pdf["html"]]
        nodes = [[dict(zip(("tag", "path", "nth", "attr"), n)) for n in e.nodes] for e in seen]
        yield pd.DataFrame({"page_id": pdf["page_id"], "nodes": nodes, "texts": [[{"no": n, "text": t} for n, t in e.texts] for e in seen]})


def _tag_in(tags: set[str]):
    return lambda n: n["tag"].isin(*sorted(tags))


def _above(n: Column) -> Column:
    """The elements around ``n``, from the page down."""
    return F.transform(F.slice(n["path"], 1, F.size(n["path"]) - 1), lambda p: F.get("nodes", p))


def _chrome(n: Column) -> Column:
    a = n["attr"]
    hidden = F.map_contains_key(a, "hidden") | (F.coalesce(a["aria-hidden"], F.lit("")) == "true") | F.coalesce(a["role"], F.lit("")).isin(*sorted(SKIP_ROLES))
    page_head = (n["tag"] == "header") & ~F.exists(_above(n), _tag_in({"article", "main"}))
    return _tag_in(SKIP)(n) | hidden | page_head


def _texts_in(no: Column) -> Column:
    return F.array_join(F.transform(F.filter("texts", lambda t: F.array_contains(F.get("nodes", t["no"])["path"], no)), lambda t: t["text"]), "")


def _numbers(nodes: Column, keep) -> Column:
    return F.transform(F.filter(nodes, keep), lambda n: n["no"])


def parse_pages(pages: DataFrame) -> DataFrame:
    """One record per page ``(page_id, html)``, written once because every later step reads it.

    ``nodes`` and ``texts`` are what the parser reports; whether an element is chrome, what the head says, and where
    content may be rooted follow from them.
    """
    raw = pages.select("page_id", "html").mapInPandas(_parse, RECORD)
    flagged = raw.withColumn("own", F.transform("nodes", _chrome))
    n = flagged.withColumn("nodes", F.transform("nodes", lambda n, i: F.struct(
        i.alias("no"), n["tag"].alias("tag"), n["path"].alias("path"), n["nth"].alias("nth"), n["attr"].alias("attr"),
        F.get("own", i).alias("chrome"), F.exists(n["path"], lambda p: F.get("own", p)).alias("unseen"),
    ))).drop("own")

    def meta(*names: str) -> Column:
        said = lambda n: F.trim(F.coalesce(n["attr"]["content"], F.lit("")))
        is_of = lambda n, name: (n["tag"] == "meta") & F.array_contains(F.array(*[F.coalesce(n["attr"][k], F.lit("")) for k in ("property", "name", "itemprop")]), name) & (said(n) != "")
        says = lambda name: lambda n: is_of(n, name)
        return F.coalesce(*[F.get(F.transform(F.filter("nodes", says(name)), said), F.lit(0)) for name in names])

    def first_text(tag: str) -> Column:
        all_of = F.transform(_numbers(F.col("nodes"), lambda n: n["tag"] == tag), _texts_in)
        return F.get(F.filter(all_of, lambda t: t.rlike(r"\S")), F.lit(0))

    href = lambda n: F.trim(F.coalesce(n["attr"]["href"], F.lit("")))
    canonical = F.filter("nodes", lambda n: (n["tag"] == "link") & (n["attr"]["rel"] == "canonical") & href(n).startswith("http"))
    is_main = lambda n: (_tag_in({"article", "main"})(n) | (F.coalesce(n["attr"]["role"], F.lit("")) == "main")) & ~n["chrome"]
    votes = F.filter("nodes", lambda n: ~n["unseen"] & _tag_in({"p", "li", "pre", "blockquote"})(n))
    up = lambda n, k: F.coalesce(F.get(n["path"], F.size(n["path"]) - k), F.lit(-1))
    return cut(n.select(
        "page_id", "nodes", "texts", F.coalesce(F.get(_numbers(F.col("nodes"), lambda n: n["tag"] == "body"), F.lit(0)), F.lit(0)).alias("body_no"),
        F.coalesce(meta("og:title"), first_text("title"), first_text("h1")).alias("title"), F.get(F.transform(canonical, href), F.lit(0)).alias("canonical"),
        meta("og:site_name").alias("site_name"), meta("article:published_time", "datePublished", "date").alias("published"), meta("article:modified_time", "dateModified").alias("modified"),
        F.transform(F.filter("nodes", lambda n: (n["tag"] == "time") & F.map_contains_key(n["attr"], "datetime")), lambda n: F.struct(n["path"].alias("above"), n["attr"]["datetime"].alias("at"))).alias("times"),
        _numbers(F.col("nodes"), is_main).alias("mains"),
        F.transform(votes, lambda n: F.struct(n["no"].alias("no"), up(n, 2).alias("parent"), up(n, 3).alias("grand"))).alias("paragraphs"),
    ), "pages")


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _visible(parsed: DataFrame) -> DataFrame:
    """A row for each visible text: its order, the elements around it, its block and the link and table it is in."""
    t = parsed.select("page_id", "nodes", F.posexplode("texts").alias("ord", "t")).withColumn("n", F.get("nodes", F.col("t.no"))).where(~F.col("n.unseen"))
    t = t.withColumn("around", F.transform("n.path", lambda p: F.get("nodes", p)))
    last = lambda tags: F.element_at(F.filter("around", _tag_in(tags)), -1)
    data = F.filter("around", lambda a: (a["tag"] == "table") & ~F.exists("nodes", lambda x: F.array_contains(x["path"], a["no"]) & (x["no"] != a["no"]) & _tag_in(LAYOUT)(x)))
    t = t.select("page_id", "ord", F.col("t.text").alias("text"), "around", F.try_element_at(data, F.lit(1))["no"].alias("table"), *[
        F.when(F.exists("around", _tag_in(tags)), last(tags)).alias(name) for name, tags in (("a", {"a"}), ("block", BLOCKS))
    ])
    plain = F.regexp_replace("text", r"(?U)\s", "")
    chars = F.when(last_tag_is("br") | last_tag_is("hr") | last_tag_is("img"), 0).otherwise(F.length(plain))
    return t.withColumn("chars", chars).withColumn("stretch", F.coalesce("table", F.col("block.no")))


def last_tag_is(tag: str) -> Column:
    return F.element_at("around", -1)["tag"] == tag


def blocks(parsed: DataFrame) -> DataFrame:
    """Blocks of Markdown in page order ``(page_id, ord, path, md, chars, links)``; ``path`` holds the elements around each."""
    page = W.partitionBy("page_id").orderBy("ord")
    # Texts follow one another in one block until another block comes between them.
    changes = F.coalesce((F.col("stretch") != F.lag("stretch").over(page)).cast("int"), F.lit(1))
    texts = _visible(parsed).withColumn("seg", changes).withColumn("seg", F.sum("seg").over(page))
    # The texts of a link are one piece, written with its target.
    piece = texts.groupBy("page_id", "seg", F.coalesce(F.col("a.no"), -1 - F.col("ord")).alias("unit")).agg(
        F.min("ord").alias("ord"), F.first("a").alias("a"), F.min_by(F.struct("around", "block", "table"), "ord").alias("at"), F.sum("chars").alias("chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "").alias("text"),
    )
    target = F.col("a")["attr"]["href"]
    linked = target.rlike("^https?://") & (_squeezed(F.col("text")) != "")
    piece = piece.withColumn("md", F.when(linked, F.concat(F.lit("["), _squeezed(F.col("text")), F.lit("]("), target, F.lit(")"))).otherwise(F.col("text")))
    segs = piece.groupBy("page_id", "seg").agg(
        F.min("ord").alias("ord"), F.min_by("at", "ord").alias("at"), F.sum("chars").alias("chars"), F.sum(F.when(F.col("a").isNotNull(), F.col("chars")).otherwise(0)).alias("links"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "md"))), lambda x: x["md"]), "").alias("md"),
    ).select("page_id", "seg", "ord", "at.*", "chars", "links", "md")
    tables = _tables(parsed).select("page_id", F.col("no").alias("table"), F.col("md").alias("table_md"))
    rows = segs.join(tables, ["page_id", "table"], "left")
    return _written(rows)


def _written(segs: DataFrame) -> DataFrame:
    """Every stretch of text in the form of its block: heading, list item, quote, code, table or paragraph."""
    page, nos = W.partitionBy("page_id").orderBy("ord"), F.transform("around", lambda a: a["no"])
    of = lambda tags: F.filter("around", _tag_in(tags))
    item, lists = F.try_element_at(of({"li"}), F.lit(-1)), of({"ul", "ol"})
    said = F.filter(F.transform(F.split("md", "\v"), _squeezed), lambda x: x != "")
    segs = segs.withColumns({"said": said, "item": item["no"], "list": F.try_element_at(lists, F.lit(1))["no"], "filled": (F.size(said) > 0).cast("int")})
    opens = F.sum("filled").over(W.partitionBy("page_id", "item").orderBy("ord")) == 1
    mark = F.when(F.element_at(lists, -1)["tag"] == "ol", F.concat(item["nth"].cast("string"), F.lit(". "))).otherwise("- ")
    depth = F.least(F.greatest(F.size(lists) - 1, F.lit(0)), F.lit(6))
    heading = F.try_element_at(of(HEADINGS), F.lit(-1))["tag"]
    starts = (
        F.when(heading.isNotNull(), F.concat(F.repeat(F.lit("#"), F.substring(heading, 2, 1).cast("int")), F.lit(" ")))
        .when(F.col("item").isNotNull() & opens, F.concat(F.repeat(F.lit("  "), depth), mark)).otherwise("")
    )
    quote = F.repeat(F.lit("> "), F.size(of({"blockquote"})))
    code = F.exists("around", _tag_in({"pre"}))
    lines = (
        F.when(code, F.concat(F.array(F.lit("```")), F.split(F.regexp_replace("md", r"^\n+|\n+$", ""), "\n"), F.array(F.lit("```"))))
        .otherwise(F.transform("said", lambda x, i: F.when(i == 0, F.concat(starts, x)).otherwise(x)))
    )
    body = F.array_join(F.transform(lines, lambda x: F.concat(quote, x, F.lit("\n"))), "")
    in_item = F.col("item").isNotNull() & opens & heading.isNull() & ~code
    # Items stand close together; an empty line follows a paragraph and the end of the outermost list.
    ends = F.col("list").isNotNull() & ~F.coalesce(F.lead("list").over(page).eqNullSafe(F.col("list")), F.lit(False))
    gap = F.when(~in_item | ends, "\n").otherwise("")
    md = F.when(F.col("table").isNotNull(), F.coalesce("table_md", F.lit(""))).when(~code & (F.size("said") == 0), "").otherwise(F.concat(body, gap))
    return segs.select("page_id", "ord", nos.alias("path"), md.alias("md"), "chars", "links")


def _tables(parsed: DataFrame) -> DataFrame:
    """``(page_id, no, md)`` of every data table: the cells of its rows between bars, the first row as head."""
    cells = parsed.select("page_id", "nodes", "texts", F.explode("nodes").alias("c")).where(F.col("c.tag").isin("td", "th") & ~F.col("c.unseen"))
    above = F.transform("c.path", lambda p: F.get("nodes", p))
    near = lambda tag: F.try_element_at(F.filter(above, lambda a: a["tag"] == tag), F.lit(-1))["no"]
    cells = cells.select("page_id", near("table").alias("no"), near("tr").alias("tr"), F.col("c.no").alias("cell"), F.replace(_squeezed(_texts_in(F.col("c.no"))), F.lit("|"), F.lit("\\|")).alias("t"))
    rows = cells.groupBy("page_id", "no", "tr").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "t"))), lambda x: x["t"]).alias("row")).where(F.exists("row", lambda t: t != ""))
    grids = rows.groupBy("page_id", "no").agg(F.transform(F.array_sort(F.collect_list(F.struct("tr", "row"))), lambda x: x["row"]).alias("grid"))
    width = F.array_max(F.transform("grid", F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    lines = F.transform("grid", line)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    md = F.concat(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"), F.lit("\n\n"))
    return grids.select("page_id", "no", md.alias("md"))


def node_lengths(block_rows: DataFrame) -> DataFrame:
    """Visible and link characters below every element."""
    rows = block_rows.select("page_id", F.explode("path").alias("no"), "chars", "links")
    return rows.groupBy("page_id", "no").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))


def page_lengths(parsed: DataFrame) -> DataFrame:
    """Text and link characters of every page and the share of links."""
    t = blocks(parsed).groupBy("page_id").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    return parsed.select("page_id").join(t, "page_id", "left").na.fill(0).withColumn(
        "link_density", F.when(F.col("chars") > 0, F.col("links") / F.col("chars")).otherwise(0.0)
    )


def content_roots(parsed: DataFrame) -> DataFrame:
    """``(page_id, root)``: the longest article or main element when it is long enough, else the best scored parent.

    Every paragraph of 25 characters scores its parent, and half as much its grandparent, by length and few links; the
    best one that is not mostly links wins. A page without any keeps its body.
    """
    b = blocks(parsed)
    size = node_lengths(b)
    total = parsed.select("page_id", F.col("body_no").alias("no")).join(size, ["page_id", "no"], "left").select("page_id", F.coalesce("chars", F.lit(0)).alias("body_chars"))
    mains = parsed.select("page_id", F.explode("mains").alias("no")).join(size, ["page_id", "no"], "left").na.fill(0, ["chars"])
    best = first_by(mains.select("page_id", "no", "chars"), ["page_id"], F.struct((-F.col("chars")).alias("c"), "no"))
    main = best.join(total, "page_id").where((F.col("chars") >= 500) | (F.col("chars") * 4 >= F.col("body_chars"))).select("page_id", F.col("no").alias("root"))
    rest = parsed.join(main, "page_id", "left_anti")
    p = rest.select("page_id", F.explode("paragraphs").alias("p")).select("page_id", "p.*").join(size, ["page_id", "no"])
    s = 1.0 + F.least(F.col("chars") / 100.0, F.lit(3.0)) - F.col("links") / F.col("chars")
    p = p.where(F.col("chars") >= 25).withColumn("s", s)
    votes = p.select("page_id", F.col("parent").alias("no"), "s").unionByName(p.where(F.col("grand") >= 0).select("page_id", F.col("grand").alias("no"), (F.col("s") / 2).alias("s")))
    scored = votes.groupBy("page_id", "no").agg(F.sum("s").alias("s")).join(size, ["page_id", "no"])
    scored = scored.where((F.col("chars") > 0) & (F.col("links") / F.col("chars") < 0.5))
    win = first_by(scored.select("page_id", "no", "s"), ["page_id"], F.struct((-F.col("s")).alias("s"), "no")).select("page_id", F.col("no").alias("root"))
    return parsed.select("page_id", "body_no").join(main.unionByName(win), "page_id", "left").select("page_id", F.coalesce("root", "body_no").alias("root"))


def cap_text(c: Column, limit: int | None) -> Column:
    """At most ``limit`` characters, followed by a note when the text was cut; all without a limit."""
    if limit is None:
        return c
    kept = F.rtrim(F.substring(c, 1, limit))
    return F.when(F.length(c) > limit, F.concat(kept, F.lit(f"\n\n[... text cut at {limit} characters]"))).otherwise(c)


def extract_pages(pages: DataFrame, limit: int | None = None, min_chars: int = 1) -> DataFrame:
    """Pages ``(page_id, url, html)`` to documents: outcome, title, Markdown text, dates, canonical URL, site name."""
    parsed = parse_pages(pages)
    roots = content_roots(parsed)
    inside = blocks(parsed).join(roots, "page_id").where((F.col("root") == 0) | F.array_contains("path", F.col("root")))
    md = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "md"))), lambda x: x["md"]), "")
    texts = inside.groupBy("page_id").agg(md.alias("md"))
    head = parsed.join(roots, "page_id").select(
        "page_id", X.one_line(F.col("title")).alias("title"), "canonical", "site_name", "published", "modified",
        F.try_element_at(F.transform(F.filter("times", lambda t: F.array_contains(t["above"], F.col("root"))), lambda t: t["at"]), F.lit(1)).alias("time_at"),
    )

    def linked(key: str) -> Column:
        return F.regexp_extract("html", rf'"{key}"\s*:\s*"([^"]+)"', 1)

    src = pages.select("page_id", "url", linked("datePublished").alias("_p"), linked("dateModified").alias("_m"), F.sha2(F.encode("html", "UTF-8"), 256).alias("sha256"),
                       F.octet_length("html").alias("size"))
    j = src.join(head, "page_id").join(texts, "page_id", "left").withColumn("clean", X.clean_text(F.coalesce("md", F.lit(""))))
    return j.select(
        "page_id", "url", U.canonical(F.col("url")).alias("source_id"), "title", cap_text(F.col("clean"), limit).alias("text"),
        (F.lit(False) if limit is None else F.length("clean") > limit).alias("truncated"),
        F.when(F.length(F.trim("clean")) < min_chars, "not_applicable").otherwise("extracted").alias("outcome"),
        F.coalesce(safe_time(F.col("published")), safe_time(F.col("_p")), safe_time(F.col("time_at"))).alias("created"),
        F.coalesce(safe_time(F.col("modified")), safe_time(F.col("_m"))).alias("modified"),
        "canonical", "site_name", "sha256", "size",
    )


def provenance(docs: DataFrame) -> DataFrame:
    """Adds ``metadata``: where the text came from and how it was made."""
    m = F.to_json(F.struct(
        F.col("sha256").alias("original_sha256"), F.col("size").alias("original_size"), F.lit("lorekeep/1").alias("extractor"),
        F.col("truncated").alias("text_truncated"), F.col("title").alias("doc_title"), iso(F.col("created")).alias("doc_created"),
        iso(F.col("modified")).alias("doc_modified"), F.col("site_name").alias("site_name"), F.col("canonical").alias("canonical_url"),
    ))
    return docs.withColumn("metadata", m)


def changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Change of every fetched page ``(source_id, etag, last_modified, sha256)``: unchanged by validator or by content."""
    p = previous.select("source_id", F.col("etag").alias("_e"), F.col("last_modified").alias("_m"), F.col("sha256").alias("_s"))
    validator = (F.col("etag") == F.col("_e")) | (F.col("etag").isNull() & (F.col("last_modified") == F.col("_m")))
    state = (
        F.when(F.col("_s").isNull(), "new").when(F.coalesce(validator, F.lit(False)), "unchanged")
        .when(F.col("sha256") == F.col("_s"), "unchanged").otherwise("changed")
    )
    return current.join(p, "source_id", "left").withColumn("change", state).drop("_e", "_m", "_s")


def document_fields(docs: DataFrame) -> DataFrame:
    """Title and dates of documents ``(source_id, metadata, source_created_at, source_updated_at)`` by precedence."""
    from lorekeep.functions import jsonx

    g = lambda k: jsonx.text("metadata", k)
    return docs.withColumns({
        "title": F.coalesce(g("title_override"), g("doc_title"), g("title_fallback"), F.col("source_id")),
        "created": F.coalesce(safe_time(g("date_override")), safe_time(g("source_created")), safe_time(g("doc_created")), F.col("source_created_at")),
        "updated": F.coalesce(safe_time(g("source_modified")), safe_time(g("doc_modified")), F.col("source_updated_at")),
    })

