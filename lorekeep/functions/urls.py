"""URL columns: extraction, classification, canonical form, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WRAPPED = r"<(https?://[^|>\s]+)(?:\|[^>]*)?>"
BARE = r"https?://[^\s<>|]+"
# Query parameters that only track the visitor.
TRACKING = r"(?i)^(utm_.*|fbclid|gclid|mc_cid|mc_eid)$"


def unescape(c: Column) -> Column:
    t = F.replace(c, F.lit("&lt;"), F.lit("<"))
    t = F.replace(t, F.lit("&gt;"), F.lit(">"))
    return F.replace(t, F.lit("&amp;"), F.lit("&"))


def text_urls(text: Column) -> Column:
    """URLs of a message text in order: wrapped ones first, then bare ones, without duplicates."""
    wrapped = F.regexp_extract_all(text, F.lit(WRAPPED), F.lit(1))
    bare = F.regexp_extract_all(F.regexp_replace(text, WRAPPED, " "), F.lit(BARE), F.lit(0))
    bare = F.transform(bare, lambda u: F.regexp_replace(u, r"[.,;:!?)\]}'\"]+$", ""))
    return F.array_distinct(F.transform(F.concat(wrapped, bare), unescape))


def message_urls(text: Column, block_links: Column, attachments: Column) -> Column:
    """``text_urls`` followed by block links and attachment fields, first position kept."""
    fields = F.flatten(
        F.transform(
            F.coalesce(attachments, F.array().cast("array<struct<title_link:string,from_url:string,original_url:string>>")),
            lambda a: F.array_compact(F.array(a["title_link"], a["from_url"], a["original_url"])),
        )
    )
    blocks = F.coalesce(block_links, F.array().cast("array<string>"))
    return F.array_distinct(
        F.concat(F.coalesce(text_urls(text), F.array().cast("array<string>")), F.transform(F.concat(blocks, fields), unescape))
    )


def host_of(url: Column) -> Column:
    """Lower-case host of an http(s) URL, without credentials and port."""
    return F.nullif(_raw_host(url), F.lit(""))


def _raw_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^\s*[Hh][Tt][Tt][Pp][Ss]?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^\s*[A-Za-z]+://[^/?#]*([^?#]*)", 1)


def query_param(url: Column, name: str) -> Column:
    """First value of a query parameter; null when absent."""
    v = F.regexp_extract(F.regexp_replace(url, r"#.*$", ""), r"[?&]" + name + r"=([^&#]*)", 1)
    return F.nullif(v, F.lit(""))


def is_microsoft_host(host: Column) -> Column:
    return host.rlike(r"\.sharepoint\.com$|^onedrive\.live\.com$|^1drv\.ms$")


def _is_google(host: Column) -> Column:
    return host.isin("docs.google.com", "drive.google.com")


def is_document_host(url: Column) -> Column:
    return _raw_host(url).rlike(r"^(?:docs|drive)\.google\.com$|\.sharepoint\.com$|^onedrive\.live\.com$|^1drv\.ms$")


# The forms of a drive file link, over host and path (published pages excluded), or host, path and query.
_FILE = r"^(?:docs|drive)\.google\.com/(?:document|spreadsheets|presentation|file)/(?:u/[^/]+/)?d/(?!e(?:/|$))([A-Za-z0-9_-]+)(?:/|$)"
_OPENED = r"^drive\.google\.com/(?:open|uc)(?:/[^?]*)?\?(?:[^#]*&)?id=([A-Za-z0-9_-]+)(?:&|$)"
_PARTS = r"(?is)^\s*(https?)://(?:[^/?#@]*@)?([^/?#:]+)((?::\d+)?)([^?#]*)(\??[^#]*).*$"


def with_document_link(df: DataFrame, url: str) -> DataFrame:
    """Rows whose URL is a document link, with ``link_kind, link_key, link_url, link_host`` added.

    A drive file is keyed by its id (folders and published pages have none), a shared file by the hash of its URL.
    The URL is taken apart once, into an array.
    """
    sep = "\u0001"
    parts = F.split(F.regexp_replace(F.trim(url), _PARTS, sep.join(f"${i}" for i in range(1, 6))), sep)
    u = df.where(is_document_host(F.col(url))).withColumn("_p", parts)
    host = F.lower(F.get("_p", F.lit(1)))
    path = F.regexp_replace(F.regexp_replace(F.get("_p", F.lit(3)), r"/+", "/"), r"^/a/[^/]+/(?=.)", "/")
    u = u.withColumn("link_host", host).withColumn("_path", path)
    u = u.withColumn("_id", F.concat(
        F.regexp_extract(F.concat("link_host", "_path"), _FILE, 1),
        F.regexp_extract(F.concat("link_host", "_path", F.get("_p", F.lit(4))), _OPENED, 1),
    ))
    raw = F.get("_p", F.lit(3))
    clean = F.concat(F.lower(F.get("_p", F.lit(0))), F.lit("://"), "link_host", F.get("_p", F.lit(2)),
                     F.when(raw == "", F.lit("/")).otherwise(raw), F.get("_p", F.lit(4)))
    kind = F.when(F.col("_id") != "", "google.doc").when(is_microsoft_host(F.col("link_host")), "microsoft.file")
    u = u.withColumn("link_kind", kind).withColumn("link_url", clean)
    key = F.when(F.col("link_kind") == "google.doc", F.concat(F.lit("google:"), "_id")).otherwise(
        F.concat(F.lit("ms:"), F.sha2(F.encode("link_url", "UTF-8"), 256)))
    return u.withColumn("link_key", key).where(F.col("link_kind").isNotNull()).drop("_p", "_path", "_id")


def canonical(url: Column) -> Column:
    """Identity of a page: lower host, no fragment, credentials, default port or tracking parameters."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z]+)://", 1))
    host = host_of(u)
    port = F.regexp_extract(u, r"^[A-Za-z]+://(?:[^/?#@]*@)?[^/?#:]+:(\d+)", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    path = path_of(u)
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.filter(
        F.split(query, "&"), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).rlike(TRACKING)
    )
    kept = F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    return F.when(
        scheme.isin("http", "https") & host.isNotNull(),
        F.concat(
            scheme, F.lit("://"), host, F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)),
            F.when(path == "", F.lit("/")).otherwise(path),
            F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")),
        ),
    )


def route(locator: Column) -> Column:
    """``struct(route, detail)``: google, microsoft, web, local or rejected with the reason."""
    s = F.trim(locator)
    scheme = F.lower(F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = F.coalesce(host_of(s), F.lit(""))
    path = path_of(s)
    by_path = F.regexp_extract(path, r"/(?:document|spreadsheets|presentation|file)/(?:u/\d+/)?d/([A-Za-z0-9_-]+)", 1)
    file_id = F.when(F.contains(path, F.lit("/d/e/")), F.lit(None)).otherwise(
        F.coalesce(F.nullif(by_path, F.lit("")), F.when(path.isin("/open", "/uc"), query_param(s, "id")))
    )

    def out(kind: str, detail: Column) -> Column:
        return F.struct(F.lit(kind).alias("route"), detail.cast("string").alias("detail"))

    google = _is_google(host)
    return (
        F.when(s == "", out("rejected", F.lit("empty locator")))
        .when((scheme == "") | (F.length(scheme) == 1), out("local", s))
        .when(scheme == "file", out("local", F.regexp_replace(s, r"^file://(?:localhost)?", "")))
        .when(~scheme.isin("http", "https"), out("rejected", F.concat(F.lit("unsupported scheme "), scheme)))
        .when(google & F.contains(path, F.lit("/folders/")), out("rejected", F.lit("a folder, not a file")))
        .when(google & file_id.isNotNull(), out("google", file_id))
        .when(is_microsoft_host(host), out("microsoft", s))
        .when(host.endswith(".slack.com") & path.startswith("/archives"), out("rejected", F.lit("conversations are synced")))
        .otherwise(out("web", s))
    )
