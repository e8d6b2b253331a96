"""Secret scan with linking of multipart credentials (operator 9).

Three base patterns are reported wherever they match. Weak candidates (long mixed tokens, account names, endpoints)
mean nothing alone; a candidate is kept only if its complementary parts lie in one of its scopes: a token needs an
identifier, a name needs a secret, an endpoint needs both. Scopes are the ``reach`` code points around it, the lines up to
the next blank ones (two lines at least) and the outermost closed pair of brackets of each shape. Everything is a SQL
expression: the positions of matches come from the texts between them. The join of near parts meets on (row, stretch of the
text), so a row with very many parts is split over its stretches; blocks compare a candidate with the first and last parts.

Defined results: a null text counts as empty; rows equal in id and text get equal spans; positions are code points,
ends exclusive; an empty input gives no rows; only the id and the text column are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import table
from lorekeep.operators.skew import cut

# Fixed values of the task: the base patterns and the least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
# Weak candidates.
# A token is parts between dots of which the last is long, or one long part with its padding; a word before '=' is none.
TOKEN = (
    r"(?<![A-Za-z0-9+/_.-])(?:[A-Za-z0-9_-]++\.(?=[A-Za-z0-9_-]))++[A-Za-z0-9_-]{20,}+(?![+/=]|\.[A-Za-z0-9_-])"
    r"|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+(?:=++(?![A-Za-z0-9+/_-]))?(?!=)"
)
NAME = r"""(?i)(?<!secret)(?<!secret[_-])(client_?id|access_?key(?:_?id)?|account|user_?(?:name|id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{6,})"""
ENDPOINT = r"(?:https?|wss?|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9.-]+(?::[0-9]+)?"
KINDS = ("assign", "access", "hex", "token", "name", "endpoint")
REACH = 200
# Line ends, with the blank lines after them, and brackets.
BREAK = r"\n[\x20\t\r\n]*|[{}()\[\]]"
SHAPES = ("{}", "[]", "()")
SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


def _spans(text: Column, pattern: str, kind: str, present: Column, keep=None, group: int = 0) -> Column:
    """All matches as (start, rank of the kind, end), where ``keep`` holds for the text of ``group``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), value.alias("value"))
    rank = F.lit(KINDS.index(kind))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["gap"])
        end = start + F.length(m["hit"])
        one = F.array(F.struct(start.alias("start"), rank.alias("rank"), end.alias("end")))
        out = F.concat(acc["out"], one) if keep is None else F.when(keep(m["value"]), F.concat(acc["out"], one)).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    none = F.array().cast(SPAN)
    zipped = zipped.cast("array<struct<gap:string,hit:string,value:string>>")
    return F.when(present, F.aggregate(zipped, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")), step)["out"]).otherwise(none)


def _mixed(v: Column) -> Column:
    return v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")


def scan(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, h1, h2, base, weak, breaks): every base match, the weak candidates, and where these have company what bounds blocks."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = F.array_sort(
        F.concat(
            _spans(text, ASSIGN, "assign", text.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"), lambda v: F.length(v) >= 12, 2),
            _spans(text, ACCESS, "access", text.contains("AKIA"), lambda v: F.length(v) >= 18),
            _spans(text, HEX, "hex", text.rlike("[0-9a-f]{16}")),
        )
    )
    token = _spans(text, TOKEN, "token", text.rlike("[A-Za-z0-9+/_.-]{32}"), lambda v: _mixed(v) & (F.length(v) >= 32))
    name = _spans(text, NAME, "name", text.rlike(r"(?i)(?:client_?id|access_?key|account|user_?(?:name|id))"))
    endpoint = _spans(text, ENDPOINT, "endpoint", text.contains("://"))
    found = F.regexp_extract_all(text, F.lit(BREAK), F.lit(0))
    gaps = F.slice(F.split(text, BREAK, -1), F.lit(1), F.size(found))
    breaks = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), lambda m: F.struct(F.length(m["gap"]).alias("gap"), m["hit"].alias("hit")))
    keys = [F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64("text", F.lit("row"), "doc_id").alias("h2")]
    spans = rows.select("doc_id", "text", *keys, base.alias("base"), token.alias("token"), name.alias("name"), endpoint.alias("endpoint"))
    # The value of a name is an identifier, however long and mixed.
    value = F.filter("token", lambda t: ~F.exists("name", lambda n: (n["start"] < t["end"]) & (t["start"] < n["end"])))
    spans = spans.select("doc_id", "text", "h1", "h2", "base", F.concat(value, "name", "endpoint").alias("weak"))
    return spans.select("doc_id", "h1", "h2", "base", "weak", F.when(_company(), breaks).alias("breaks"))


def _company() -> Column:
    return (F.size("weak") > 0) & (F.size("base") + F.size("weak") > 1)


def _inside(spans: DataFrame, grow: int, reach: int) -> DataFrame:
    """A row for each stretch of ``reach`` code points that a span touches once grown by ``grow`` on both sides."""
    first, last = F.floor((F.col("start") - grow) / reach), F.floor((F.col("end") + grow) / reach)
    return spans.withColumn("cell", F.explode(F.sequence(first, last)))


def _blocks(some: DataFrame) -> DataFrame:
    """(h1, h2, shape, start, end): paragraphs of two lines or more, and the outermost closed pairs of each shape of brackets; one shape never overlaps itself."""
    over = lambda *k, by: Window.partitionBy("h1", "h2", *k).orderBy(by)
    marks = some.select("h1", "h2", F.posexplode("breaks").alias("k", "m")).select("h1", "h2", "k", "m.*")
    marks = marks.withColumn("till", F.sum(F.col("gap") + F.length("hit")).over(over(by="k"))).withColumn("at", F.col("till") - F.length("hit"))
    blank = F.length(F.regexp_replace("hit", "[^\n]", "")) > 1
    lines = marks.where(F.col("hit").startswith("\n")).withColumn("blank", blank)
    lines = lines.withColumn("no", F.sum(F.col("blank").cast("int")).over(over(by="k"))).groupBy("h1", "h2", "no").agg(
        F.coalesce(F.max(F.when(F.col("blank"), F.col("till"))), F.lit(0)).alias("start"), F.max(~F.col("blank")).alias("many"))
    # A paragraph ends where the next one starts; one of a single line holds nothing.
    lines = lines.select("h1", "h2", F.lit("lines").alias("shape"), "start", F.when(F.col("many"), F.lit(2**62)).otherwise(F.col("start")).alias("end"))
    shape = F.coalesce(*[F.when(F.lit(s).contains(F.col("hit")), s) for s in SHAPES])
    sign = F.when(F.lit("([{").contains(F.col("hit")), 1).otherwise(-1)
    pairs = marks.where(~F.col("hit").startswith("\n")).select("h1", "h2", "k", "at", shape.alias("shape"), sign.alias("sign"))
    up, down = over("shape", by="k"), over("shape", by=F.col("k").desc())
    before = Window.unboundedPreceding, -1
    pairs = pairs.withColumn("depth", F.sum("sign").over(up))
    pairs = pairs.withColumn("low", F.least(F.min("depth").over(up.rowsBetween(*before)), F.lit(0))).withColumn("later", F.min("depth").over(down.rowsBetween(*before)))
    closed = F.when(F.col("sign") > 0, F.col("later") < F.col("depth")).otherwise(F.col("depth") >= F.col("low"))
    pairs = pairs.where(closed).withColumn("depth", F.sum("sign").over(up)).where(F.col("depth") == (F.col("sign") > 0).cast("int"))
    pairs = pairs.withColumn("end", F.lead("at").over(up)).where("sign > 0").select("h1", "h2", "shape", F.col("at").alias("start"), "end")
    return lines.unionByName(pairs)


def _in_blocks(some: DataFrame, spans: DataFrame) -> DataFrame:
    """(h1, h2, start, rank, end, has_id, has_secret) of the weak ``spans`` in each block that holds them."""
    events = spans.withColumn("shape", F.explode(F.array(*[F.lit(s) for s in ("lines", *SHAPES)]))).unionByName(_blocks(some), allowMissingColumns=True)
    block = F.when(F.col("rank").isNull(), F.struct("start", "end"))
    held = events.withColumn("block", F.last(block, ignorenulls=True).over(Window.partitionBy("h1", "h2", "shape").orderBy("start", F.col("rank").asc_nulls_first())))
    held = held.where(F.col("rank").isNotNull() & (F.col("start") < F.col("block.end")))
    # Some part lies apart from a span if the one that ends first or the one that starts last does.
    whole = Window.partitionBy("h1", "h2", "shape", "block.start")
    apart = lambda part: (F.min(F.when(F.col("part") == part, F.col("end"))).over(whole) <= F.col("start")) | (F.max(F.when(F.col("part") == part, F.col("start"))).over(whole) >= F.col("end"))
    held = held.withColumn("has_id", F.coalesce(apart("id"), F.lit(False))).withColumn("has_secret", F.coalesce(apart("secret"), F.lit(False)))
    return held.where("weak").select("h1", "h2", "start", "rank", "end", "has_id", "has_secret")


def linked(scanned: DataFrame, reach: int = REACH) -> DataFrame:
    """(h1, h2, start, rank, end) of the weak candidates whose complementary parts are in one of their scopes."""
    some = scanned.where(_company()).select("h1", "h2", "base", "weak", "breaks").dropDuplicates(["h1", "h2"])
    weak = some.select("h1", "h2", F.explode("weak").alias("s")).select("h1", "h2", "s.*")
    both = F.concat(F.transform("base", lambda s: F.struct(s.alias("s"), F.lit(False).alias("weak"))), F.transform("weak", lambda s: F.struct(s.alias("s"), F.lit(True).alias("weak"))))
    every = some.select("h1", "h2", F.explode(both).alias("e")).select("h1", "h2", "e.s.*", "e.weak")
    rank = F.col("rank")
    kinds = lambda *k: rank.isin(*[KINDS.index(x) for x in k])
    every = every.withColumn("part", F.when(kinds("access", "name"), "id").when(kinds("endpoint"), "place").otherwise("secret"))
    parts = every.where("part <> 'place'").select("h1", "h2", F.col("start").alias("ps"), F.col("end").alias("pe"), "part")
    probes = _inside(weak, reach, reach)
    spread = _inside(parts.withColumnsRenamed({"ps": "start", "pe": "end"}), 0, reach).withColumnsRenamed({"start": "ps", "end": "pe"})
    gap = F.greatest(F.col("ps") - F.col("end"), F.col("start") - F.col("pe"))
    # A part is no complement of itself or of a span that it overlaps.
    near = probes.join(spread, ["h1", "h2", "cell"]).where((gap >= 0) & (gap <= reach))
    near = near.select("h1", "h2", "start", "rank", "end", (F.col("part") == "id").alias("has_id"), (F.col("part") == "secret").alias("has_secret"))
    seen = near.unionByName(_in_blocks(some, every)).groupBy("h1", "h2", "start", "rank", "end").agg(F.max("has_id").alias("has_id"), F.max("has_secret").alias("has_secret"))
    needs = F.when(kinds("token"), F.col("has_id")).when(kinds("name"), F.col("has_secret")).otherwise(F.col("has_id") & F.col("has_secret"))
    return seen.where(needs).select("h1", "h2", "start", "rank", "end")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def secrets(docs: DataFrame, id_col="doc_id", text_col="text", reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, base and all spans as sorted arrays."""
    scanned = cut(scan(docs, id_col, text_col), "secret-scan")
    more = linked(scanned, reach).groupBy("h1", "h2").agg(F.collect_list(F.struct("start", "rank", "end")).alias("more"))
    out = scanned.join(more, ["h1", "h2"], "left")
    # Of a weak span inside a base span nothing new is learnt.
    fresh = F.filter(F.coalesce("more", F.array().cast(SPAN)), lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    return out.select("doc_id", "base", F.array_sort(F.concat("base", fresh)).alias("spans"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every row of ``documents``."""
    found = secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in ("assign", "access", "hex")],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )
