"""Mixing sources to target weights by entropy balancing (operator 3).

The size of a document is its number of words. Every source has a target for the words taken from it. Among all rates
that meet the targets and exceed no cap, the ones nearest to "every document once" in relative entropy are
``min(cap, exp(lambda_source * size / scale_source))``; the multipliers solve the convex dual, one constraint per
source. Documents are folded to a histogram over (source, size) first, and each Newton step is one aggregation over
it, kept inside a bracket. Rates then become whole copies: along growing size the fractions are summed up, and a
cell gives as many extra copies as whole numbers lie in its stretch, so errors of neighbours cancel out.

Defined results: a null text has size 0 and any document of size 0 the rate 1; a null source is a source of its own
and comes last; rows that agree in everything are told apart by an arbitrary rank, which no value shows; an empty
input gives no rows. All columns of the input are carried in one struct, so none of their names can clash.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lorekeep.llm.common import WORD, table
from lorekeep.operators.skew import cut, global_prefix_sum

CAP = 3
ONE = 1 << 20  # fractions of a copy are whole numbers of 1 / ONE, so that sums don't depend on their order
SPREAD = 4096  # parts of a cell of one source and size
EXACT = "decimal(38,6)"


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_key(source: Column) -> Column:
    """Orders by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame, cap: int = CAP, cycle: int = 3) -> DataFrame:
    """(src, source_size, target) from (src, source_size): weights 1..cycle repeat along the sources."""
    ranked = global_prefix_sum(sizes, [F.substring("src", 1, 2), F.substring("src", 1, 4)], [F.col("src")], F.lit(1), "rank")
    big = lambda c: c.cast("decimal(38,0)")
    rows = cut(ranked.select("src", "source_size", (1 + (F.col("rank") - 1) % cycle).cast("long").alias("w")), "mix-sources")
    size, w = F.col("source_size"), F.col("w")
    total, weight = rows.agg(F.sum(big(size)), F.sum(w)).first()
    rest, open_w = int(total or 0), int(weight or 0)
    while True:
        # At the cap: the share of what the others leave is more than the source may give.
        full = big(cap * size) * big(F.lit(open_w)) < big(F.lit(str(rest))) * big(w)
        taken, gone = rows.where(full).agg(F.sum(big(cap * size)), F.sum(w)).first()
        left = (int(total or 0) - int(taken or 0), int(weight or 0) - int(gone or 0))
        if left == (rest, open_w) or left[1] == 0:
            break
        rest, open_w = left
    share = (big(F.lit(str(rest))) * big(w)).cast("double") / F.lit(float(max(open_w, 1)))
    return rows.select("src", "source_size", F.when(full, (cap * size).cast("double")).otherwise(share).alias("target"))


def multipliers(hist: DataFrame, goals: DataFrame, cap: int = CAP, steps: int = 80, tol: float = 1e-7) -> DataFrame:
    """(src, scale, lam) that solve the dual; ``hist`` has (src, size, n) and ``goals`` the targets."""
    size, n = F.col("size").cast("double"), F.col("n").cast("double")
    shape = hist.where("size > 0").groupBy("src").agg(
        (F.sum((size * size * n).cast(EXACT)) / F.sum((size * n).cast(EXACT))).cast("double").alias("scale"), F.min("size").alias("least")
    )
    least = F.col("least") / F.col("scale")
    state = goals.join(shape, "src").select(
        "src", "scale", "target", F.lit(0.0).alias("lam"),
        (F.log(F.col("target") / F.col("source_size")) / least - 1).alias("lo"), (F.log(F.lit(float(cap))) / least).alias("hi"),
        (F.col("target") >= cap * F.col("source_size")).alias("full"),
    )
    state = cut(state.withColumn("lam", F.when(F.col("full"), F.col("hi")).otherwise(F.col("lam"))).withColumn("done", F.col("full")), "mix-dual")
    x = F.col("size") / F.col("scale")
    rate = F.least(F.exp(F.least(F.col("lam") * x, F.lit(60.0))), F.lit(float(cap)))
    grows = F.when(rate < cap, size * n * x * rate).otherwise(0.0)
    for _ in range(steps):
        if state.where("not done").limit(1).count() == 0:
            break
        at = hist.where("size > 0").join(state.where("not done"), "src").groupBy("src", "scale", "target", "lam", "lo", "hi", "full").agg(
            F.sum((size * n * rate).cast(EXACT)).cast("double").alias("got"), F.sum(grows.cast(EXACT)).cast("double").alias("slope")
        )
        lo = F.when(F.col("got") <= F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("got") >= F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        # Newton for log(got) = log(target), halved into the bracket where it leaves it.
        newton = F.col("lam") + F.col("got") * F.log(F.col("target") / F.col("got")) / F.when(F.col("slope") > 0, F.col("slope"))
        near = F.abs(F.col("got") - F.col("target")) <= tol * F.col("target")
        moved = at.withColumns({"lo": lo, "hi": hi, "_n": newton}).select(
            "src", "scale", "target",
            F.when(near, F.col("lam")).when((F.col("_n") > F.col("lo")) & (F.col("_n") < F.col("hi")), F.col("_n")).otherwise((F.col("lo") + F.col("hi")) / 2).alias("lam"),
            "lo", "hi", "full", (near | (F.col("hi") - F.col("lo") < 1e-12 * F.abs(F.col("hi")))).alias("done"),
        )
        state = cut(state.where("done").unionByName(moved), "mix-dual")
    return state.select("src", "scale", "lam", "full")


def mix(docs: DataFrame, id_col="doc_id", source_col="source", text_col="text", cap: int = CAP) -> DataFrame:
    """(row, size, source_size, target, copies): ``row`` holds the columns of ``docs``."""
    return _mix(docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("src"), words(F.col(text_col)).alias("size")), cap)


def _mix(rows: DataFrame, cap: int) -> DataFrame:
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SPREAD)))
    cells = cut(rows.groupBy("src", "size", "part").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    hist = cells.groupBy("src", "size").agg(F.sum("n").alias("n"))
    goals = cut(targets(hist.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), cap), "mix-targets")
    lam = multipliers(cut(hist, "mix-hist"), goals, cap)
    rate = F.when(F.col("full"), F.lit(float(cap))).otherwise(
        F.least(F.exp(F.least(F.coalesce(F.col("lam") * F.col("size") / F.col("scale"), F.lit(0.0)), F.lit(60.0))), F.lit(float(cap)))
    )
    rated = cells.join(lam, "src", "left").withColumn("whole", F.when(F.col("size") == 0, 1).otherwise(F.floor(rate)).cast("long"))
    rated = rated.withColumn("part_of_copy", F.when(F.col("size") == 0, 0).otherwise(F.round((rate - F.col("whole")) * ONE)).cast("long") * F.col("n"))
    extra = _settled(cut(_extra(rated.select("src", "size", "part", "n", "whole", "part_of_copy")), "mix-extra"), goals, cap)
    rank = F.row_number().over(W.partitionBy("src", "size", "part").orderBy(F.xxhash64("id", F.lit("rank")), "id"))
    picked = rows.withColumn("rank", rank).join(extra, ["src", "size", "part"])
    out = picked.withColumn("copies", F.col("whole") + (F.col("rank") <= F.col("extra")).cast("long"))
    return out.join(goals, "src").select("row", "size", "source_size", "target", "copies")


def _extra(cells: DataFrame) -> DataFrame:
    """Extra copies of each cell: the whole numbers that its stretch of the running sum of fractions holds."""
    # Nested stretches along the size: a power of 2^(1/8), then the size, then the part; each is summed by itself.
    coarse = F.floor(F.log2(F.col("size") + F.lit(1)) * 8)
    cells = cells.withColumn("bin", coarse)
    sizes = cells.groupBy("src", "bin", "size").agg(F.sum("part_of_copy").alias("v"))
    bins = sizes.groupBy("src", "bin").agg(F.sum("v").alias("v"))
    before = lambda keys, by: F.coalesce(F.sum("v").over(W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select("src", "bin", before(["src"], "bin").alias("b0"))
    sizes = sizes.select("src", "bin", "size", before(["src", "bin"], "size").alias("b1"))
    parts = cells.withColumnRenamed("part_of_copy", "v").withColumn("b2", before(["src", "size"], "part"))
    start = F.col("b0") + F.col("b1") + F.col("b2") + F.lit(ONE // 2)
    up = F.floor((start + F.col("v")) / ONE) - F.floor(start / ONE)
    return parts.join(sizes.drop("bin"), ["src", "size"]).join(bins, ["src", "bin"]).select("src", "size", "part", "n", "whole", up.cast("long").alias("extra"))


def _settled(cells: DataFrame, goals: DataFrame, cap: int) -> DataFrame:
    """``cells`` with single copies added or taken back until what a source misses is less than its small documents.

    One cell for each eighth of a power of two of the size offers copies, so the list of a source has a bounded length.
    """
    got = cells.groupBy("src").agg(F.sum(F.col("size") * (F.col("n") * F.col("whole") + F.col("extra"))).alias("got"))
    miss = goals.join(got, "src").select("src", F.round(F.col("target") - F.col("got")).cast("long").alias("miss"))
    room = F.when(F.col("whole") < cap, F.col("n") - F.col("extra")).otherwise(0)
    bins = cells.where("size > 0").groupBy("src", F.floor(F.log2(F.col("size") + F.lit(1)) * 8).alias("bin")).agg(
        *[F.max(F.struct(v.cast("long").alias("most"), "size", "part")).alias(c) for c, v in (("add", room), ("back", F.col("extra")))]
    )
    lists = bins.join(miss, "src").groupBy("src", "miss").agg(
        F.sort_array(F.collect_list(F.when(F.col("miss") > 0, F.col("add")).otherwise(F.col("back")).alias("c"))).alias("c")
    )
    lists = lists.withColumn("c", F.reverse(F.array_sort(F.transform("c", lambda c: F.struct(c["size"].alias("size"), c["part"].alias("part"), c["most"].alias("most"))))))
    none = F.array().cast("array<struct<size:bigint,part:bigint,k:bigint>>")

    def step(acc, c):
        k = F.least(c["most"], F.floor(acc["left"] / c["size"]).cast("long"))
        one = F.struct(c["size"].alias("size"), c["part"].cast("long").alias("part"), k.alias("k"))
        return F.struct((acc["left"] - k * c["size"]).alias("left"), F.when(k > 0, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.abs("miss").alias("left"), none.alias("out"))
    moves = lists.select("src", F.signum("miss").cast("long").alias("sign"), F.explode(F.aggregate("c", start, step)["out"]).alias("m"))
    moves = moves.select("src", F.col("m.size").alias("size"), F.col("m.part").alias("part"), (F.col("sign") * F.col("m.k")).alias("move"))
    return cells.join(moves, ["src", "size", "part"], "left").select("src", "size", "part", "whole", (F.col("extra") + F.coalesce("move", F.lit(0))).alias("extra"))


def repeated(docs: DataFrame, **names) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it has copies."""
    out = mix(docs, **names)
    times = out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return times.select("row.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes from each row of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select(
        F.struct("doc_id").alias("row"), F.col("doc_id").alias("id"), source_key(F.col("source")).alias("src"), words(F.col("text")).alias("size")
    )
    out = _mix(narrow, CAP)
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
