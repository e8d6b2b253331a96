"""Usage ledger: spend, periods, budget admission, token and cost estimates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions import text as X
from lorekeep.functions.times import local_date, local_midnight, next_start, period, period_start
from lorekeep.operators.skew import cut, global_prefix_sum
from lorekeep.schemas import DEFAULTS, Settings

EPS = 1e-9


def spend_columns() -> list[Column]:
    """Spend of a group: unknown costs count as calls without a price, an empty group as zeros."""
    zero = F.lit(0)
    return [
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        F.coalesce(F.sum("calls"), zero).alias("calls"),
        F.coalesce(F.sum(F.when(F.col("cost_usd").isNull(), F.col("calls")).otherwise(0)), zero).alias("unpriced_calls"),
        F.coalesce(F.sum("input_tokens"), zero).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), zero).alias("output_tokens"),
    ]


SPEND = ["cost_usd", "calls", "unpriced_calls", "input_tokens", "output_tokens"]


def spend_between(ledger: DataFrame, since: datetime, until: datetime) -> DataFrame:
    return ledger.where((F.col("at") >= F.lit(since)) & (F.col("at") < F.lit(until))).agg(*spend_columns())


def spend_total(ledger: DataFrame) -> DataFrame:
    return ledger.agg(*spend_columns(), F.min("at").alias("since"))


def spend_by_model(ledger: DataFrame) -> DataFrame:
    """Per model and provider, largest first, groups without any known cost last."""
    g = ledger.groupBy("model", "provider").agg(*spend_columns(), F.sum("cost_usd").alias("_known"))
    return g.orderBy(F.col("_known").isNull(), F.col("_known").desc(), F.col("calls").desc(), "model", "provider").drop("_known")


def spend_by_period(ledger: DataFrame, kinds: Sequence[str], tz: str) -> DataFrame:
    """Spend per accounting period. Rows are folded to local days once; weeks and months sum the days."""
    day = ledger.groupBy(local_date(F.col("at"), tz).alias("day")).agg(*spend_columns())
    out = None
    for kind in kinds:
        start = F.to_date(F.date_trunc(kind, "day"))
        g = day.groupBy(start.alias("period_start")).agg(*[F.sum(c).alias(c) for c in SPEND])
        g = g.select(
            F.lit(kind).alias("kind"), "period_start", local_midnight(F.col("period_start"), tz).alias("starts_at"),
            local_midnight(next_start(kind, F.col("period_start")), tz).alias("ends_at"), *SPEND,
        )
        out = g if out is None else out.unionByName(g)
    return out


def periods_of(ledger: DataFrame, kinds: Sequence[str], tz: str) -> DataFrame:
    """The periods that hold ledger rows: ``kind, period_start, starts_at, ends_at``."""
    days = ledger.select(local_date(F.col("at"), tz).alias("day")).distinct()
    noon = F.to_utc_timestamp(F.col("day").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(12)), tz)
    rows = days.select(F.explode(F.array(*[period(k, noon, tz) for k in kinds])).alias("p"))
    return rows.select("p.*").distinct()


def spend_in_periods(ledger: DataFrame, periods: DataFrame) -> DataFrame:
    """Spend inside stored half-open bounds ``(kind, period_start, starts_at, ends_at)``, whatever their time zone was.

    A range join by UTC day: every period becomes one row per day it touches, so rows meet by equality.
    """
    keys = ["kind", "period_start", "starts_at", "ends_at"]
    last = F.to_date(F.col("ends_at") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(1)))
    days = periods.select(*keys, F.explode(F.sequence(F.to_date("starts_at"), last)).alias("day"))
    rows = ledger.withColumn("day", F.to_date("at")).join(days, "day")
    inside = rows.where((F.col("at") >= F.col("starts_at")) & (F.col("at") < F.col("ends_at")))
    return inside.groupBy("kind", "period_start").agg(*spend_columns())


def period_report(ledger: DataFrame, periods: DataFrame) -> DataFrame:
    """Stored periods ``(…, cap_usd, stopped_at)`` with their spend and the share of the cap that is used."""
    s = spend_in_periods(ledger, periods.select("kind", "period_start", "starts_at", "ends_at"))
    j = periods.join(s, ["kind", "period_start"], "left").na.fill(0, SPEND)
    used = F.when(F.col("cap_usd") > 0, F.col("cost_usd") / F.col("cap_usd") * 100)
    reached = F.coalesce(F.col("cost_usd") >= F.col("cap_usd"), F.lit(False))
    return j.withColumns({"used_percent": used, "cap_reached": reached, "resets_at": F.col("ends_at")})


def upsert_periods(current: DataFrame, seen: DataFrame, now: datetime) -> DataFrame:
    """Bounds are written once; a changed cap is taken over with its time."""
    keys = ["kind", "period_start"]
    n = seen.select(*keys, F.col("starts_at").alias("_s"), F.col("ends_at").alias("_e"), F.col("cap_usd").alias("_cap"), F.lit(True).alias("_new"))
    j = current.withColumn("_old", F.lit(True)).join(n, keys, "full_outer")
    changed = F.col("_new").isNotNull() & (F.col("_old").isNull() | ~F.col("cap_usd").eqNullSafe(F.col("_cap")))
    return j.select(
        *keys, F.coalesce("starts_at", "_s").alias("starts_at"), F.coalesce("ends_at", "_e").alias("ends_at"),
        F.when(F.col("_new").isNotNull(), F.col("_cap")).otherwise(F.col("cap_usd")).alias("cap_usd"),
        F.when(changed, F.lit(now).cast("timestamp")).otherwise(F.col("cap_updated_at")).alias("cap_updated_at"), "stopped_at",
    )


def mark_stopped(periods: DataFrame, kind: str, start: Column, now: datetime) -> DataFrame:
    """Notes the first stop of a period."""
    hit = (F.col("kind") == kind) & (F.col("period_start") == start) & F.col("stopped_at").isNull()
    return periods.withColumn("stopped_at", F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("stopped_at")))


def current_budget(ledger: DataFrame, now: datetime, caps: dict[str, float | None], tz: str) -> DataFrame:
    """Spend of the week and month around ``now`` with cap, rest and whether the cap is reached (one row per period)."""
    t = F.lit(now).cast("timestamp")
    out = None
    for kind, cap in caps.items():
        start = period_start(kind, t, tz)
        lo, hi = local_midnight(start, tz), local_midnight(next_start(kind, start), tz)
        s = ledger.where((F.col("at") >= lo) & (F.col("at") < hi)).agg(*spend_columns())
        c = F.lit(cap).cast("double")
        row = s.select(
            F.lit(kind).alias("kind"), start.alias("period_start"), c.alias("cap_usd"), *SPEND,
            F.greatest(c - F.col("cost_usd"), F.when(c.isNotNull(), F.lit(0.0))).alias("remaining_usd"),
            F.coalesce(F.col("cost_usd") >= c, F.lit(False)).alias("cap_reached"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def budget_flag(current: DataFrame, unpriced_open: Column) -> DataFrame:
    """``error`` while a model has no price, ``warning`` once a cap is reached, else ``ok``."""
    reached = F.max("cap_reached")
    return current.agg(
        F.when(F.max(unpriced_open), "error").when(reached, "warning").otherwise("ok").alias("status"), reached.alias("cap_reached")
    )


# -- admission ------------------------------------------------------------------------------------------------


def admission(units: DataFrame, buckets: Sequence[Column], order: Sequence[Column], remaining: float) -> DataFrame:
    """Adds ``running`` and ``admitted``: in order, units fit until the first that does not."""
    run = global_prefix_sum(units, buckets, order, F.col("cost"), "running")
    return run.withColumn("admitted", F.col("running") <= remaining)


def budget_gate(units: DataFrame, buckets: Sequence[Column], order: Sequence[Column], limits: Sequence[tuple[float, float]]) -> DataFrame:
    """Adds ``gate``: too_large, go or stop. ``limits`` are ``(cap, spent)`` of the enabled periods, the week first.

    Period by period: a unit larger than the cap is passed over; one that does not fit, or meets an exhausted budget, is
    stopped with all later ones.
    """
    if not limits:
        return units.withColumn("gate", F.lit("go"))
    large = F.col("cost") > min(c for c, _ in limits) + EPS
    part = units.withColumn("_c", F.when(large, 0.0).otherwise(F.col("cost")))
    run = global_prefix_sum(part, buckets, order, F.col("_c"), "_run")
    gate = None
    for cap, spent in limits:
        # The first period with something to say decides.
        before = F.col("_run") - F.col("_c")
        rules = ((F.col("cost") > cap + EPS, "too_large"), ((before + F.col("cost") > cap - spent + EPS) | (before >= cap - spent - EPS), "stop"))
        for rule, said in rules:
            gate = F.when(rule, said) if gate is None else gate.when(rule, said)
    return run.withColumn("gate", gate.otherwise("go")).drop("_c", "_run")


# -- chunks and estimates -------------------------------------------------------------------------------------


def _units(body: Column, limit: int) -> Column:
    """What may not be cut further: paragraphs, lines of long paragraphs, stretches of long lines; each ends its own way."""
    step = max(limit - 1, 1)

    def stretches(line: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(line), F.lit(1)), F.lit(step))
        return F.transform(starts, lambda at: F.concat(F.substring(line, at, F.lit(step)), F.lit("\n")))

    def lines(para: Column) -> Column:
        parts = F.transform(F.split(para, "\n"), lambda x: F.when(F.length(x) < limit, F.array(F.concat(x, F.lit("\n")))).otherwise(stretches(x)))
        return F.concat(F.flatten(parts), F.array(F.lit("\n")))

    paragraphs = F.split(body, "\n\n")
    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= limit, F.array(F.concat(p, F.lit("\n\n")))).otherwise(lines(p))))


def chunks(body: Column, limit: int) -> Column:
    """A body as an array of chunks of at most ``limit`` characters; a body within the limit is one chunk as it is."""
    limit = max(limit, 1)
    none = F.array().cast("array<string>")

    def add(acc: Column, unit: Column) -> Column:
        full = (acc["open"] != "") & (F.length(acc["open"]) + F.length(unit) > limit)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(full, unit).otherwise(F.concat(acc["open"], unit)).alias("open")
        )

    packed = F.aggregate(_units(body, limit), F.struct(none.alias("done"), F.lit("").alias("open")), add, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    # White space at the end of a chunk goes, and a last chunk of nothing else.
    ends = F.transform(packed, lambda c: F.regexp_replace(c, r"\s+$", ""))
    # Under the name of a lambda the chunks are made once for all that is asked of them.
    kept = F.transform(F.array(ends), lambda e: F.when(F.element_at(e, -1) == "", F.slice(e, F.lit(1), F.size(e) - 1)).otherwise(e))[0]
    return F.when(F.length(body) > limit, kept).otherwise(F.array(body))


def unit_estimates(inputs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds ``n_calls, in_tokens, out_tokens`` of summarizing ``body``: a call per chunk and one to merge them."""
    n = F.size(chunks(F.col("body"), settings.max_input_chars))
    out = inputs.withColumn("_n", n)
    calls = F.when(F.col("_n") > 1, F.col("_n") + 1).otherwise(1).cast("long")
    return out.withColumn("n_calls", calls).withColumns({
        "in_tokens": X.estimate_tokens(F.col("body")) + F.col("n_calls") * settings.prompt_overhead_tokens,
        "out_tokens": F.col("n_calls") * settings.estimated_output_tokens,
    }).drop("_n")


def unit_costs(units: DataFrame, prices: DataFrame, reported: str | None = None) -> DataFrame:
    """Adds ``cost``: what the provider reported, else tokens times the price of the model per million, else null."""
    p = prices.select("model", F.col("input").alias("_pi"), F.col("output").alias("_po"))
    by_price = (F.col("in_tokens") * F.col("_pi") + F.col("out_tokens") * F.col("_po")) / 1_000_000
    cost = by_price if reported is None else F.coalesce(F.col(reported), by_price)
    return units.join(p, "model", "left").withColumn("cost", cost).drop("_pi", "_po")


def estimate(units: DataFrame) -> DataFrame:
    """Entries, calls, tokens and cost per profile and in total; one model without a price leaves the cost unknown.

    ``free`` marks units that cost nothing (a local tool).
    """
    known = F.when(F.col("free"), F.lit(0.0)).otherwise(F.col("cost"))
    g = units.rollup("profile")
    return g.agg(
        F.count(F.lit(1)).alias("entries"), F.sum("n_calls").alias("calls"), F.sum("in_tokens").alias("input_tokens"),
        F.sum("out_tokens").alias("output_tokens"),
        F.when(F.count_if(known.isNull()) == 0, F.sum(known)).alias("cost_usd"),
        F.array_join(F.array_sort(F.collect_set(F.when(known.isNull(), F.col("model")))), ",").alias("unpriced_models"),
    )


# -- summaries ------------------------------------------------------------------------------------------------

ChunkFn = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def summarize(
    inputs: DataFrame, on_chunks: ChunkFn, merge: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType, limit: int, fan_in: int = 64
) -> DataFrame:
    """Map over chunks, then merge per entry.

    ``on_chunks`` is the caller's ``mapInPandas`` function over ``(entry_id, chunk_no, n_chunks, text)`` and returns
    ``schema``; ``merge`` gets up to ``fan_in`` outputs of one entry in order and returns one row. An entry of more chunks is
    merged in levels, so no task gets more outputs of it at once. Entries of one chunk skip the shuffle. The caller's
    function runs once for every chunk: its outputs are written before they are merged.
    """
    cut_up = inputs.select("entry_id", chunks(F.col("body"), limit).alias("c"))
    # The outer form asks nothing of the array beforehand, so that a body is cut once.
    rows = cut_up.select("entry_id", F.size("c").alias("n_chunks"), F.posexplode_outer("c").alias("chunk_no", "text")).where(F.col("chunk_no").isNotNull())
    out = cut(rows.select("entry_id", "chunk_no", "n_chunks", "text").mapInPandas(on_chunks, schema), "chunk-outputs")
    names = schema.fieldNames()

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come by entry and part; the last group of a batch may go on in the next one, so it waits for that.
        def closed(pdf: pd.DataFrame) -> pd.DataFrame:
            made = pd.concat([merge(g[names]).assign(chunk_no=part) for (_, part), g in pdf.groupby(["entry_id", "part"], sort=False)])[names]
            # Joined texts would reach Arrow in pieces.
            return made.astype({c: object for c in names if isinstance(made[c].dtype, pd.StringDtype)})

        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = (pdf["entry_id"] == pdf["entry_id"].iloc[-1]) & (pdf["part"] == pdf["part"].iloc[-1])
            held = pdf[last]
            if not last.all():
                yield closed(pdf[~last])
        if held is not None:
            yield closed(held)

    many = out.where(F.col("n_chunks") > 1)
    left = many.agg(F.coalesce(F.max("chunk_no"), F.lit(0)) + 1).first()[0]
    while left > 1:
        parts = many.withColumn("part", F.floor(F.col("chunk_no") / fan_in))
        many = parts.repartition("entry_id", "part").sortWithinPartitions("entry_id", "part", "chunk_no").mapInPandas(merged, schema)
        left = -(-left // fan_in)
    return out.where(F.col("n_chunks") == 1).unionByName(many)
