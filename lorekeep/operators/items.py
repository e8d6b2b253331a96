"""Structured items: scopes, aliases, validation, effective status, staleness, queries and candidate closers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lorekeep.functions import jsonx, text as X
from lorekeep.functions.times import activity_at, item_at, local_date, safe_date
from lorekeep.operators.skew import cut, prefix_sum, top_n
from lorekeep.schemas import CLOSURE_KINDS, CONFIDENCE_RANK, DEFAULTS, ITEM_KINDS, ITEM_PROMPTS, Settings

# What may follow a meeting name, and the stamp in front of a rendered message.
_TITLE_TAIL = r"(?:(?:^| )(?:(?=\S*[0-9])[0-9\-/年月日:.時分jstutc]+|\(recurring\)|\(定期\)|recurring)(?= |$))+$"
_STAMP = r"^(?:(\d{4}-\d{2}-\d{2}) )?(\d{2}:\d{2}) (?=\s*(?!: )[^\n]{0,79}?: )"


def rank(conf: Column) -> Column:
    """Order of a confidence; an unknown one counts as low."""
    out = F.lit(0)
    for name, r in CONFIDENCE_RANK.items():
        out = F.when(conf == name, r).otherwise(out)
    return out


# -- scopes ---------------------------------------------------------------------------------------------------


def meeting_title(c: Column) -> Column:
    """Series name: normalized title without trailing dates and recurring marks."""
    return F.trim(F.regexp_replace(X.match_norm(c), _TITLE_TAIL, ""))


def scope_key() -> Column:
    """Group of related items, from ``source_kind``, ``source_id``, ``title`` and ``metadata``."""
    kind = F.col("source_kind")
    channel = F.coalesce(jsonx.get("metadata", "channel_id"), F.split_part("source_id", F.lit(":"), F.lit(1)))
    series = F.nullif(jsonx.get("metadata", "recurring_event_id"), F.lit(""))
    return (
        F.when(kind.isin("slack.thread", "slack.day"), F.concat(F.lit("slack:"), channel))
        .when((kind == "google.meet") & series.isNotNull(), F.concat(F.lit("meet:"), series))
        .when(kind == "google.meet", F.concat(F.lit("meet:title:"), meeting_title(F.col("title"))))
        .otherwise(F.concat_ws(":", kind, "source_id"))
    )


# -- aliases --------------------------------------------------------------------------------------------------

_ALIAS_JSON = "struct<aliases:struct<names:array<string>,emails:array<string>>,extra_aliases:struct<names:array<string>,emails:array<string>>>"
_EMAIL = r"[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}_\-]+(?:\.[\p{L}\p{N}_\-]+)*"


def alias_union(accounts: DataFrame) -> DataFrame:
    """``(field, value, key, pos)``: names and emails of enabled accounts, the first spelling of each kept."""
    cfg = F.from_json("config", _ALIAS_JSON)
    on = accounts.where(F.col("status") != "disabled").select("id", cfg.alias("c"))
    rows = None
    for g, group in enumerate(("aliases", "extra_aliases")):
        for fld in ("names", "emails"):
            r = on.select(
                F.lit(fld).alias("field"), F.struct("id", F.lit(g).alias("g")).alias("who"),
                F.posexplode(F.col("c")[group][fld]).alias("i", "raw"),
            )
            rows = r if rows is None else rows.unionByName(r)
    named = rows.select("field", F.struct("who", "i").alias("pos"), F.trim("raw").alias("value")).where(F.col("value") != "")
    key = F.translate("value", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return named.groupBy("field", key.alias("key")).agg(F.min_by("value", "pos").alias("value"), F.min("pos").alias("pos"))


def _compact(norm: Column) -> Column:
    return F.concat(F.lit("c:"), F.replace(norm, F.lit(" "), F.lit("")))


def _tokens(norm: Column) -> Column:
    t = F.array_sort(F.array_distinct(F.filter(F.split(norm, " "), lambda x: x != "")))
    return F.when(F.size(t) >= 2, F.concat(F.lit("t:"), F.array_join(t, " ")))


def alias_keys(aliases: DataFrame) -> DataFrame:
    """Distinct match keys of aliases given as ``(field, value)``."""
    norm = X.name_norm(F.col("value"))
    names = aliases.where(F.col("field") == "names").select(norm.alias("n")).where(F.col("n") != "")
    by_name = names.select(F.explode(F.array_compact(F.array(_compact(F.col("n")), _tokens(F.col("n"))))).alias("key"))
    emails = aliases.where(F.col("field") == "emails").select(F.concat(F.lit("e:"), F.lower(F.trim("value"))).alias("key"))
    return by_name.unionByName(emails).distinct()


def reference_keys(ref: Column) -> Column:
    """All keys under which a written reference can equal an alias."""
    norm = X.name_norm(ref)
    emails = F.transform(F.regexp_extract_all(F.lower(ref), F.lit(_EMAIL), F.lit(0)), lambda e: F.concat(F.lit("e:"), e))
    names = F.when(norm != "", F.array_compact(F.array(_compact(norm), _tokens(norm)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(emails, names))


def match_references(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """``refs(id, pos, ref)`` that are an alias: ``(id, basis)`` of the first matching reference of each id.

    References are reduced to their distinct spellings before they are normalized and joined.
    """
    spell = refs.select("ref").where(F.col("ref").isNotNull()).distinct()
    found = (
        spell.select("ref", F.explode(reference_keys(F.col("ref"))).alias("key"))
        .join(keys, "key", "left_semi")
        .groupBy("ref").agg(F.min(F.when(F.col("key").startswith("e:"), 0).otherwise(1)).alias("b"))
    )
    hit = refs.join(found, "ref").groupBy("id").agg(F.min_by("b", "pos").alias("b"))
    return hit.select("id", F.when(F.col("b") == 0, "email").otherwise("name").alias("basis"))


def who_matches(items: DataFrame, keys: DataFrame, who: str) -> DataFrame:
    """``(id, field, basis)`` of items that are mine, asked by me, or owned by the alias in ``keys``."""
    if who == "asked_by_me":
        refs = items.select("id", F.lit(0).alias("pos"), F.col("requester").alias("ref"))
        return match_references(refs, keys).withColumn("field", F.lit("requester"))
    if who == "owner":
        refs = items.select("id", F.lit(0).alias("pos"), F.col("owner").alias("ref"))
        return match_references(refs, keys).withColumn("field", F.lit("owner"))
    owned = F.col("kind").isin("action", "question")
    refs = items.select("id", "kind", F.posexplode(F.when(owned, F.array("owner")).otherwise(F.col("actors"))).alias("pos", "ref"))
    kinds = items.select("id", F.when(owned, "owner").otherwise("actor").alias("field"))
    return match_references(refs.select("id", "pos", "ref"), keys).join(kinds, "id")


# -- status and staleness -------------------------------------------------------------------------------------


def incoming(item_links: DataFrame, items: DataFrame, link_min: str) -> DataFrame:
    """Strong links per target, folded to fixed-size facts: latest source time and whether any source has no time."""
    strong = item_links.where((rank(F.col("confidence")) >= CONFIDENCE_RANK[link_min]) & F.col("relation").isin("resolves", "supersedes"))
    src = items.select(F.col("id").alias("from_item"), F.col("occurred_at").alias("from_at"))
    j = strong.join(src, "from_item", "left")
    aggs = []
    for rel in ("supersedes", "resolves"):
        is_rel = F.col("relation") == rel
        aggs += [
            F.max(F.when(is_rel, F.col("from_at"))).alias(f"{rel}_at"),
            F.max(is_rel & F.col("from_at").isNull()).alias(f"{rel}_untimed"),
            F.max(is_rel).alias(f"{rel}_any"),
        ]
    return j.groupBy(F.col("to_item").alias("id")).agg(*aggs)


def with_effective_status(
    items: DataFrame, item_links: DataFrame, link_min: str = DEFAULTS.link_min_confidence, all_items: DataFrame | None = None
) -> DataFrame:
    """Adds ``effective_status``: own status unless open; then a strong later link decides.

    ``all_items`` holds the items links come from, where ``items`` is only a selection of them.
    """
    inc = incoming(item_links, items if all_items is None else all_items, link_min)

    def later(rel: str) -> Column:
        timed = F.when(F.col("occurred_at").isNull(), F.col(f"{rel}_any")).otherwise(
            F.col(f"{rel}_untimed") | (F.col(f"{rel}_at") > F.col("occurred_at"))
        )
        return F.coalesce(timed, F.lit(False))

    closed = F.when(F.col("kind") == "question", "answered").otherwise("done")
    eff = (
        F.when(F.col("status") != "open", F.col("status"))
        .when(F.col("status").isNull(), F.lit(None).cast("string"))
        .when(later("supersedes"), "superseded").when(later("resolves"), closed).otherwise("open")
    )
    return items.join(inc, "id", "left").withColumn("effective_status", eff).select(*items.columns, "effective_status")


def scope_latest(items: DataFrame) -> DataFrame:
    return items.groupBy("scope_key").agg(F.max("occurred_at").alias("scope_latest"))


def with_stale(items: DataFrame, all_items: DataFrame, stale_days: int, now: datetime) -> DataFrame:
    """Adds ``stale``: open, and nothing newer in the scope (over all items) for more than ``stale_days``."""
    newest = F.greatest("occurred_at", "scope_latest")
    limit = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(stale_days))
    stale = F.coalesce((F.col("effective_status") == "open") & (newest < limit), F.lit(False))
    return items.join(scope_latest(all_items), "scope_key", "left").withColumn("stale", stale).drop("scope_latest")


# -- queries --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ItemQuery:
    kinds: Sequence[str] = ()
    statuses: Sequence[str] = ()
    who: str = "anyone"
    owner: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    due_by: date | None = None
    accounts: Sequence[str] = ()
    source_kinds: Sequence[str] = ()
    scope: str | None = None
    min_confidence: str | None = None
    stale: bool | None = None


def joined(items: DataFrame, entries: DataFrame, summaries: DataFrame) -> DataFrame:
    """Items with their entry and, where there is one, the summary that produced them."""
    e = entries.select(
        F.col("id").alias("entry_id"), "account_id", "source_kind", "title", "source_created_at", "source_updated_at", "ingested_at"
    )
    return items.join(e, "entry_id").join(summaries.select("entry_id", "model", "profile", "prompt_version"), "entry_id", "left")


def item_predicate(q: ItemQuery) -> Column:
    conds: list[Column] = []
    for name, values in (("kind", q.kinds), ("account_id", q.accounts), ("source_kind", q.source_kinds)):
        if values:
            conds.append(F.col(name).isin(*values))
    if q.since is not None:
        conds.append(item_at() >= F.lit(q.since))
    if q.until is not None:
        conds.append(item_at() < F.lit(q.until))
    if q.scope is not None:
        conds.append(F.col("scope_key") == q.scope)
    if q.due_by is not None:
        conds.append((F.col("kind") == "action") & (F.col("due") <= F.lit(q.due_by)))
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def status_matches(statuses: Sequence[str]) -> Column:
    """Kinds without a status match ``done`` only when they report finished work."""
    if not statuses:
        return F.lit(True)
    done = F.col("kind").isin("resolved", "accomplishment") & F.lit("done" in statuses)
    return F.when(F.col("effective_status").isNull(), done).otherwise(F.col("effective_status").isin(*statuses))


def query_items(
    items: DataFrame, entries: DataFrame, summaries: DataFrame, item_links: DataFrame, q: ItemQuery, now: datetime,
    aliases: DataFrame | None = None, settings: Settings = DEFAULTS,
) -> DataFrame:
    """All matches, with ``shown`` false for those hidden by the confidence floor alone."""
    picked = joined(items, entries, summaries).where(item_predicate(q))
    out = with_effective_status(picked, item_links, settings.link_min_confidence, all_items=items)
    out = with_stale(out, items, settings.stale_days, now).where(status_matches(q.statuses))
    if q.stale is not None:
        out = out.where(F.col("stale") == q.stale)
    if q.who != "anyone":
        if q.who == "owner":
            keys = alias_keys(items.sparkSession.createDataFrame([("names", q.owner)], "field string, value string"))
        else:
            if aliases is None or aliases.isEmpty():
                raise ValueError("no alias of the user is known")
            keys = alias_keys(aliases)
        m = who_matches(out, keys, q.who).select("id", F.col("field").alias("match_field"), F.col("basis").alias("match_basis"))
        out = out.join(m, "id")
    floor = CONFIDENCE_RANK[q.min_confidence or settings.item_min_confidence]
    return out.withColumn("shown", rank(F.col("confidence")) >= floor)


def answer_order(kinds: Sequence[str]) -> list[Column]:
    """Actions alone: by due date, undated last, then newest; everything else newest first."""
    if list(kinds) == ["action"]:
        return [F.col("due").asc_nulls_last(), F.col("occurred_at").desc_nulls_last(), F.col("id").desc()]
    return [item_at().desc(), F.col("id").desc()]


def answer_counts(matches: DataFrame) -> DataFrame:
    """``total`` shown before any limit, and ``hidden_low_confidence``."""
    return matches.agg(F.count_if("shown").alias("total"), F.count_if(~F.col("shown")).alias("hidden_low_confidence"))


def items_coverage(entries: DataFrame, summaries: DataFrame, items: DataFrame, where: Column | None = None) -> DataFrame:
    """How complete an item answer can be, in one pass over entries."""
    marked = items.select(F.col("entry_id").alias("id")).distinct().withColumn("_items", F.lit(True))
    s = summaries.select(F.col("entry_id").alias("id"), "generator_kind", "prompt_version")
    e = entries.where(where) if where is not None else entries
    done = F.col("summary_status") == "done"
    native = done & F.coalesce(F.col("generator_kind") == "source_native", F.lit(False))
    old = done & ~native & ~F.coalesce(F.col("prompt_version").isin(*ITEM_PROMPTS), F.lit(False))
    open_ = F.col("summary_status").isin("pending", "skipped", "failed")
    return e.join(s, "id", "left").join(marked, "id", "left").agg(
        F.count(F.lit(1)).alias("entries_in_range"),
        F.count("_items").alias("entries_with_items"),
        F.count_if(open_).alias("unsummarized"),
        F.count_if(old).alias("predate_items"),
        F.count_if(native).alias("native"),
        F.count_if(open_ | old | native).alias("entries_without_items"),
    )


def in_range(since: datetime | None, until: datetime | None) -> Column:
    out = F.lit(True)
    if since is not None:
        out = out & (activity_at() >= F.lit(since))
    if until is not None:
        out = out & (activity_at() < F.lit(until))
    return out


# -- candidate closers ----------------------------------------------------------------------------------------


def _odd() -> Column:
    """Whether NFKC can change a name of the item. Nearly all names have as many bytes as characters, which is quick to see."""
    names = F.concat_ws(" ", "actors", "owner", "requester")
    return (F.octet_length(names) != F.length(names)) & X.needs_nfkc(names)


def _group(name: Column, kind: Column) -> Column:
    """Key of a group. Digits of its hash come first: sorts compare eight bytes before the rest, and names begin alike."""
    return F.concat(F.lpad(F.hex(F.xxhash64(name)), 8, "0"), name, kind)


def _groups(items: DataFrame) -> DataFrame:
    """One row per item and group it belongs to: its scope, and every person on it.

    Names that NFKC cannot change are normalized in place; only items that are ``odd`` go through Python and a join.
    """
    facts = ["id", "entry_id", "at", "txt"]
    actors = F.coalesce("actors", F.array().cast("array<string>"))
    people = F.filter(F.concat(actors, F.array("owner", "requester")), lambda p: p.isNotNull())
    rows = items.select(*facts, "odd", "scope_key", F.array_distinct(people).alias("refs"))
    names = F.array_distinct(F.transform("refs", lambda p: X.plain_name(p)))
    plain = rows.where(~F.col("odd")).select(*facts, F.posexplode(F.concat(F.array("scope_key"), names)).alias("i", "n"))
    plain = plain.where("n <> '' or i = 0").select(*facts, _group(F.col("n"), F.when(F.col("i") == 0, ":s").otherwise(":p")).alias("grp"))
    special = rows.where("odd")
    spelled = special.select(*facts, F.explode("refs").alias("ref"))
    named = spelled.select("ref").distinct().select("ref", X.name_norm(F.col("ref")).alias("n")).where(F.col("n") != "")
    by_person = spelled.join(named, "ref").select(*facts, _group(F.col("n"), F.lit(":p")).alias("grp")).distinct()
    return plain.unionByName(special.select(*facts, _group(F.col("scope_key"), F.lit(":s")).alias("grp"))).unionByName(by_person)


def _similar_texts(left: DataFrame, right: DataFrame, texts: DataFrame, minimum: float) -> DataFrame:
    """Pairs of distinct texts that meet in a place and reach the similarity: ``(grp, slot, lt, rt, similarity)``.

    Where a place (group and slot) has so few texts that all its pairs are fewer rows than their grams, the pairs are
    taken as they are. Elsewhere a prefix filter holds: with grams in one global order, rarest first, two sets of
    similarity >= m share a gram among the first ``n - ceil(m n) + 1`` of each, so only pairs with such a gram and
    compatible sizes meet. Texts are compared once per pair, however many places they meet in.
    """
    place = ["grp", "slot"]
    sides = [df.groupBy(*place).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "nl"), (right, "nr"))]
    few = F.col("nl") * F.col("nr") <= 4 * (F.col("nl") + F.col("nr"))
    places = cut(sides[0].join(sides[1], place).select(*place, few.alias("few")), "closer-places")
    small, large = places.where("few").drop("few"), places.where(~F.col("few")).drop("few")
    direct = small.join(left, place).join(right, place).select(*place, "lt", "rt")
    gram_rows = texts.select("txt", F.explode("grams").alias("g"))
    df = gram_rows.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    ordered = gram_rows.join(df, "g").groupBy("txt").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("o"))
    n = F.size("o")
    keep = n - F.ceil(F.lit(minimum) * n - 1e-9).cast("int") + 1
    prefix = ordered.select("txt", n.alias("n"), F.explode(F.transform(F.slice("o", F.lit(1), keep), lambda x: x["g"])).alias("g"))
    lp = left.join(large, place, "left_semi").join(prefix.withColumnsRenamed({"txt": "lt", "n": "ln"}), "lt")
    rp = right.join(large, place, "left_semi").join(prefix.withColumnsRenamed({"txt": "rt", "n": "rn"}), "rt")
    sizes = (F.col("rn") >= F.col("ln") * minimum - 1e-9) & (F.col("ln") >= F.col("rn") * minimum - 1e-9)
    shared = lp.join(rp, [*place, "g"]).where(sizes).select(*place, "lt", "rt").distinct()
    met = cut(direct.unionByName(shared), "met-texts")
    lg = texts.select(F.col("txt").alias("lt"), F.col("grams").alias("lg"))
    rg = texts.select(F.col("txt").alias("rt"), F.col("grams").alias("rg"))
    pairs = met.select("lt", "rt").distinct()
    sim = pairs.join(lg, "lt").join(rg, "rt").select("lt", "rt", X.jaccard(F.col("lg"), F.col("rg")).alias("similarity"))
    return met.join(sim.where(F.col("similarity") >= minimum), ["lt", "rt"])


def _earliest(pool: DataFrame, keys: Sequence[str], keep: int) -> DataFrame:
    """Of every key, enough of the earliest rows to answer 'first ``keep`` after, from another entry' for any entry.

    The first ``keep`` rows of an entry, and the first ``keep`` + 1 entries: a fixed number of rows per key.
    """
    mine = W.partitionBy(*keys, "pe")
    first = F.min(F.struct("pt", "pid")).over(mine)
    rows = pool.withColumn("_n", F.row_number().over(mine.orderBy("pt", "pid"))).where(F.col("_n") <= keep)
    rows = rows.withColumn("_f", first)
    by_entry = F.dense_rank().over(W.partitionBy(*keys).orderBy("_f"))
    return rows.withColumn("_e", by_entry).where(F.col("_e") <= keep + 1).drop("_n", "_f", "_e")


def candidates(
    targets: DataFrame, pool: DataFrame, window_days: int = DEFAULTS.candidate_days,
    minimum: float = DEFAULTS.candidate_min_similarity, keep: int = 3,
) -> DataFrame:
    """Up to ``keep`` later items that may close each target: ``(target_id, candidate_id, rank, similarity, same_scope, shared_person)``.

    ``targets`` are open actions and questions with a time, ``pool`` the closing kinds. A candidate is from another entry,
    in the same scope or with a shared person, and at most the window later. Ties go to the earlier item, then the lower id.

    Texts are compared once per distinct pair. Copies of one text in one group are not paired one by one: each target looks
    at the rest of its own hour second by second, the rest of its day hour by hour and later days day by day, where every
    unit holds a fixed number of its earliest rows. So the rows per target and text do not grow with the group.
    """
    window_secs = window_days * 86_400
    cols = ["id", "entry_id", "text", "scope_key", "actors", "owner", "requester"]
    at = F.unix_timestamp("occurred_at").alias("at")
    sides = targets.select(F.lit(0).alias("side"), *cols, at).unionByName(pool.select(F.lit(1).alias("side"), *cols, at))
    sides = cut(sides.where(F.col("at").isNotNull()).withColumns({"txt": F.xxhash64("text"), "odd": _odd()}), "closer-items")
    texts = sides.select("txt", "text").dropDuplicates(["txt"]).select("txt", X.match_norm(F.col("text")).alias("norm"))
    texts = cut(texts.where(F.col("norm") != "").select("txt", X.grams(F.col("norm")).alias("grams")), "closer-texts")
    slot = F.floor(F.col("at") / window_secs)
    tg = cut(_groups(sides.where(F.col("side") == 0)).select(
        "grp", slot.alias("slot"), F.col("txt").alias("lt"), F.col("id").alias("tid"), F.col("entry_id").alias("te"), F.col("at").alias("tt")
    ), "closer-targets")
    # Only closers of a group and window that has a target are looked at any further. Slots meet by eras of four, so that
    # a closer is moved once for both slots it can serve: its own and the one before.
    era = lambda c: F.floor(c / 4)
    eras = F.explode(F.array_distinct(F.array(era(F.col("slot")), era(F.col("slot") + 1)))).alias("era")
    asked = tg.select("grp", "slot").distinct().select("grp", "slot", eras).groupBy("grp", "era").agg(F.collect_set("slot").alias("slots"))
    pg = _groups(sides.where(F.col("side") == 1)).select(
        "grp", slot.alias("own"), F.col("txt").alias("rt"), F.col("id").alias("pid"), F.col("entry_id").alias("pe"), F.col("at").alias("pt")
    )
    served = F.explode(F.array_intersect(F.array("own", F.col("own") - 1), "slots")).alias("slot")
    pg = cut(pg.withColumn("era", era(F.col("own"))).join(asked, ["grp", "era"]).select("grp", served, "own", "rt", "pid", "pe", "pt"), "closer-pool")
    left = cut(tg.select("grp", "slot", "lt").distinct(), "target-texts")
    right = cut(pg.select("grp", "slot", "rt").distinct(), "pool-texts")
    sim = cut(_similar_texts(left, right, texts, minimum), "similar-texts")
    place = ["grp", "slot", "rt"]
    pg = pg.join(sim.select(*place).distinct(), place, "left_semi")
    day, hour = F.floor(F.col("pt") / 86_400), F.floor(F.col("pt") / 3_600)
    # Each level is written: it is read as it is and for the next one.
    seconds = cut(_earliest(pg, [*place, "pt"], keep), "closer-seconds")
    hourly = cut(_earliest(seconds.withColumn("h", hour), [*place, "h"], keep), "closer-hours")
    daily = _earliest(hourly.withColumn("d", day), [*place, "d"], keep)
    facts = [*place, "pid", "pe", "pt"]
    here = F.col("own") == F.col("slot")
    units = (
        seconds.where(here).select(*facts, F.lit("s").alias("level"), hour.alias("unit"))
        .unionByName(hourly.where(here).select(*facts, F.lit("h").alias("level"), day.alias("unit")))
        .unionByName(daily.select(*facts, F.lit("d").alias("level"), F.col("slot").alias("unit")))
    )
    tday, thour = F.floor(F.col("tt") / 86_400), F.floor(F.col("tt") / 3_600)
    probes = F.array(
        F.struct(F.lit("s").alias("level"), thour.alias("unit")), F.struct(F.lit("h").alias("level"), tday.alias("unit")),
        F.struct(F.lit("d").alias("level"), F.col("slot").alias("unit")),
    )
    want = tg.join(sim, ["grp", "slot", "lt"]).select(*place, "tid", "te", "tt", "similarity", F.explode(probes).alias("u"))
    want = want.select(*place, "tid", "te", "tt", "similarity", "u.level", "u.unit")
    later = (
        F.when(F.col("level") == "d", day > tday).when(F.col("level") == "h", hour > thour).otherwise(F.col("pt") > F.col("tt"))
    )
    found = want.join(units, [*place, "level", "unit"]).where(
        later & (F.col("pe") != F.col("te")) & (F.col("pt") - F.col("tt") <= window_secs)
    )
    order = [F.col("similarity").desc(), F.col("pt"), F.col("pid")]
    # Each group keeps its own best first; a pair that is best overall is among the best of every group it meets in.
    best = top_n(found.select("tid", "grp", "pid", "pt", "similarity"), ["tid", "grp"], order, keep)
    best = best.groupBy("tid", "pid").agg(
        F.min("pt").alias("pt"), F.max("similarity").alias("similarity"),
        F.max(F.col("grp").endswith(":s")).alias("same_scope"), F.max(F.col("grp").endswith(":p")).alias("shared_person"),
    )
    return top_n(best, ["tid"], order, keep, rank="rank").select(
        F.col("tid").alias("target_id"), F.col("pid").alias("candidate_id"), "rank", "similarity", "same_scope", "shared_person"
    )


def open_targets(items: DataFrame) -> DataFrame:
    """Open actions and questions with a time, by effective status."""
    return items.where(
        (F.col("effective_status") == "open") & F.col("kind").isin("action", "question") & F.col("occurred_at").isNotNull()
    )


def closure_pool(items: DataFrame) -> DataFrame:
    """Items that can close another one, by their own status."""
    done = (F.col("kind") == "action") & F.col("status").isin("done", "dropped")
    return items.where((F.col("kind").isin(*CLOSURE_KINDS) | done) & F.col("occurred_at").isNotNull())


# -- drafts and validation ------------------------------------------------------------------------------------


def parse_output(outputs: DataFrame, column: str = "output") -> DataFrame:
    """Model output to ``overview``, ``details`` and ``drafts``; ``parse_error`` says why a row has none.

    Prose and fences around the object are dropped; fields of a wrong type count as missing.
    """
    raw = F.regexp_extract(column, r"(?s)\{.*\}", 0)
    v = outputs.withColumn("_v", F.when(raw != "", F.try_parse_json(raw)))

    def typed(var: Column, path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(var, path, "variant"))

    def string(var: Column, path: str) -> Column:
        s = F.when(typed(var, path) == "STRING", F.try_variant_get(var, path, "string"))
        return F.when(F.trim(s) != "", F.trim(s))

    def actors(var: Column) -> Column:
        many = F.try_variant_get(var, "$.actors", "array<variant>")
        names = F.transform(many, lambda a: F.when(F.schema_of_variant(a) == "STRING", F.trim(F.try_variant_get(a, "$", "string"))))
        kept = F.filter(names, lambda a: a.isNotNull() & (a != ""))
        one = string(var, "$.actors")
        return F.coalesce(F.when(one.isNotNull(), F.array(one)), kept, F.array().cast("array<string>"))

    fields = ["kind", "text", "owner", "requester", "due", "status", "confidence", "evidence"]
    objects = F.filter(
        F.try_variant_get("_v", "$.items", "array<variant>"), lambda i: F.schema_of_variant(i).startswith("OBJECT")
    )
    drafts = F.transform(objects, lambda i: F.struct(*[string(i, f"$.{f}").alias(f) for f in fields], actors(i).alias("actors")))
    over = F.when(typed(F.col("_v"), "$.overview") == "STRING", F.try_variant_get("_v", "$.overview", "string"))
    error = (
        F.when(raw == "", "no JSON object found").when(F.col("_v").isNull(), "invalid JSON")
        .when(over.isNull(), 'missing "overview" string')
        .when(~F.coalesce(typed(F.col("_v"), "$.items").startswith("ARRAY"), F.lit(False)), 'missing "items" array')
    )
    det = F.coalesce(
        F.when(typed(F.col("_v"), "$.details") == "STRING", F.try_variant_get("_v", "$.details", "string")),
        F.array_join(F.try_variant_get("_v", "$.details", "array<string>"), "\n"),
    )
    return v.select(
        *outputs.columns, over.alias("overview"), det.alias("details"),
        F.when(error.isNull(), F.coalesce(drafts, F.array())).alias("drafts"), error.alias("parse_error"),
    )


def body_lines(bodies: DataFrame) -> DataFrame:
    """Texts ``(entry_id, body)`` as numbered lines ``(entry_id, line_no, line)``."""
    return bodies.select("entry_id", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))


def message_blocks(lines: DataFrame) -> DataFrame:
    """Numbered lines ``(entry_id, line_no, line)`` of rendered conversations cut into ``(entry_id, block, day, hm, text)``.

    A stamped line starts a block and other lines continue it; blocks are counted stretch by stretch, so a conversation is
    never in one task.
    """
    day, hm = F.regexp_extract("line", _STAMP, 1), F.regexp_extract("line", _STAMP, 2)
    stamped = F.col("line").rlike(_STAMP) & ((day == "") | safe_date(day).isNotNull())
    lines = prefix_sum(lines, ["entry_id"], [F.floor(F.col("line_no") / 1000)], [F.col("line_no")], stamped.cast("int"), "block")
    pieces = lines.select(
        "entry_id", "line_no", F.when(stamped, F.nullif(day, F.lit(""))).alias("day"), F.when(stamped, hm).alias("hm"),
        F.when(stamped, F.regexp_replace("line", r"^(?:\d{4}-\d{2}-\d{2} )?\d{2}:\d{2}", "")).otherwise(F.col("line")).alias("part"),
        "block",
    ).where(F.col("block") > 0)
    return pieces.groupBy("entry_id", "block").agg(
        F.max("day").cast("date").alias("day"), F.max("hm").alias("hm"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part"))), lambda x: x["part"]), "\n").alias("text"),
    )


PROBE = 8


def quoted_blocks(quotes: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(entry_id, ordinal, block)`` of blocks ``(entry_id, block, norm)`` that hold a quote ``(entry_id, ordinal, quote_norm)``.

    A quote of ``PROBE`` characters or more is looked up by the one of its grams that the fewest blocks of its entry hold,
    and compared with these blocks only; a shorter quote is a gram itself. So the work follows the characters of the
    conversation and of the quotes, not their product.
    """
    q = quotes.where(F.col("quote_norm") != "").select("entry_id", "ordinal", "quote_norm", F.least(F.length("quote_norm"), F.lit(PROBE)).alias("n"))
    asked = q.select("entry_id").distinct()
    texts = blocks.join(asked, "entry_id", "left_semi")
    out = None
    # At most as many passes as there are lengths up to the probe's.
    for n in sorted(r.n for r in q.select("n").distinct().collect()):
        grams = texts.select("entry_id", "block", F.explode(F.array_distinct(X.windows(F.col("norm"), n))).alias("g"))
        mine = q.where(F.col("n") == n)
        if n < PROBE:
            hit = grams.join(mine.withColumnRenamed("quote_norm", "g"), ["entry_id", "g"]).select("entry_id", "ordinal", "block")
        else:
            probes = mine.select("entry_id", "ordinal", "quote_norm", F.posexplode(X.windows(F.col("quote_norm"), n)).alias("pos", "g"))
            held = cut(grams.join(probes.select("entry_id", "g").distinct(), ["entry_id", "g"], "left_semi"), "probe-grams")
            count = held.groupBy("entry_id", "g").agg(F.count(F.lit(1)).alias("c"))
            rare = probes.join(count, ["entry_id", "g"], "left").groupBy("entry_id", "ordinal", "quote_norm").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "pos", "g")).alias("p"))
            found = rare.where(F.col("p.c") > 0).select("entry_id", "ordinal", "quote_norm", F.col("p.g").alias("g")).join(held, ["entry_id", "g"])
            hit = found.join(texts, ["entry_id", "block"]).where(F.contains("norm", "quote_norm")).select("entry_id", "ordinal", "block")
        out = hit if out is None else out.unionByName(hit)
    return q.select("entry_id", "ordinal", F.lit(0).cast("long").alias("block")).where("false") if out is None else out


def occurred_times(quotes: DataFrame, bodies: DataFrame, tz: str, lines: DataFrame | None = None) -> DataFrame:
    """Time of the first block that holds each quote: ``(entry_id, ordinal, at)``.

    ``quotes(entry_id, ordinal, quote_norm)``; ``bodies(entry_id, source_created_at)`` with the text as ``body``, or as
    numbered ``lines(entry_id, line_no, line)`` beside it.
    """
    lines = body_lines(bodies) if lines is None else lines
    quotes = cut(quotes.select("entry_id", "ordinal", "quote_norm"), "quotes")
    blocks = cut(message_blocks(lines).withColumn("norm", X.match_norm(F.col("text"))).drop("text"), "quote-blocks")
    hit = quoted_blocks(quotes, blocks).groupBy("entry_id", "ordinal").agg(F.min("block").alias("block"))
    first = hit.join(blocks.select("entry_id", "block", "day", "hm"), ["entry_id", "block"]).select("entry_id", "ordinal", F.struct("day", "hm").alias("b"))
    base = bodies.select("entry_id", local_date(F.col("source_created_at"), tz).alias("base_day"))
    local = F.try_to_timestamp(F.concat_ws(" ", F.coalesce(F.col("b")["day"], F.col("base_day")).cast("string"), F.col("b")["hm"]), F.lit("yyyy-MM-dd HH:mm"))
    return first.join(base, "entry_id").select("entry_id", "ordinal", F.to_utc_timestamp(local, tz).alias("at"))


def judge(entries: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Drafts ``(entry_id, drafts)`` of a model against the ``body`` they came from, each with its outcome and fields.

    Every draft comes back with ``outcome`` kept / dropped and ``downgraded``; kept ones carry their final ``ordinal``.
    """
    d = entries.select("entry_id", F.posexplode("drafts").alias("pos", "d")).select("entry_id", "pos", "d.*")
    kind = F.lower(F.trim("kind"))
    st = F.lower(F.trim("status"))
    status = (
        F.when(kind == "action", F.when(F.col("status").isNull(), "open").when(st.isin("open", "done", "dropped"), st))
        .when(kind == "question", F.when(F.col("status").isNull(), "open").when(st.isin("open", "answered"), st))
    )
    conf = F.lower(F.trim("confidence"))
    d = d.select(
        "entry_id", "pos", kind.alias("kind"), F.trim("text").alias("text"), status.alias("status"),
        F.when(conf.isin(*CONFIDENCE_RANK), conf).otherwise("low").alias("confidence"),
        F.substring(F.trim("evidence"), 1, settings.max_evidence_chars).alias("quote"),
        F.nullif(F.trim("owner"), F.lit("")).alias("owner"), F.nullif(F.trim("requester"), F.lit("")).alias("requester"),
        F.when(kind == "action", safe_date(F.col("due"))).alias("due"),
        F.slice(F.array_distinct(F.filter(F.transform("actors", lambda a: F.trim(a)), lambda a: a != "")), 1, settings.max_actors).alias("actors"),
    )
    bad = ~F.coalesce(F.col("kind").isin(*ITEM_KINDS), F.lit(False)) | F.coalesce(F.col("text") == "", F.lit(True)) | (
        F.col("kind").isin("action", "question") & F.col("status").isNull()
    )
    # Drafts are short: they are parsed and normalized once, whatever is asked about them.
    d = cut(d.withColumn("bad", bad).withColumn("nq", F.coalesce(X.match_norm(F.col("quote")), F.lit(""))), "drafts")
    # Quotes go back to one array per entry, so that the long body is read once per entry and not once per draft.
    folded = d.groupBy("entry_id").agg(F.collect_list(F.struct("pos", "nq")).alias("quotes"))
    body = entries.select("entry_id", X.match_norm(F.col("body")).alias("nb"))
    seen = folded.join(body, "entry_id").select(
        "entry_id",
        F.explode(F.transform("quotes", lambda q: F.struct(q["pos"], ((q["nq"] != "") & F.contains(F.col("nb"), q["nq"])).alias("found")))).alias("q"),
    ).select("entry_id", "q.pos", "q.found")
    seen = cut(seen, "evidence-found")
    d = d.join(seen, ["entry_id", "pos"])
    completion = F.col("kind").isin("resolved", "accomplishment") | F.coalesce(F.col("status").isin("done", "dropped", "answered"), F.lit(False))
    verified = F.col("found") & (~completion | (F.length("nq") >= settings.min_evidence_chars))
    d = d.withColumn("verified", F.coalesce(verified, F.lit(False)))
    unproven = ~F.col("verified") & F.col("kind").isin("resolved", "accomplishment")
    reopened = ~F.col("verified") & F.coalesce(F.col("status").isin("done", "dropped", "answered"), F.lit(False))
    lowered = ~F.col("verified") & (F.col("confidence") != "low")
    d = d.withColumns({
        "outcome": F.when(F.col("bad") | unproven, "dropped").otherwise("kept"),
        "downgraded": ~F.col("bad") & ~unproven & (reopened | lowered),
        "status": F.when(reopened, "open").otherwise(F.col("status")),
        "confidence": F.when(F.col("verified"), F.col("confidence")).otherwise("low"),
        "evidence": F.when(F.col("verified"), F.col("quote")),
        "owner": F.when(F.col("kind").isin("action", "question"), F.col("owner")),
        "requester": F.when(F.col("kind") == "action", F.col("requester")),
    })
    kept = d.where(F.col("outcome") == "kept")
    order = [rank(F.col("confidence")).desc(), F.col("pos")]
    capped = top_n(kept, ["entry_id"], order, settings.items_max_per_entry).select("entry_id", "pos")
    numbered = capped.select("entry_id", "pos", (F.row_number().over(W.partitionBy("entry_id").orderBy("pos")) - 1).alias("ordinal"))
    return d.join(numbered, ["entry_id", "pos"], "left").withColumn("outcome", F.when(F.col("ordinal").isNull(), "dropped").otherwise("kept"))


def validate(entries: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``judge`` with the scope of every draft and the time of what it says.

    ``entries``: ``entry_id, body, drafts`` and the entry columns ``source_kind, source_id, title, metadata,
    source_created_at, source_updated_at``.
    """
    # The verdicts are written, so that the long bodies are read for them once and not again for the times.
    out = cut(judge(entries, settings), "verdicts")
    ctx = entries.select(
        "entry_id", "source_kind", "source_created_at", "source_updated_at", scope_key().alias("scope_key")
    )
    chat = F.col("source_kind").isin("slack.thread", "slack.day")
    out = out.join(ctx, "entry_id")
    quotes = out.where(chat & F.col("evidence").isNotNull() & (F.col("outcome") == "kept")).select("entry_id", "ordinal", F.col("nq").alias("quote_norm"))
    at = occurred_times(quotes, entries.where(chat).select("entry_id", "body", "source_created_at"), settings.day_timezone)
    out = out.join(at, ["entry_id", "ordinal"], "left")
    occurred = (
        F.when(chat, F.coalesce("at", "source_updated_at", "source_created_at"))
        .when(F.col("source_kind") == "google.meet", F.coalesce("source_created_at", "source_updated_at"))
        .otherwise(F.coalesce("source_updated_at", "source_created_at"))
    )
    return out.select(
        "entry_id", "pos", "outcome", "downgraded", "ordinal", "kind", "text", "status", "owner", "requester", "due", "actors",
        occurred.alias("occurred_at"), "confidence", "evidence", "scope_key",
    )


def validation_counts(validated: DataFrame, by: Sequence[str] = ("entry_id",)) -> DataFrame:
    """Kept, downgraded and dropped drafts. A draft cut by the cap counts as dropped and may count as downgraded."""
    kept = F.col("outcome") == "kept"
    return validated.groupBy(*by).agg(
        F.count_if(kept).alias("kept"), F.count_if(F.col("downgraded")).alias("downgraded"), F.count_if(~kept).alias("dropped")
    )


def replace_items(current: DataFrame, entry_ids: DataFrame, incoming_items: DataFrame) -> DataFrame:
    """Next items: all items of the given entries replaced."""
    return current.join(entry_ids.select("entry_id").distinct(), "entry_id", "left_anti").unionByName(
        incoming_items.select(*current.columns)
    )


def render_sections(items: DataFrame) -> DataFrame:
    """The decisions and action sections of an entry from its validated items (at most the item cap per entry)."""
    prefix = F.when(F.col("status") == "done", "[done] ").when(F.col("status") == "dropped", "[dropped] ").otherwise("")
    line = F.when(F.col("kind") == "decision", F.concat(F.lit("- "), "text")).otherwise(F.concat(F.lit("- "), prefix, "text"))
    kind = F.when(F.col("kind") == "decision", "decisions").otherwise("action_items")
    rows = items.where(F.col("kind").isin("decision", "action")).select("entry_id", kind.alias("kind"), "ordinal", line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"])
    return rows.groupBy("entry_id", "kind").agg(F.array_join(lines, "\n").alias("text")).withColumn("origin", F.lit("generated"))


def frequent_names(people: DataFrame, keep: int = 3) -> DataFrame:
    """Most frequent names per account from ``(account_id, name, seen)``: first spelling, ties by first appearance."""
    named = people.select("account_id", F.trim("name").alias("name"), "seen").where((F.col("name") != "") & ~F.contains("name", F.lit("@")))
    g = named.groupBy("account_id", F.lower("name").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("name", "seen").alias("name"), F.min("seen").alias("seen")
    )
    return top_n(g, ["account_id"], [F.col("n").desc(), F.col("seen")], keep, rank="rank").select("account_id", "rank", "name", "n")


def refresh_aliases(accounts: DataFrame, directory: DataFrame, people: DataFrame) -> DataFrame:
    """Accounts whose own names or addresses changed: ``(id, names, emails)``.

    ``accounts(id, kind, identity, names, emails)``: a chat account's identity is ``team:user``, looked up in
    ``directory(user_id, real_name, display_name, name, email)``; a mail account's identity is its address, and its names
    are the most frequent ones of ``people(account_id, name, email, is_self, seen)`` that are its owner's. Other kinds, and
    accounts about which nothing is known, stay as they are.
    """
    user = F.split_part("identity", F.lit(":"), F.lit(2))
    chat = accounts.where(F.col("kind") == "slack").withColumn("user_id", user).join(directory, "user_id")
    spelled = F.filter(F.transform(F.array("real_name", "display_name", "name"), F.trim), lambda n: n.isNotNull() & (n != ""))
    once = F.filter(spelled, lambda n, i: ~F.exists(F.slice(spelled, 1, i), lambda o: F.lower(o) == F.lower(n)))
    of_chat = chat.select("id", once.alias("_names"), F.array_compact(F.array(F.nullif(F.trim("email"), F.lit("")))).alias("_emails"))
    mail = accounts.where((F.col("kind") == "google") & F.contains("identity", F.lit("@"))).select("id", F.trim("identity").alias("identity"))
    own = people.join(mail.withColumnRenamed("id", "account_id"), "account_id").where(
        F.coalesce(F.col("is_self"), F.lit(False)) | F.coalesce(F.lower("email") == F.lower("identity"), F.lit(False)))
    top = frequent_names(own.select("account_id", "name", "seen"))
    names = top.groupBy(F.col("account_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda r: r["name"]).alias("_names"))
    none = F.array().cast("array<string>")
    of_mail = mail.join(names, "id", "left").select("id", F.coalesce("_names", none).alias("_names"), F.array("identity").alias("_emails"))
    j = accounts.select("id", "names", "emails").join(of_chat.unionByName(of_mail), "id")
    known = (F.size("_names") > 0) | (F.size("_emails") > 0)
    same = F.col("names").eqNullSafe(F.col("_names")) & F.col("emails").eqNullSafe(F.col("_emails"))
    return j.where(known & ~same).select("id", F.col("_names").alias("names"), F.col("_emails").alias("emails"))


def evidence_containment(quotes: DataFrame, texts: DataFrame, min_gram: int = 8) -> DataFrame:
    """Corpus-wide containment: ``(quote_id, text_id)`` where the normalized quote occurs in the normalized text.

    A quote is looked up by its first ``min_gram`` characters that start with a blank, among those of the texts: about one
    place of a text in six. A quote without such characters is looked up by its first ``min_gram`` ones at every place (all
    of a shorter one). Only texts that hold these are compared in full. ``quotes`` are short; the texts may be of any length.
    """
    q = quotes.select("quote_id", X.match_norm(F.col("quote")).alias("q")).where(F.col("q") != "")
    at = F.instr("q", " ")
    led = (at > 0) & (F.length("q") - at + 1 >= min_gram)
    size = F.when(led, min_gram).otherwise(F.least(F.length("q"), F.lit(min_gram)))
    probe = cut(q.select("quote_id", "q", led.alias("led"), size.alias("n"), F.substring("q", F.when(led, at).otherwise(1), size).alias("g")), "containment-probes")
    # At most as many passes as there are lengths up to the probe's, and the one of blanks.
    passes = [(r["led"], r["n"]) for r in probe.select("led", "n").distinct().orderBy("led", "n").limit(min_gram + 1).collect()]
    if not passes:
        return texts.select(F.lit(None).cast(quotes.schema["quote_id"].dataType).alias("quote_id"), "text_id").limit(0)
    t = cut(texts.select("text_id", X.match_norm(F.col("text")).alias("t")), "containment-texts")
    out = None
    for led, n in passes:
        g = F.array_distinct(X.windows(F.col("t"), n, " " if led else ""))
        gl = t.select("text_id", F.explode(g).alias("g"))
        hit = gl.join(probe.where((F.col("led") == led) & (F.col("n") == n)), "g").select("quote_id", "q", "text_id")
        out = hit if out is None else out.unionByName(hit)
    return out.join(t, "text_id").where(F.contains("t", "q")).select("quote_id", "text_id").distinct()
