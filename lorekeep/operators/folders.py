"""Folder listings: walk, filters, paths, diff against the catalog, size report."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.operators.skew import cut, first_by
from lorekeep.schemas import BUILTIN_EXCLUDES, DEFAULTS


def join_path(names: Column, limit: int = DEFAULTS.folder_path_chars) -> Column:
    """``a / b / c``; over the limit the first name and as many of the last ones as fit, with dots between."""
    full = F.array_join(names, " / ")
    head = names[0]
    start = F.struct((F.length(head) + 7).alias("len"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("out"))

    def take(acc: Column, name: Column) -> Column:
        need = acc["len"] + F.length(name) + 3
        over = acc["full"] | (need > limit)
        return F.struct(
            F.when(over, acc["len"]).otherwise(need).alias("len"), over.alias("full"),
            F.when(over, acc["out"]).otherwise(F.concat(F.array(name), acc["out"])).alias("out"),
        )

    tail = F.aggregate(F.reverse(F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0)))), start, take)["out"]
    short = F.when(F.size(tail) == 0, F.substring(head, 1, limit)).otherwise(F.concat(head, F.lit(" / ... / "), F.array_join(tail, " / ")))
    return F.when((F.length(full) <= limit) | (F.size(names) < 3), F.substring(full, 1, limit)).otherwise(short)


def allows(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), name: Column | None = None) -> Column:
    """Built-in and own excludes win; without an include everything else passes. ``name`` is the end of the path, if at hand."""
    hidden = X.glob_match(path, [*BUILTIN_EXCLUDES, *exclude], path=True, name=name)
    return ~hidden & (X.glob_match(path, include, path=True, name=name) if include else F.lit(True))


def walk(children: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Folders reachable from ``roots(root_id, root_name)`` breadth first: ``root_id, folder_id, names, depth``.

    One join per level, until a level holds no new folder or ``max_depth`` is reached. A folder keeps its first place: the lowest depth, then the lowest
    parent. Folders already seen under a root are never entered again, so loops end. Levels are written out, so the plan
    of a level does not contain the ones before it.
    """
    links = children.where(F.col("type") == "folder").select(F.col("parent_id").alias("folder_id"), F.col("id").alias("child"), "name")
    level = roots.select("root_id", F.col("root_id").alias("folder_id"), F.array("root_name").alias("names"), F.lit(0).alias("depth"))
    seen = level
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = level.join(links, "folder_id").select(
            "root_id", F.col("child").alias("to"), F.concat("names", F.array("name")).alias("names"), F.col("folder_id").alias("via"))
        new = step.join(seen.select("root_id", F.col("folder_id").alias("to")), ["root_id", "to"], "left_anti")
        one = first_by(new, ["root_id", "to"], F.struct("via", "names"))
        level = cut(one.select("root_id", F.col("to").alias("folder_id"), "names", F.lit(depth).alias("depth")), "folders")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def scan(children: DataFrame, roots: DataFrame, max_depth: int | None = None, recursive: bool = True,
         include: Sequence[str] = (), exclude: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Files under every root with their folder path, and counts of what was left out per root."""
    seen = walk(children, roots, max_depth if recursive else 0)
    # What a folder gives to all of its files is made once: its shown path, and its path for the globs.
    inner = F.slice("names", F.lit(2), F.greatest(F.size("names") - 1, F.lit(0)))
    places = seen.select("root_id", "folder_id", "depth", join_path(F.col("names")).alias("folder_path"),
                         F.array_join(F.concat(inner, F.array(F.lit(""))), "/").alias("prefix"))
    inside = children.withColumnRenamed("parent_id", "folder_id").join(places, "folder_id")
    name = F.coalesce("name", F.lit(""))
    files = inside.where(F.col("type") == "file").withColumn("allowed", allows(F.concat("prefix", name), include, exclude, name))
    beyond = F.lit(False) if max_depth is None else F.col("depth") >= max_depth
    deep = inside.where((F.col("type") == "folder") & beyond & F.lit(recursive)).select("root_id", "id").join(
        seen.select("root_id", F.col("folder_id").alias("id")), ["root_id", "id"], "left_anti")
    out = files.where("allowed").select("root_id", "id", "name", "modified", "etag", "size", "folder_path")
    marks = (
        files.where(~F.col("allowed")).select("root_id", F.lit("excluded").alias("why"))
        .unionByName(inside.where(F.col("type") == "unsupported").select("root_id", F.lit("unsupported").alias("why")))
        .unionByName(deep.select("root_id", F.lit("too_deep").alias("why")))
    )
    return out, marks.groupBy("root_id", "why").agg(F.count(F.lit(1)).alias("count"))


def diff(files: DataFrame, known: DataFrame, other_kinds: DataFrame, changed: Column) -> DataFrame:
    """Adds ``state`` to listed files: new, changed, unchanged, or duplicate of an entry of another kind.

    ``known(id, state_etag, state_modified)`` are stored fetch states; ``changed`` is the source's own rule over both.
    """
    k = known.withColumn("_known", F.lit(True))
    o = other_kinds.select("id").distinct().withColumn("_other", F.lit(True))
    no_state = F.col("state_etag").isNull() & F.col("state_modified").isNull()
    state = (
        F.when(F.col("_known") & (no_state | F.coalesce(changed, F.lit(True))), "changed").when(F.col("_known"), "unchanged")
        .when(F.col("_other"), "duplicate").otherwise("new")
    )
    return files.join(k, "id", "left").join(o, "id", "left").withColumn("state", state).select(*files.columns, "state")


def size_report(files: DataFrame, largest: int = 5) -> tuple[DataFrame, DataFrame]:
    """Total bytes, and the largest files by size, then name."""
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files"))
    return total, files.orderBy(F.col("size").desc(), "name", "id").limit(largest)


def after_cursor(changes: DataFrame, cursor: Column) -> tuple[DataFrame, DataFrame]:
    """Change feed past a cursor, and the next cursor."""
    rows = changes.where(F.col("modified") > cursor)
    return rows, changes.agg(F.greatest(F.max("modified"), cursor).alias("cursor"))
