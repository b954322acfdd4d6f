"""Dependency graphs: hop-limited search, roots, suggestions, lineage within a change."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumenspan.functions import text as T
from lumenspan.operators.select import keep_first
from lumenspan.schemas import LIMITS
from lumenspan.sources.scratch import settled


def search(edges: DataFrame, starts: DataFrame, depth: int, mode: str = "downstream", child: str = "OBJ", parent: str = "REFERENCED_OBJECT_NAME") -> DataFrame:
    """``(start, node, hop)``: what each start reaches within ``depth`` hops, at the least hop.

    ``starts`` has a column ``start``. Upstream follows from an object to what it refers to. Names
    are compared in upper case. All starts share each hop's join; a visited pair is never asked
    again, so cycles end. Frontiers are distinct pairs, so a hub node meets each start once. Each
    hop is written once, so the plan of a hop is as long as that of the first, and the search ends
    with the first hop that reaches nothing new.
    """
    a, b = (child, parent) if mode == "upstream" else (parent, child)
    steps = edges.select(F.upper(a).alias("node"), F.upper(b).alias("next")).where("node is not null and next is not null").distinct()
    steps = settled(steps)
    found = starts.select(F.upper("start").alias("start")).where("start is not null").distinct()
    seen = settled(found.select("start", F.col("start").alias("node"), F.lit(0).alias("hop")))
    frontier = seen
    for hop in range(1, depth + 1):
        reached = frontier.join(steps, "node").select("start", F.col("next").alias("node")).distinct()
        frontier = settled(reached.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0")


#: Names of a frontier that are sent to a source at most; a wider one is joined with the whole source.
ASKED_NAMES = 10_000


def search_source(source: DataFrame, starts: DataFrame, depth: int, mode: str = "downstream", child: str = "OBJ", parent: str = "REFERENCED_OBJECT_NAME", asked: int = ASKED_NAMES) -> DataFrame:
    """``search`` over edges that stay in their source: each hop asks it for the frontier's names alone.

    The names, ``asked`` at most, are a filter on the source, which a source with pushdown (a database,
    ``lumenspan_pages``) answers without giving the rest; a wider frontier takes the source as a whole.
    Names must be in upper case in the source. The result is that of ``search``.
    """
    a, b = (child, parent) if mode == "upstream" else (parent, child)
    seen = settled(starts.select(F.upper("start").alias("start")).where("start is not null").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("hop")))
    frontier = seen
    for hop in range(1, depth + 1):
        names = [r.node for r in frontier.select("node").distinct().limit(asked + 1).collect()]
        if not names:
            break
        rows = source.where(F.col(a).isin(names)) if len(names) <= asked else source
        steps = rows.select(F.upper(a).alias("node"), F.upper(b).alias("next")).where("node is not null and next is not null").distinct()
        reached = frontier.join(steps, "node").select("start", F.col("next").alias("node")).distinct()
        frontier = settled(reached.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0")


def roots(edges: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """Parents that are never children; all parents if there is none such."""
    parents = edges.select(F.col(parent).alias("node")).distinct()
    true = parents.join(edges.select(F.col(child).alias("node")).distinct(), "node", "left_anti")
    some = true.agg((F.count("*") == 0).alias("none"))
    return true.union(parents.crossJoin(F.broadcast(some)).where("none").select("node"))


def paths(edges: DataFrame, depth: int, parent: str = "parent", child: str = "child") -> DataFrame:
    """``(path, cycle)`` from each root, up to ``depth`` edges; a node met again ends its path.

    Each level is written once, so the plan of a level is as long as that of the first, and the search
    ends with the first level that has no path. Repeated edges count once; null ends are no edges.
    """
    steps = edges.select(F.col(parent).alias("_from"), F.col(child).alias("_to")).where("_from is not null and _to is not null").distinct()
    steps = settled(steps)
    level = settled(roots(steps, "_from", "_to").select(F.array("node").alias("path"), F.lit(False).alias("cycle")))
    out = level
    for _ in range(depth):
        grown = level.where("not cycle").join(steps, F.element_at("path", -1) == F.col("_from"))
        level = settled(grown.select(F.array_append("path", F.col("_to")).alias("path"), F.array_contains("path", F.col("_to")).alias("cycle")))
        if level.isEmpty():
            break
        out = out.union(level)
    return out


def suggestions(edges: DataFrame, name: str, n: int = LIMITS.suggestions) -> DataFrame:
    """Objects whose names hold the last part of ``name``, the first few in order."""
    part = name.rsplit(".", 1)[-1].upper()
    names = edges.select(F.upper("OBJ").alias("name")).union(edges.select(F.upper("REFERENCED_OBJECT_NAME"))).distinct()
    return names.where(F.col("name").contains(part)).orderBy("name").limit(n)


def provider(edges: DataFrame, starts: DataFrame, depth: int, mode: str = "downstream") -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id, depth)``, roots at 0, each once at its least depth, and edges of roots to nodes."""
    found = search(edges, starts, depth, mode)
    own = starts.select(F.upper("start").alias("id"), F.lit(0).alias("depth"))
    nodes = keep_first(own.union(found.select("node", "hop")), ["id"], "depth")
    ends = ("start", "node") if mode == "downstream" else ("node", "start")
    return nodes, found.select(F.col(ends[0]).alias("source"), F.col(ends[1]).alias("target"), "hop")


def qualified(edges: DataFrame) -> DataFrame:
    """Edges with full names of both ends."""
    return edges.withColumn("name", T.object_name(F.col("DB"), F.col("SCHEMA"), F.col("OBJ"))).withColumn(
        "referenced", T.object_name(F.col("REFERENCED_DATABASE"), F.col("REFERENCED_SCHEMA"), F.col("REFERENCED_OBJECT_NAME"))
    )


def change_lineage(usages: DataFrame, key: str, item: str = "table", operation: str = "operation") -> DataFrame:
    """``(key, item, upstream, downstream)`` of tables that one change creates.

    A table that is read where another is created is its source, if the change creates it too.
    ``usages`` has ``key``, ``file``, ``item`` and the operation; lists are sorted.
    """
    made = usages.where(F.col(operation) == "CREATE").select(key, "file", F.col(item).alias("made")).distinct()
    read = usages.where(F.col(operation) == "READ").select(key, "file", F.col(item).alias("read")).distinct()
    known = made.select(key, F.col("made").alias("read")).distinct()
    pairs = made.join(read, [key, "file"]).where("made <> read").join(known, [key, "read"], "left_semi").select(key, "made", "read").distinct()
    up = pairs.groupBy(key, F.col("made").alias(item)).agg(F.sort_array(F.collect_list("read")).alias("upstream"))
    down = pairs.groupBy(key, F.col("read").alias(item)).agg(F.sort_array(F.collect_list("made")).alias("downstream"))
    none = F.array().cast("array<string>")
    return up.join(down, [key, item], "full").select(key, item, F.coalesce("upstream", none).alias("upstream"), F.coalesce("downstream", none).alias("downstream"))


def enriched(usages: DataFrame, edges: DataFrame, depth: int = 3, item: str = "table") -> DataFrame:
    """Usages with sorted upstream and downstream lists from the dependency snapshot."""
    starts = usages.select(F.col(item).alias("start")).distinct()
    out = usages
    for mode in ("upstream", "downstream"):
        found = search(edges, starts, depth, mode).groupBy("start").agg(F.sort_array(F.collect_set("node")).alias(f"_{mode}"))
        out = out.drop(mode).join(found, F.upper(item) == F.col("start"), "left").withColumn(mode, F.coalesce(f"_{mode}", F.array().cast("array<string>"))).drop("start", f"_{mode}")
    return out


def ordered_once(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The distinct values of each key in the order of their first sight, as a list."""
    first = df.groupBy(key, value).agg(F.min(order).alias("_first"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_first", value))), lambda x: x[value])
    return first.groupBy(key).agg(listed.alias(f"{value}s"))


