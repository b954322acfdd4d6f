"""Connected components of an edge table, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumenspan.llm import shared


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``edges``; ``root`` is the least node of its component.

    Large-star and small-star steps alternate until the edges no longer change, which takes
    about the logarithm of the longest path. Each step keeps at most as many edges as there
    were. Minimum and distinct are combined before they are shuffled, and in the joins the side
    with one row for each node may meet a split partition, so a hub is not a hot key. Each round
    is written to the shared folder, so lineage stays one round long.

    Null ends, loops and repeated edges are dropped. Nodes may be of any type with an order.
    """
    spark = edges.sparkSession
    now = _written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    while now[2][0]:
        u, v = F.col("u"), F.col("v")
        both = now[1].union(now[1].select(v, u)).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = _written(small.union(lowest.select("u", F.col("m").alias("v"))).distinct())
        shared.drop(spark, now[0])
        done = new[2] == now[2]
        now = new
        if done:
            break
    stars = now[1]
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


#: A key with more than one in so many rows is joined by a broadcast; there are fewer such keys than this.
HOT_SHARE = 200


def join_unique(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``table`` but ``n``, of which each key has one row.

    ``n`` is the number of rows of the key. Keys with more than 1 / ``HOT_SHARE`` of all rows are fewer
    than ``HOT_SHARE``: they are broadcast, so no task gets more than such a share of one key. Both
    tables are read twice and should be written ones. Keys that ``table`` doesn't have, null ones
    among them, are left out.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = table.where(F.col("n") * F.lit(HOT_SHARE) > total).limit(HOT_SHARE)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.drop("n"), key)
    return rest.unionByName(rows.join(F.broadcast(hot.drop("n")), key))


def _written(edges: DataFrame) -> tuple[str, DataFrame, tuple]:
    path = shared.scratch(edges.sparkSession, "edges")
    edges.write.parquet(path)
    back = edges.sparkSession.read.schema(edges.schema).parquet(path)
    mark = back.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
    return path, back, tuple(mark)
