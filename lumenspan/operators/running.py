"""Running values over keys of any size: segments of the order, and what each takes over.

A window over a key is one task, however many rows the key has. Here rows are dealt out by ranges
of key and order, so a key with a third of all rows lies in as many segments as its share; each
segment is run through alone, and what came before it in its key is added. Only a key that goes on
from an earlier segment takes something over, at most one in each segment, so what is taken over
has no more rows than there are segments and is broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenspan.sources.scratch import settled

_UPTO, _BEFORE = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    before: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """``df`` with running ``sums`` and last values that aren't null (``lasts``) of each key in ascending ``order``.

    A row counts itself, or with ``before`` only the rows before it. Sums begin at 0 and skip nulls.
    Null keys are one key; null places come first; rows of one key and place may stand in any order, so
    give an order that tells rows apart where it matters. Writes ``df``, all its columns, once in
    ``partitions`` ranges (by default as many as the session shuffles to).
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    frame = _BEFORE if before else _UPTO
    places = [*keys, *order]
    held = df.withColumns({f"__of_{n}": c for n, c in {**sums, **lasts}.items()})
    ranged = held.repartitionByRange(partitions, *places) if partitions else held.repartitionByRange(*places)
    dealt = settled(ranged.withColumn("__segment", F.spark_partition_id()))

    own = Window.partitionBy("__segment", *keys).orderBy(*order).rowsBetween(*frame)
    here = {n: F.coalesce(F.sum(f"__of_{n}").over(own), F.lit(0)) for n in sums} | {n: F.last(f"__of_{n}", True).over(own) for n in lasts}
    local = dealt.withColumns({f"__in_{n}": c for n, c in here.items()})

    at = F.struct(*order)
    whole = [F.sum(f"__of_{n}").alias(f"__to_{n}") for n in sums] + [F.max_by(f"__of_{n}", F.when(F.col(f"__of_{n}").isNotNull(), at)).alias(f"__to_{n}") for n in lasts]
    totals = dealt.groupBy("__segment", *keys).agg(*whole, F.lit(True).alias("__own"))
    earlier = Window.partitionBy(*keys).orderBy("__segment").rowsBetween(*_BEFORE)
    over = {n: F.sum(f"__to_{n}").over(earlier) for n in sums} | {n: F.last(f"__to_{n}", True).over(earlier) for n in lasts}
    carried = totals.select("*", *[c.alias(f"__up_{n}") for n, c in over.items()], F.lag("__own").over(Window.partitionBy(*keys).orderBy("__segment")).alias("__goes_on"))
    carried = carried.where("__goes_on").select(F.col("__segment").alias("__at"), *[F.col(k).alias(f"__by_{k}") for k in keys], *[f"__up_{n}" for n in over])

    same = F.col("__segment") == F.col("__at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__by_{k}"))
    both = local.join(F.broadcast(carried), same, "left")
    out = {n: F.col(f"__in_{n}") + F.coalesce(F.col(f"__up_{n}"), F.lit(0)) for n in sums} | {n: F.coalesce(F.col(f"__in_{n}"), F.col(f"__up_{n}")) for n in lasts}
    return both.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def windowed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    before: bool = False,
) -> DataFrame:
    """The same by a window over each key: lazy and without a write, for keys that fit a task."""
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*(_BEFORE if before else _UPTO))
    summed = {n: F.coalesce(F.sum(c).over(by), F.lit(0)) for n, c in (sums or {}).items()}
    return df.select(*df.columns, *[c.alias(n) for n, c in summed.items()], *[F.last(c, True).over(by).alias(n) for n, c in (lasts or {}).items()])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "n", partitions: int | None = None) -> DataFrame:
    """``df`` with each row's number within its key, from 1, in ascending ``order``."""
    return running(df, keys, order, {name: F.lit(1).cast("long")}, partitions=partitions)
