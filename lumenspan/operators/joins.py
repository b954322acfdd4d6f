"""Joins that the review analyses need, each on an equality key where one exists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenspan.functions.automaton import holds
from lumenspan.operators.running import running
from lumenspan.operators.select import keep_first


def touched(ranges: DataFrame, points: DataFrame, keys: Sequence[str], begin: str, end: str, point: str) -> DataFrame:
    """Rows of ``ranges`` whose interval holds a point of the same key (an interval semi-join).

    Points are numbered in order within their key and both sides meet on that key alone; the two
    running counts of points before begin and up to end tell whether one lies between, so no pair
    of a row and a point is ever made. Only distinct intervals and places go through the window; rows
    meet the intervals that hold a point afterwards. A key of any size is counted in segments. Null keys
    and bounds hold nothing.
    """
    side = ranges.select(*keys, F.col(begin).alias("_b"), F.col(end).alias("_e")).distinct()
    marks = side.select(*keys, "_b", "_e", F.explode(F.array(F.struct(F.col("_b").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("_e").alias("at"), F.lit(2).alias("kind")))).alias("m"))
    marks = marks.select(*keys, F.col("m.at").alias("_at"), F.col("m.kind").alias("_kind"), "_b", "_e", F.lit(0).cast("long").alias("_n"))
    kind = marks.schema["_b"].dataType
    # Points of one place are one row with their number, so a key's window is as long as it has places.
    dots = points.groupBy(*keys, F.col(point).alias("_at")).agg(F.count("*").alias("_n"))
    dots = dots.select(*keys, "_at", F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias("_b"), F.lit(None).cast(marks.schema["_e"].dataType).alias("_e"), "_n")
    counted = running(marks.unionByName(dots), keys, ["_at", "_kind"], {"_upto": F.col("_n")}).where("_kind <> 1")
    pair = counted.groupBy(*keys, "_b", "_e").agg(F.max("_upto").alias("_hi"), F.min("_upto").alias("_lo")).where("_hi > _lo")
    known = pair.select(*keys, F.col("_b").alias(begin), F.col("_e").alias(end))
    return ranges.join(known, [*keys, begin, end], "left_semi").select(ranges.columns)


def changes(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``(keys, change, old, new)``: added, removed, changed or same, nulls compared as values."""
    old = before.select(*keys, F.col(value).alias("old"), F.lit(True).alias("_old"))
    new = after.select(*keys, F.col(value).alias("new"), F.lit(True).alias("_new"))
    kind = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    )
    return old.join(new, list(keys), "full").select(*keys, kind.alias("change"), "old", "new")


def paired(removed: DataFrame, added: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The k-th removed with the k-th added of each key: one-to-one pairs in order."""
    by = Window.partitionBy(*keys).orderBy(order)
    left = removed.select(*keys, F.col(order).alias("old"), F.row_number().over(by).alias("k"))
    right = added.select(*keys, F.col(order).alias("new"), F.row_number().over(by).alias("k"))
    return left.join(right, [*keys, "k"]).select(*keys, "old", "new")


def within(rows: DataFrame, candidates: DataFrame, keys: Sequence[str], text: Column, word: str) -> DataFrame:
    """``(keys, candidate columns)``: each row with every candidate whose word its text holds.

    An automaton of all words goes over each text once, in time that grows with the text and its hits;
    candidates then meet the words that were found by equality. An empty word is in every text that
    isn't null; null words and texts fit nothing.
    """
    found = holds(rows.select(*keys, text.alias("_text")), candidates, keys, "_text", word)
    return found.join(candidates, word)


def first_within(rows: DataFrame, candidates: DataFrame, keys: Sequence[str], text: Column, word: str, order: str) -> DataFrame:
    """Of each row, its first candidate whose word the row's text holds."""
    return keep_first(within(rows, candidates, keys, text, word), keys, order)


def either(rows: DataFrame, conditions: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Rows that any of several tables knows by a column; a semi-join each, never an OR in one."""
    out = None
    for other, column in conditions:
        hit = rows.join(other.select(column).distinct(), column, "left_semi")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()
