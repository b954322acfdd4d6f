"""Groups of review comments that say the same."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenspan.functions.workers import ship
from lumenspan.operators.select import top_n
from lumenspan.sources.scratch import settled

# Phrases that mark one issue, thresholds of likeness, words of an equal beginning.
CLUSTERS = (
    ("create or replace table",), ("drop table",), ("truncate table",), ("breaking change", "downstream"), ("breaking change", "consumers"),
    ("data loss", "downstream"),
)
NORMALISED, RAW, LEAD = 0.72, 0.75, 8


def normalised(text: str) -> str:
    text = re.sub(r"\b[A-Z][A-Z0-9]*(?:\.[A-Z][A-Z0-9_]*)+\b", "", text)
    text = re.sub(r"\b[A-Z][A-Z0-9_]{3,}\b", "", text)
    return " ".join(re.sub(r"\b\d+\b", "N", text).lower().split())


class _Comment:
    def __init__(self, text: str) -> None:
        self.text, self.plain, self.lead = text, normalised(text), tuple(text.split()[:LEAD])
        low = text.lower()
        self.issues = {i for i, words in enumerate(CLUSTERS) if all(w in low for w in words)}

    def like(self, other: _Comment) -> bool:
        return self.lead == other.lead or bool(self.issues & other.issues) or _ratio(self.plain, other.plain, NORMALISED) or _ratio(self.text, other.text, RAW)


def _ratio(a: str, b: str, least: float) -> bool:
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


class Leaders:
    """Comments in order of which none is like an earlier one; equal beginnings and shared issues are looked up."""

    def __init__(self) -> None:
        self.made: list[_Comment] = []
        self.by_lead: dict[tuple, int] = {}
        self.by_issue: dict[int, int] = {}

    def first(self, c: _Comment) -> int | None:
        """The place of the first leader that a comment is like."""
        n = len(self.made)
        known = min([self.by_lead.get(c.lead, n), *(self.by_issue.get(i, n) for i in c.issues)])
        return next((k for k in range(known) if c.like(self.made[k])), known if known < n else None)

    def add(self, c: _Comment) -> int:
        n = len(self.made)
        self.made.append(c)
        self.by_lead.setdefault(c.lead, n)
        for i in c.issues:
            self.by_issue.setdefault(i, n)
        return n


def leaders(comments: list[str]) -> list[int]:
    """For each comment the place of its leader: the first one that it is like, itself if none."""
    known, place, out = Leaders(), [], []
    for n, text in enumerate(comments):
        c = _Comment(text or "")
        k = known.first(c)
        if k is None:
            known.add(c)
            place.append(n)
        out.append(n if k is None else place[k])
    return out


#: Comments of a group that one task takes; a larger group goes in rounds of so many of its first ones.
GROUP, ROUND = 2_000, 500
#: Comments that meet a round's leaders in one task.
PART = 4_096
_KEY = ["review_id", "severity", "category"]


def _batch(rows: list[tuple], names: str, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names.split())


def _led(rows: DataFrame, key: str) -> DataFrame:
    """``(uid, leader)``: of each row of a group, whose rows meet in one task, the ``uid`` of its leader."""

    def one(group: list[tuple]) -> Iterator[tuple]:
        first = leaders([r[2] or "" for r in group])
        return ((group[n][1], group[k][1]) for n, k in enumerate(first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found = (x for _, group in groupby(rows, key=lambda r: r[0]) for x in one(list(group)))
        while part := list(islice(found, 4096)):
            yield _batch(part, "uid leader", [pa.int64(), pa.int64()])

    # Groups are many and small: a task goes through its sorted rows instead of calling Python for each.
    sorted_ = rows.select(key, "ord", "uid", "comment").repartition(key).sortWithinPartitions(key, "ord", "uid")
    return sorted_.select(key, "uid", "comment").mapInArrow(run, "uid long, leader long")


def _follows(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """``(uid, leader)`` of rows: the first of the leaders of their ``gid`` and ``salt`` that each is like, else null."""

    def one(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values(["ord", "uid"])
        names, made = known.uid.tolist(), Leaders()
        for text in known.comment:
            made.add(_Comment(text or ""))
        first = [made.first(_Comment(text or "")) for text in own.comment]
        return pd.DataFrame({"uid": own.uid, "leader": pd.array([None if k is None else names[k] for k in first], "Int64")})

    return rows.groupBy("gid", "salt").cogroup(heads.groupBy("gid", "salt")).applyInPandas(one, "uid long, leader long")


def _in_rounds(rows: DataFrame, first: int) -> DataFrame:
    """``(uid, leader)`` of groups of any size.

    A round takes the first undecided comments of each group and finds the leaders among them in one
    task; all later ones then look for theirs among these leaders, ``PART`` of them in a task. A comment meets
    leaders in their order, so the first that it is like is the one that it would have met in one go.
    """
    decided: list[DataFrame] = []
    undecided = rows
    while True:
        head = settled(top_n(undecided, ["gid"], first, "ord", "uid"))
        led = settled(_led(head, "gid"))
        decided.append(led)
        rest = undecided.join(head.select("uid"), "uid", "left_anti")
        heads = led.where("uid = leader").select("uid").join(head.select("uid", "gid", "ord", "comment", "salts"), "uid")
        heads = heads.select("gid", "ord", "uid", "comment", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        salt = F.pmod(F.xxhash64("uid"), F.col("salts")).cast("int").alias("salt")
        told = settled(_follows(rest.select("gid", salt, "uid", "comment"), heads))
        decided.append(told.where("leader is not null"))
        undecided = settled(undecided.join(told.where("leader is null").select("uid"), "uid"))
        if undecided.isEmpty():
            break
    out = decided[0]
    for other in decided[1:]:
        out = out.unionByName(other)
    return out


def group_similar(comments: DataFrame, group: int = GROUP, first: int = ROUND) -> DataFrame:
    """``(review_id, ord, leader, also)`` of comments; only those of one review, severity and category meet.

    A comment's leader is the first one, by ``ord``, that it is like and that is like none before it.
    ``also`` names the other places of a leader's group in order. Groups of over ``group`` comments are
    compared by many tasks, in rounds of ``first``; the result is the same. Null comments are empty.
    """
    ship(comments.sparkSession)
    keyed = comments.select(
        "review_id", F.lower("severity").alias("severity"), F.coalesce("category", F.lit("")).alias("category"), F.col("ord").cast("int").alias("ord"), "file", "line_range", "comment"
    )
    rows = settled(keyed.withColumns({"gid": F.to_json(F.struct(*_KEY)), "uid": F.monotonically_increasing_id()}))
    sizes = rows.groupBy("gid").agg(F.count("*").alias("n")).where(F.col("n") > group)
    large = settled(sizes.select("gid", F.ceil(F.col("n") / PART).cast("int").alias("salts")))
    if large.isEmpty():
        found = _led(rows, "gid")
    else:
        found = _led(rows.join(large, "gid", "left_anti"), "gid").unionByName(_in_rounds(settled(rows.join(large, "gid").select("gid", "uid", "ord", "comment", "salts")), first))
    found = settled(found)
    place = F.when(F.coalesce("line_range", F.lit("")) != "", F.concat_ws(":", "file", "line_range")).otherwise(F.coalesce("file", F.lit("")))
    named = rows.select("uid", "review_id", "ord", place.alias("place"))
    both = found.join(named, "uid").join(named.select(F.col("uid").alias("leader"), F.col("ord").alias("_lead")), "leader")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "uid", "place"))), lambda x: x["place"])
    also = both.where("uid <> leader").groupBy(F.col("leader").alias("uid")).agg(listed.alias("also"))
    return both.join(also, "uid", "left").select("review_id", "ord", F.col("_lead").alias("leader"), F.coalesce("also", F.array().cast("array<string>")).alias("also"))


def merged(comments: DataFrame) -> DataFrame:
    """The leaders, with what else they affect noted in the suggestion."""
    found = group_similar(comments).where("ord = leader").select("review_id", "ord", "also")
    note = F.concat(F.lit("Also affects "), F.size("also").cast("string"), F.lit(" more file(s): "), F.array_join("also", ", "))
    rows = comments.join(found, ["review_id", "ord"])
    text = F.when(F.size("also") == 0, F.col("suggestion")).otherwise(F.concat_ws(" | ", F.nullif("suggestion", F.lit("")), note))
    return rows.withColumn("suggestion", text).drop("also")
