"""A prefix trie of conversations by distributed MSD radix partitioning.

Turns are numbered in their conversation, encoded by a dictionary of distinct turns, and a
conversation is its sequence of codes: a row for each turn, never one for a conversation, so a long
conversation isn't in one place. A bucket is all conversations below a node. In each round every
large bucket is taken down the turns that all its conversations share, whose nodes come from one
aggregation by place, and is dealt out by the code that follows. A bucket with no more turns than a
task's fair share is local: one task sorts its sequences by multikey quicksort and emits its nodes
as it goes. A bucket of one conversation is a chain, whose nodes are its rows. The sums of subtrees
go up by rounds.

The conversations that end in a large bucket may be a third of all: they are numbered in segments,
written as chunks of their list, and only the chunks' texts meet, one after another, in the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumenspan.llm import shared
from lumenspan.llm.components import join_unique
from lumenspan.operators.running import numbered, running

#: Conversations of a group, and shared turns of it that one of them may begin with.
GROUP, MOST_SHARED = 20, 3
#: Turns that a local bucket has at most, and may have however small a task's share is.
LOCAL_TURNS, LEAST_LOCAL = 65_536, 256
#: Conversations whose ids are one chunk of a list of ends.
CHUNK = 4096
WORD = r"[^\x20\x09-\x0D]+"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_NODE = "conv long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved long, ends string"


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, pos, code, words)``: every turn with its place, from 1, and its dictionary code."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("at"), text(role_col).alias("role"), text(text_col).alias("text"))
    # Two texts are one string with the first one's length before it.
    whole = F.concat_ws(":", F.char_length("role").cast("string"), "role", "text")
    words = F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long")
    keyed = own.select("conv", "at", F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"), words.alias("words"))
    # Turns of one place stand in the order of their digests: equal ones are equal anyway.
    placed = shared.cut(numbered(keyed, ["conv"], ["at", "digest"], "pos"), "placed-turns")
    codes = shared.cut(placed.groupBy("digest").agg(F.count("*").alias("n")).withColumn("code", F.monotonically_increasing_id()), "turn-codes")
    return shared.cut(join_unique(placed, codes, "digest").select("conv", "pos", "code", "words"), "turns")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv, pos, code, words, len)`` of the rebuilt conversations, and ``(conv, len)`` of all of them.

    A conversation begins with the first ``h`` turns of the first of its group and goes on with its
    own after its first ``h``.
    """
    sizes = own.groupBy("conv").agg(F.max("pos").alias("size"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_SHARED + 1)).alias("h")
    lead = sizes.select("conv", "size", h, (F.col("conv") - F.col("conv") % GROUP).alias("base"))
    bases = sizes.select(F.col("conv").alias("base"), F.least("size", F.lit(MOST_SHARED)).alias("has"))
    lead = lead.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0))))
    lead = shared.cut(lead.select("conv", "size", "h", "base", "taken", (F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("len")), "leads")
    tail = join_unique(own, lead.select("conv", "h", "taken", "len", F.col("size").alias("n")), "conv").where("pos > h")
    tail = tail.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "code", "words", "len")
    first = own.where(F.col("pos") <= MOST_SHARED).select(F.col("conv").alias("base"), "pos", "code", "words")
    head = lead.where("taken > 0").join(first, "base").where("pos <= taken").select("conv", "pos", "code", "words", "len")
    return shared.cut(tail.unionByName(head), "rebuilt-turns"), lead.select("conv", "len")


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", local_turns: int | None = None) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations, the root of none included.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (root: null), ``n_convs`` (members),
    ``n_children``, ``n_leaves`` (nodes without children in the subtree), ``saved_tokens`` (words of
    each node's last text for every member but one, summed over the subtree) and ``ends_sha256`` (of
    the ids of the members that end there, ascending, joined by commas).

    Turns go by ``turn``, null ones first, equal ones by the digests of role and text. Null roles and
    texts are empty; rows without a conversation belong to none and are left out; repeated rows are
    turns each. Very long texts and conversations are taken whole; further columns aren't read. An
    empty table has no conversation and gives no rows. ``local_turns`` sets the size of a local bucket.
    """
    spark = conversations.sparkSession
    rows, convs = rebuilt(turns(conversations, conv_col, turn_col, role_col, text_col))
    n_rows, (n_convs, least) = rows.count(), convs.agg(F.count("*"), F.min("conv")).first()
    if local_turns is None:
        local_turns = min(LOCAL_TURNS, max(LEAST_LOCAL, n_rows // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # A bucket is named by its first node: its smallest member and its depth.
    root = spark.range(1 if n_convs else 0).select(F.lit(least).alias("bucket"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(n_convs).alias("members"))
    now, buckets = rows.select(F.lit(least).alias("bucket"), F.lit(0).cast("long").alias("depth"), "conv", "pos", "code", "words", "len"), root
    rounds: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    small: list[DataFrame] = []
    while True:
        buckets, shared_turns, ends, children, rest = _round(now, buckets, convs if not rounds else None, least, local_turns, len(rounds))
        rounds.append((buckets, shared_turns, ends))
        if children is None:
            break
        small.append(rest.where("kind < 2"))
        buckets = children.where("kind = 2").select(F.col("child").alias("bucket"), F.col("child_depth").alias("depth"), F.col("bucket").alias("parent"), "members")
        now = rest.where("kind = 2").drop("kind", "parent")
        if buckets.isEmpty():
            break
    done = shared.cut(_finished(small, spark), "local-nodes") if small else None
    out = [_from_local(done)] if done is not None else []
    # Upwards: a bucket's leaves and savings are its own and those of the buckets below it.
    below = _totals_of_local(done) if done is not None else None
    for buckets, shared_turns, ends in reversed(rounds):
        nodes, below = _with_sums(buckets, shared_turns, ends, below)
        out.append(nodes)
    whole = out[0]
    for other in out[1:]:
        whole = whole.unionByName(other)
    return whole.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def _key(bucket: str = "bucket", depth: str = "depth") -> Column:
    return F.struct(F.col(bucket).alias("b"), F.col(depth).alias("d"))


def _round(now: DataFrame, buckets: DataFrame, convs: DataFrame | None, least: int | None, local_turns: int, n: int):
    """One level of large buckets: ``(buckets, shared turns, ends, children, their turns)``; no children where all end.

    ``now`` are the turns of each bucket's conversations from the bucket's first node on.
    """
    by_place = now.groupBy("bucket", "depth", "pos").agg(
        F.count("*").alias("n"), F.min("code").alias("low"), F.max("code").alias("high"), F.max("words").alias("words")
    )
    places = shared.cut(by_place.join(buckets, ["bucket", "depth"]).withColumn("all", (F.col("n") == F.col("members")) & (F.col("low") == F.col("high"))), f"places-{n}")
    first_apart = F.min(F.when(~F.col("all"), F.col("pos")))
    bottoms = places.groupBy("bucket", "depth").agg(F.coalesce(first_apart - 1, F.max("pos")).alias("bottom"), F.sum("n").alias("n"))
    # A root whose conversations are all without turns has no place.
    bottoms = shared.cut(buckets.join(bottoms, ["bucket", "depth"], "left").select(_key().alias("key"), "bucket", "depth", "parent", "members", F.coalesce("bottom", F.lit(0)).alias("bottom"), F.coalesce("n", F.lit(0)).alias("n")), f"buckets-{n}")
    shared_turns = places.join(bottoms.select("bucket", "depth", "bottom"), ["bucket", "depth"]).where("pos <= bottom").select("bucket", "depth", "pos", F.col("words"))
    held = shared.cut(join_unique(now.withColumn("key", _key()), bottoms.select("key", "bottom", "n"), "key").where("pos >= bottom").drop("key"), f"turns-{n}")
    ended = held.where("pos = bottom and len = bottom").select("bucket", "depth", "conv")
    if convs is not None:  # those without turns end at the root
        ended = ended.unionByName(convs.where("len = 0").select(F.lit(least).alias("bucket"), F.lit(0).cast("long").alias("depth"), "conv"))
    ends = _digests(ended)
    open_ = held.where("pos > bottom")
    next_turns = open_.where("pos = bottom + 1")
    children = next_turns.groupBy("bucket", "depth", "bottom", "code").agg(
        F.min("conv").alias("child"), F.count("*").alias("members"), F.sum(F.col("len") - F.col("bottom")).alias("turns")
    )
    kind = F.when(F.col("members") == 1, 0).when(F.col("turns") <= local_turns, 1).otherwise(2)
    children = shared.cut(children.select("bucket", "depth", "code", "child", (F.col("bottom") + 1).alias("child_depth"), "members", kind.alias("kind")), f"children-{n}")
    if children.isEmpty():
        return bottoms, shared_turns, ends, None, None
    # Each conversation learns its new bucket at the turn that tells it, and then all its turns do.
    told = next_turns.select("conv", F.struct("bucket", "depth", "code").alias("key"), (F.col("len") - F.col("bottom")).alias("n"))
    named = children.select(F.struct("bucket", "depth", "code").alias("key"), "child", "child_depth", F.col("bucket").alias("parent"), "kind", F.col("members").alias("n"))
    moved = shared.cut(join_unique(told.withColumnRenamed("n", "turns"), named, "key").select("conv", "child", "child_depth", "parent", "kind", F.col("turns").alias("n")), f"moves-{n}")
    rest = join_unique(open_.drop("bucket", "depth", "bottom"), moved, "conv")
    rest = rest.select(F.col("child").alias("bucket"), F.col("child_depth").alias("depth"), "parent", "kind", "conv", "pos", "code", "words", "len")
    return bottoms, shared_turns, ends, children, shared.cut(rest, f"dealt-{n}")


def _digests(ended: DataFrame) -> DataFrame:
    """``(bucket, depth, ends, n_ends)``: the digest of the ids that end in each bucket."""
    placed = numbered(ended, ["bucket", "depth"], ["conv"], "n")
    chunk = ((F.col("n") - 1) / CHUNK).cast("long").alias("chunk")
    texts = placed.groupBy("bucket", "depth", chunk).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"), F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, state, total, out = None, None, 0, []
        for batch in batches:
            for bucket, depth, _, ids, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, depth) != names:
                    if state is not None:
                        out.append((*names, state.hexdigest(), total))
                    names, state, total = (bucket, depth), hashlib.sha256(), 0
                else:
                    state.update(b",")
                state.update(ids.encode())
                total += n
            if out:
                yield _batch(out, ("bucket", "depth", "ends", "n_ends"))
                out = []
        if state is not None:
            yield _batch([(*names, state.hexdigest(), total)], ("bucket", "depth", "ends", "n_ends"))

    dealt = texts.repartition("bucket", "depth").sortWithinPartitions("bucket", "depth", "chunk")
    return shared.arrow(dealt, run, "bucket long, depth long, ends string, n_ends long")


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])


def _finished(small: list[DataFrame], spark) -> DataFrame:
    """Nodes of all buckets that are no longer large, with their bucket's name."""
    rows = small[0]
    for other in small[1:]:
        rows = rows.unionByName(other)
    alone, local = rows.where("kind = 0"), rows.where("kind = 1").drop("kind", "len")
    last = F.col("pos") == F.col("len")
    chains = alone.select(
        "bucket", F.col("depth").alias("top"), F.col("parent").alias("above"), F.col("conv"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("depth"), F.col("parent")).otherwise(F.col("conv")).alias("parent"),
        F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"),
        F.when(last, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).alias("ends"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            b, d = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = np.flatnonzero((b[1:] != b[:-1]) | (d[1:] != d[:-1])) + 1
            for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True):
                part = batch.slice(a, e - a)
                if held and (held[0].column(0)[0] != part.column(0)[0] or held[0].column(1)[0] != part.column(1)[0]):
                    yield _sorted_bucket(pa.concat_batches(held))
                    held = []
                held.append(part)
        if held:
            yield _sorted_bucket(pa.concat_batches(held))

    columns = ["bucket", "depth", "parent", "conv", "pos", "code", "words"]
    dealt = local.select(*columns).repartition("bucket", "depth").sortWithinPartitions("bucket", "depth", "conv", "pos")
    return chains.unionByName(shared.arrow(dealt, run, f"bucket long, top long, above long, {_NODE}"))


def _sorted_bucket(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Nodes of one local bucket, whose rows stand by conversation and place."""
    bucket, top, above = (rows.column(i)[0].as_py() for i in range(3))
    convs, codes, words = (rows.column(i).to_numpy() for i in (3, 5, 6))
    starts = np.flatnonzero(np.append(True, convs[1:] != convs[:-1]))
    begin, end = starts.tolist(), [*starts[1:].tolist(), len(convs)]
    nodes = multikey(convs[starts].tolist(), [codes[a:b] for a, b in zip(begin, end, strict=True)], [words[a:b] for a, b in zip(begin, end, strict=True)], top, above)
    names = ("conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends")
    out = {"bucket": [bucket] * len(nodes), "top": [top] * len(nodes), "above": [above] * len(nodes)} | {n: [x[i] for x in nodes] for i, n in enumerate(names)}
    kinds = {n: pa.int64() for n in out} | {"ends": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[n]) for n, v in out.items()], names=list(out))


def multikey(convs: list[int], codes: list[np.ndarray], words: list[np.ndarray], top: int, above: int) -> list[list]:
    """Nodes of sequences that share their first code, by multikey quicksort.

    Each call splits sequences by the code at one place into less, equal and more than a pivot; the
    equal ones are a node and go on at the next place. Calls wait on a stack. A node's sums get those
    of its children once these are all known, in reverse order of their making.
    """
    nodes: list[list] = []
    up: list[int] = []
    # (members, place, node above); convs are in ascending order, and splits keep it.
    stack: list[tuple[np.ndarray, int, int]] = [(np.arange(len(convs)), 0, -1)]
    lengths = np.array([len(c) for c in codes])
    while stack:
        own, at, parent = stack.pop()
        here = np.array([codes[i][at] for i in own])
        pivot = here[len(here) // 2]
        less, more, same = own[here < pivot], own[here > pivot], own[here == pivot]
        stack += [(part, at, parent) for part in (less, more) if len(part)]
        ends, on = same[lengths[same] == at + 1], same[lengths[same] > at + 1]
        digest = hashlib.sha256(",".join(str(convs[i]) for i in ends).encode()).hexdigest() if len(ends) else None
        saved = (len(same) - 1) * int(words[same[0]][at])
        nodes.append([convs[same[0]], top + at, above if parent < 0 else nodes[parent][0], len(same), 0, 0, saved, digest])
        up.append(parent)
        if parent >= 0:
            nodes[parent][4] += 1
        if len(on):
            stack.append((on, at + 1, len(nodes) - 1))
    for i in range(len(nodes) - 1, -1, -1):
        nodes[i][5] += not nodes[i][4]
        if up[i] >= 0:
            nodes[up[i]][5] += nodes[i][5]
            nodes[up[i]][6] += nodes[i][6]
    return nodes


def _from_local(done: DataFrame) -> DataFrame:
    return done.select("conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends")


def _totals_of_local(done: DataFrame) -> DataFrame:
    """``(above, top, n_leaves, saved)`` of the first node of each bucket."""
    return done.where("depth = top").select("above", "top", "n_leaves", "saved")


def _with_sums(buckets: DataFrame, shared_turns: DataFrame, ends: DataFrame, below: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Nodes of one round's buckets, and the totals of all buckets known so far for those above."""
    if below is None:
        below = buckets.sparkSession.createDataFrame([], "above long, top long, n_leaves long, saved long")
    # A bucket's children begin one below its bottom; one smallest member and bottom name one bucket.
    sums = below.groupBy("above", "top").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("kept"))
    known = buckets.join(sums, (F.col("bucket") == F.col("above")) & (F.col("bottom") + 1 == F.col("top")), "left").join(ends, ["bucket", "depth"], "left")
    known = known.select(
        "bucket", "depth", "parent", "members", "bottom", F.coalesce("kids", F.lit(0)).alias("kids"),
        F.when(F.coalesce("kids", F.lit(0)) == 0, 1).otherwise(F.col("leaves")).alias("leaves"), F.coalesce("kept", F.lit(0)).alias("kept"), "ends",
    )
    root = buckets.where("depth = 0").select("bucket", "depth", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("words"))
    chain = shared_turns.unionByName(root).withColumn("up", -F.col("pos"))
    chain = running(chain.join(known, ["bucket", "depth"]), ["bucket", "depth"], ["up"], {"own": F.col("words") * (F.col("members") - 1)})
    at_bottom = F.col("pos") == F.col("bottom")
    nodes = shared.cut(
        chain.select(
            F.col("bucket").alias("conv"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("depth"), F.col("parent")).otherwise(F.col("bucket")).alias("parent"),
            F.col("members").alias("n_convs"), F.when(at_bottom, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").cast("long").alias("n_leaves"),
            (F.col("own") + F.col("kept")).cast("long").alias("saved"), F.when(at_bottom, F.col("ends")).alias("ends"), F.col("depth").alias("top"),
        ),
        "bucket-nodes",
    )
    tops = nodes.where("depth = top and depth > 0").select(F.col("parent").alias("above"), "top", "n_leaves", "saved")
    return nodes.drop("top"), below.unionByName(tops)


#: Prefixes as lists of digests; CRC-32 by its table of 256 values, which is built from the polynomial.
ORACLE = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END)) AS t),
turns AS (
  SELECT conv_id AS c, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS digest,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
words AS (SELECT digest, max(words) AS words FROM turns GROUP BY digest),
own AS (SELECT c, list(digest ORDER BY turn NULLS FIRST, digest) AS own FROM turns GROUP BY c),
hashed AS (
  SELECT c, own, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 4 AS h
  FROM own, crc_table),
rebuilt AS (
  SELECT x.c, list_concat(coalesce(b.own[1:x.h], []::VARCHAR[]), x.own[x.h + 1:]) AS seq
  FROM hashed x LEFT JOIN own b ON b.c = x.c - x.c % 20),
prefixes AS (SELECT c, len(seq) AS n, unnest(range(0, len(seq) + 1)) AS d, seq FROM rebuilt),
nodes AS (
  SELECT seq[1:d] AS p, d, min(c) AS conv, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends
  FROM prefixes GROUP BY ALL),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
valued AS (
  SELECT n.*, u.conv AS parent, coalesce(k.n, 0) AS n_children, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf, (n.n_convs - 1) * coalesce(w.words, 0) AS own
  FROM nodes n LEFT JOIN kids k ON n.p = k.p AND n.d = k.d LEFT JOIN words w ON n.p[n.d] = w.digest
    LEFT JOIN nodes u ON n.d > 0 AND u.d = n.d - 1 AND u.p = n.p[1:n.d - 1]),
upward AS (SELECT v.p[1:a] AS p, a AS d, sum(leaf) AS leaves, sum(own) AS saved FROM valued v, unnest(range(0, v.d + 1)) r(a) GROUP BY ALL)
SELECT v.conv AS conv_id, v.d AS depth, v.parent AS parent_conv_id, v.n_convs, v.n_children, u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens,
  sha256(v.ends) AS ends_sha256
FROM valued v JOIN upward u ON v.p = u.p AND v.d = u.d
"""
