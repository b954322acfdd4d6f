"""Which words of a large set texts hold, by Aho-Corasick automata on the executors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lumenspan.functions.workers import ship
from lumenspan.sources.scratch import folder
from lumenspan.sources.sinks import filesystem

#: Characters of the words of one automaton, hits that are held before they are given out.
SHARD_CHARS, HELD = 4_000_000, 65_536


def holds(rows: DataFrame, words: DataFrame, keys: Sequence[str], text: str, word: str, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``(keys, word)``: each row with every distinct word of ``words`` that its text holds, once.

    Words are split by a hash into shards of about ``shard_chars`` characters, written once, and read
    by the tasks: each shard is one pass of its automaton over the texts, which aren't shuffled. A pass
    takes time in proportion to the texts and the places at which words stand. An empty word is in
    every text; null words and texts hold nothing; keys and rows that are repeated stay so.
    """
    spark = rows.sparkSession
    ship(spark)
    known = words.where(F.col(word).isNotNull()).select(F.col(word).cast("string").alias("w")).distinct()
    chars, empty = known.agg(F.coalesce(F.sum(F.char_length("w")), F.lit(0)), F.coalesce(F.max(F.col("w") == ""), F.lit(False))).first()
    shards = -(-chars // shard_chars)
    path = folder(spark)
    if shards:
        split = known.where("w <> ''").select("w", F.pmod(F.xxhash64("w"), F.lit(shards)).cast("int").alias("shard"))
        split.repartition(shards, "shard").write.partitionBy("shard").parquet(path)

    own = rows.where(F.col(text).isNotNull()).select(*keys, F.col(text).cast("string").alias("_text"))
    kinds = own.select(*keys).schema
    out = StructType([*kinds.fields, StructField(word, StringType())])
    found = own.select(*keys, F.lit("").alias(word)).where(F.lit(bool(empty)))
    for n in range(shards):
        found = found.unionByName(own.mapInArrow(_pass(f"{path}/shard={n}", len(keys), word), out))
    return found


def _pass(place: str, n_keys: int, word: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, automaton = _automaton(place)
        for batch in batches:
            at: list[int] = []
            hits: list[str] = []
            for i, text in enumerate(batch.column(n_keys).to_pylist()):
                got = {k for _, k in automaton.iter(text)} if len(automaton) else ()
                at += [i] * len(got)
                hits += [words[k] for k in got]
                if len(at) >= HELD:
                    yield _hits(batch, n_keys, at, hits, word)
                    at, hits = [], []
            if at:
                yield _hits(batch, n_keys, at, hits, word)

    return run


def _hits(batch: pa.RecordBatch, n_keys: int, at: list[int], hits: list[str], word: str) -> pa.RecordBatch:
    rows = batch.select(list(range(n_keys))).take(pa.array(at, pa.int32()))
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(hits, pa.string())], names=[*rows.schema.names, word])


_loaded: dict[str, tuple[list[str], ahocorasick.Automaton]] = {}


def _automaton(place: str) -> tuple[list[str], ahocorasick.Automaton]:
    """The automaton of one shard; a worker holds one at a time."""
    if place not in _loaded:
        _loaded.clear()
        store, at = filesystem(place)
        # A shard without a word has no folder.
        there = store.get_file_info(at).type != store.get_file_info(at).type.NotFound
        words = sorted(pq.read_table(at, filesystem=store, columns=["w"])["w"].to_pylist()) if there else []
        automaton = ahocorasick.Automaton()
        for k, w in enumerate(words):
            automaton.add_word(w, k)
        automaton.make_automaton()
        _loaded[place] = (words, automaton)
    return _loaded[place]
