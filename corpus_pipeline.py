"""A training corpus from raw documents: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenspan.functions.workers import spread
from lumenspan.llm import decontam, langid, lines, pieces, shared, simhash

#: Least score of a predicted language; words of a shingle and bits that near copies may differ in.
LEAST_SCORE, SHINGLE_WORDS, MOST_BITS = 0.5, 5, 4
#: Share of their shingles that is the same in texts that are near copies, however many bits they differ in.
LEAST_SIMILAR = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language isn't told with enough certainty, go.

    So do null and empty texts. A null ``lang`` becomes the predicted one; ties go to the first
    language by name. Very long texts are scored whole, repeated rows share their fate, further columns
    are kept, and an empty table stays empty.
    """
    return langid.accepted(docs, langid.train(docs), least=LEAST_SCORE)


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many pages of a source are cut out of all texts; near-equal pages count once.

    A text of such lines alone becomes empty, a null text stays null; a null source is one source; a
    line exactly at the ratio stays. Very long texts are taken whole, repeated rows stay repeated and
    count once, further columns are kept, and an empty table stays empty.
    """
    return lines.drop_boilerplate(docs, "source", "text", "n_chars", near_words=SHINGLE_WORDS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Null and empty texts are one group. Null ids come last; of equal ids the least hash of the whole
    row stays, and one of rows that are equal in all. Very long texts are taken whole, further columns
    are kept, and an empty table stays empty.
    """
    return simhash.keep_one(docs, words=SHINGLE_WORDS, max_diff=MOST_BITS, least=LEAST_SIMILAR)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words one in twenty or more lies in a benchmark passage go.

    Null and empty texts stay, and all rows do if the benchmark is empty. Very long texts are searched
    whole, repeated rows share their fate, further columns are kept, and an empty table stays empty.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and whether they decode to it again.

    A null text has null ids and tokens and comes back as null; an empty one has no ids. Of equally
    good segmentations the first is taken. Very long texts are encoded whole, repeated rows stay
    repeated, further columns aren't read, and an empty table stays empty.
    """
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.encode(docs.select("doc_id", "lang", "source", "text"), model, decoded_col="decoded")
    same = F.col("text").eqNullSafe(F.col("decoded"))
    return both.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("line dedup", boilerplate),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", contamination),
    ("SentencePiece encoding and decoding", encoding),
]

#: SQL can't express the kernels, fingerprints and segmentations of these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for n, (_, stage) in enumerate(STAGES[:-1]):
        with shared.scope(spark):  # what a stage wrote for itself goes, and what it read of the stage before
            docs = shared.cut(stage(spark, docs, sf_dir), f"stage-{n + 1}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
