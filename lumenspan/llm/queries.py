"""The corpus operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenspan.functions.workers import spread
from lumenspan.llm import counts, decontam, filters, langid, lines, maintext, pieces, pq, shared, simhash, tokens, tries, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table, in as many partitions as there are tasks at once: what follows works hard on each row."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, max_diff=4)


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars")
    out = lines.drop_boilerplate(docs, length_col="n_chars", dropped_col="n_dropped")
    return out.withColumn("n_chars", F.col("n_chars").cast("long"))


def op3_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return pq.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95, all_widths=True)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, read back from token files."""
    docs = _table(spark, sf_dir, "documents")
    manifest = tokens.write_tokens(docs, shared.scratch(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokens.read_tokens(manifest)


def op5_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return maintext.extract(_table(spark, sf_dir, "pages"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded in pieces and decoded again."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), model, decoded_col="decoded")
    same = F.col("text").eqNullSafe(F.col("decoded"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), same.alias("round_trip"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the benchmark matches in every document."""
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a response and a later revisit in WARC files, read back and resolved."""
    files = warc.write_warc(warc.captures(_table(spark, sf_dir, "pages")), shared.scratch(spark, "warc"))
    found = warc.resolve_revisits(warc.read_warc(files))
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+):", 1).try_cast("long")
    headers = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "; ")
    return found.select(
        page("record_id").alias("page_id"), "canonical", "outcome", page("response_id").alias("response_page"), headers.alias("headers")
    )


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return urls.judge(_table(spark, sf_dir, "pages"), urls.RULES)


def op11_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has too many."""
    return counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from the documents of each language, in every order."""
    return filters.audit(_table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations."""
    return tries.trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_lines": op2_lines,
    "op3_pq": op3_pq,
    "op4_tokens": op4_tokens,
    "op5_maintext": op5_maintext,
    "op6_pieces": op6_pieces,
    "op7_decontam": op7_decontam,
    "op8_warc": op8_warc,
    "op9_langid": op9_langid,
    "op10_urls": op10_urls,
    "op11_counts": op11_counts,
    "op12_filters": op12_filters,
    "op13_trie": op13_trie,
}

ORACLES: dict[str, str] = {
    "op2_lines": lines.ORACLE,
    "op8_warc": warc.ORACLE,
    "op10_urls": urls.ORACLE,
    "op12_filters": filters.ORACLE,
    "op13_trie": tries.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
