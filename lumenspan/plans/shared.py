"""Registry of queries and helpers that several plans use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenspan.functions.workers import spread
from lumenspan.operators import lines, rules

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that it must equal."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, in as many partitions as there are tasks at once: their texts are scanned."""
    return spread(table(spark, sf_dir, "documents"))


def severity(priority: str = "o_orderpriority") -> Column:
    """An order's priority in the role of a severity."""
    n = F.substring(priority, 1, 1)
    return F.when(n == "1", "critical").when(n == "2", "high").when(n == "3", "medium").otherwise("low")


SEVERITY_SQL = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END"


def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return rules.scan(lines.explode_lines(docs, "text", "doc_id", "source"), rules.TEXT_RULES, "doc_id", "source", "line")


FINDINGS_SQL = r"""
lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
rules AS (SELECT * FROM (VALUES
  ('TXT-001', 'critical', 'secrets', '(password|token|secret|api_key) = "[A-Za-z0-9]{8,}"'),
  ('TXT-002', 'high', 'pii', '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]{2,}'),
  ('TXT-003', 'medium', 'license', '[Ll]icense'),
  ('TXT-004', 'low', 'noise', '[#$%&*]{3}')) v(rule_id, severity, category, pattern)),
findings AS (
  SELECT doc_id, source, line::INT AS line, rule_id, severity, category,
    CASE WHEN rule_id = 'TXT-001' THEN '****' WHEN rule_id = 'TXT-002' THEN substr(regexp_extract(content, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]{2,}'), 1, 120)
      WHEN rule_id = 'TXT-003' THEN regexp_extract(content, '[Ll]icense') ELSE regexp_extract(content, '[#$%&*]{3}') END AS matched
  FROM lines, rules WHERE regexp_matches(content, pattern))
"""
