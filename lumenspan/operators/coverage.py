"""Which changed files and symbols tests know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenspan.functions import text as T

# Names of test files and folders, and signs of frameworks and fixtures.
TEST_NAME = r"(?i)(^|/)test[_\-]|[_\-]test\.(py|js|ts|java|go|rb|rs)$|(^|/)spec[_\-]|[_\-]spec\.(py|js|ts)$|\.test\.(js|ts|jsx|tsx)$|\.spec\.(js|ts|jsx|tsx)$"
TEST_FOLDER = r"(?i)(^|/)tests?/|/__tests__/|/spec/"
FRAMEWORKS = (
    ("pytest", r"import pytest|@pytest\.|def test_|from pytest"),
    ("unittest", r"import unittest|unittest\.TestCase|self\.assert"),
    ("jest", r"describe\(|it\(|expect\(|jest\."),
    ("mocha", r"chai\.|mocha"),
)
FIXTURES = r"(?i)@pytest\.fixture|factory_boy|faker|fixtures/|testdata/|test_data/|conftest\.py|\.fixture\.(json|ya?ml|csv|sql)$|fixtures\.py|factories\.py|seeds\.py|seed_data"
SOURCES = r"(?i)\.(py|js|jsx|ts|tsx|java|go|rb|rs)$"


def test_file(path: Column) -> Column:
    return path.rlike(TEST_NAME) | path.rlike(TEST_FOLDER)


test_file.__test__ = False


def framework(content: Column) -> Column:
    out = F.lit("unknown")
    for name, pattern in reversed(FRAMEWORKS):
        out = F.when(content.rlike(pattern), name).otherwise(out)
    return out


def candidates(path: Column) -> Column:
    """Where the test of a source file would be."""
    stem, suffix = T.stem(path), F.regexp_extract(path, r"(\.[^./]*)$", 1)
    folder = F.when(path.contains("/"), F.regexp_replace(path, "[^/]*$", "")).otherwise("")
    names = (
        (folder, "test_", ""), (folder, "", "_test"), ("tests/", "test_", ""), ("tests/", "", "_test"), ("test/", "test_", ""),
        ("__tests__/", "", ".test"), ("__tests__/", "", ".spec"),
    )
    return F.array(*[F.concat(f if isinstance(f, Column) else F.lit(f), F.lit(a), stem, F.lit(b), suffix) for f, a, b in names])


def summary(files: DataFrame, *keys: str) -> DataFrame:
    """Whether there are tests and fixtures, and the frameworks, sorted."""
    path, content = F.col("path"), F.coalesce("content", F.lit(""))
    fixture = path.rlike(FIXTURES) | F.substring(content, 1, 2000).rlike(FIXTURES)
    used = F.when(test_file(path), F.nullif(framework(content), F.lit("unknown")))
    return files.groupBy(*keys).agg(F.bool_or(test_file(path)).alias("has_tests"), F.bool_or(fixture).alias("has_fixtures"), F.sort_array(F.collect_set(used)).alias("frameworks"))


def covered(changed: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, covered)`` of changed source files: a candidate exists, or a test has the module's name as a word."""
    sources = changed.where(F.col("path").rlike(SOURCES) & ~test_file(F.col("path"))).select("path").distinct()
    paths = files.select(F.col("path").alias("candidate")).distinct()
    by_path = sources.select("path", F.explode(candidates(F.col("path"))).alias("candidate")).join(paths, "candidate", "left_semi").select("path")
    words = _test_words(files)
    by_word = sources.withColumn("word", T.stem(F.col("path"))).join(words, "word", "left_semi").select("path")
    known = by_path.union(by_word).distinct().withColumn("_hit", F.lit(True))
    return sources.join(known, "path", "left").select("path", F.coalesce("_hit", F.lit(False)).alias("covered"))


def _test_words(files: DataFrame) -> DataFrame:
    tests = files.where(test_file(F.col("path")))
    return tests.select(F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?U)\w+"), F.lit(0)))).alias("word")).distinct()


def uncovered(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Changed symbols (``name``) that no test file mentions."""
    return symbols.join(_test_words(files).withColumnRenamed("word", "name"), "name", "left_anti")


def changed_definitions(cursor: DataFrame) -> DataFrame:
    """``(file, name, kind)`` of Python definitions and classes on added lines."""
    text = F.col("text")
    name = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    function, class_ = name(r"^\s*(?:async\s+)?def\s+(\w+)\s*\("), name(r"^class\s+(\w+)")
    found = cursor.where("change = 'added'").select("file", F.coalesce(function, class_).alias("name"), F.when(function.isNotNull(), "function").otherwise("class").alias("kind"))
    return found.where("name is not null").distinct()
