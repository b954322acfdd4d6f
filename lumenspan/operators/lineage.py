"""Table usages in SQL, Python and YAML files."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from lumenspan.functions.workers import flat_map, line_starts
from lumenspan.operators.select import keep_first
from lumenspan.schemas import USAGES

# A name of up to three parts, the statements that name tables, and reserved words.
_NAME = r"""(["`]?[A-Za-z_][A-Za-z0-9_]*["`]?(?:\.["`]?[A-Za-z_][A-Za-z0-9_]*["`]?){0,2})"""
SQL_USES = (
    (re.compile(r"\b(?:FROM|JOIN)\s+" + _NAME, re.I), "READ"),
    (re.compile(r"\b(?:INSERT\s+(?:OVERWRITE\s+)?INTO|MERGE\s+INTO|UPDATE)\s+" + _NAME, re.I), "WRITE"),
    (re.compile(r"\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:TRANSIENT\s+TABLE|TABLE|VIEW)\s+(?:IF\s+NOT\s+EXISTS\s+)?" + _NAME, re.I), "CREATE"),
    (re.compile(r"\bDROP\s+(?:TABLE|VIEW)\s+(?:IF\s+EXISTS\s+)?" + _NAME, re.I), "DROP"),
    (re.compile(r"\bALTER\s+TABLE\s+" + _NAME, re.I), "ALTER"),
    (re.compile(r"\bCOPY\s+INTO\s+" + _NAME, re.I), "WRITE"),
)
PYTHON_USES = (
    (re.compile(r"""\b(?:spark|session|sc)\.read(?:Stream)?\s*\.\s*(?:table|load)\s*\(\s*["']([^"']+)["']""", re.I), "READ"),
    (re.compile(r"""\.(?:saveAsTable|insertInto)\s*\(\s*["']([^"']+)["']""", re.I), "WRITE"),
    (re.compile(r"""\.jdbc\s*\([^,]+,\s*["']([^"']+)["']""", re.I), "READ"),
    (re.compile(r"""DeltaTable\s*\.\s*forName\s*\(\s*[^,)]*["']([^"']+)["']""", re.I), "READ"),
)
PYTHON_SQL = re.compile(r"""\b(?:spark|session|sc|sql)\s*\.\s*sql\s*\(\s*(f?)("{3}|'{3}|"|')(.*?)\2\s*\)""", re.I | re.S)
YAML_USE = re.compile(r"""(table_name|target_table|source_table|output_table|input_table|catalog_table|snowflake_table|destination)\s*:\s*["']?([A-Za-z_][A-Za-z0-9_.]*)["']?""", re.I)
RESERVED = frozenset(
    (
        *("SELECT", "FROM", "WHERE", "JOIN", "LEFT", "RIGHT", "INNER", "OUTER", "FULL", "ON", "AND", "OR"),
        *("NOT", "IN", "IS", "NULL", "AS", "BY", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "UNION"),
        *("ALL", "DISTINCT", "CASE", "WHEN", "THEN", "ELSE", "END", "WITH", "INSERT", "INTO", "VALUES", "UPDATE"),
        *("SET", "DELETE", "MERGE", "USING", "MATCHED", "CREATE", "DROP", "ALTER", "TABLE", "VIEW", "REPLACE", "IF"),
        *("EXISTS", "ADD", "COLUMN", "RENAME", "TO", "TRUE", "FALSE", "LIKE", "BETWEEN", "OVER", "PARTITION", "ROWS"),
        *("RANGE", "UNBOUNDED", "FOLLOWING", "PRECEDING", "CURRENT", "ROW", "CATALOG", "SCHEMA", "DATABASE", "USE", "SHOW", "DESCRIBE"),
        *("EXPLAIN", "BEGIN", "COMMIT", "ROLLBACK", "TRANSACTION", "GRANT", "REVOKE", "COPY", "STAGE", "FORMAT", "OPTIONS"),
    )
)
DDL = ("CREATE", "DROP", "ALTER")


def name_parts(raw: str) -> tuple[str, str, str] | None:
    """(catalog, schema, table) in upper case; None for reserved words, short and odd names."""
    parts = [p.strip().upper() for p in re.sub(r"[\"`]", "", raw).split(".")]
    if not 1 <= len(parts) <= 3 or not parts[-1]:
        return None
    if len(parts) == 1 and (parts[0] in RESERVED or len(parts[0]) < 3):
        return None
    return tuple([""] * (3 - len(parts)) + parts)


def context_of(path: str) -> str:
    low = path.lower()
    for endings, name in (((".sql", ".ddl", ".hql"), "sql"), ((".py",), "pyspark"), ((".yml", ".yaml"), "yaml"), ((".ipynb",), "notebook")):
        if low.endswith(endings):
            return name
    return "config"


def _uses(text: str, context: str) -> Iterator[tuple[str, str, int]]:
    """(name as written, operation, offset)."""
    if context == "yaml":
        for m in YAML_USE.finditer(text):
            yield m[2], "WRITE" if re.match("target|output|destination", m[1], re.I) else "READ", m.start()
        return
    for pattern, operation in SQL_USES if context == "sql" else PYTHON_USES:
        for m in pattern.finditer(text):
            yield m[1].strip(), operation, m.start()
    for m in PYTHON_SQL.finditer(text) if context in ("pyspark", "notebook") else ():
        body = re.sub(r"\{[^{}]*\}", "DYNAMIC", m[3]) if m[1] else m[3]
        for raw, operation, at in _uses(body, "sql"):
            yield raw, operation, m.start(3) + at if not m[1] else m.start(3)


def usages_of(row: dict) -> Iterator[dict]:
    path, text = row["path"] or "", row["content"] or ""
    context = context_of(path)
    if context == "config":
        return
    starts, lines = line_starts(text), text.split("\n")
    for raw, operation, at in _uses(text, context):
        parts = name_parts(raw)
        if parts:
            line = bisect_right(starts, at)
            yield {
                "file": path, "line": line, "raw_ref": raw, "catalog": parts[0], "schema": parts[1], "table": parts[2], "operation": operation,
                "snippet": lines[line - 1].strip()[:120], "context": context, "upstream": [], "downstream": [],
            }


def usages(files: DataFrame) -> DataFrame:
    """Usages of the files of ``(path, content)``, each table, operation, file and line once."""
    found = flat_map(files.select("path", "content"), usages_of, USAGES)
    return keep_first(found, ["table", "operation", "file", "line"], "catalog", "schema", "raw_ref")


def merged(rows: DataFrame) -> DataFrame:
    """One row for each object: lists united in order; a DDL label, the last of several, beats others."""
    order, object_ = F.struct("file", "line", "operation"), F.upper("raw_ref").alias("object")
    ddl = F.col("operation").isin(*DDL)
    label = F.coalesce(F.max_by("operation", F.when(ddl, order)), F.min_by("operation", order))
    out = rows.groupBy(object_).agg(label.alias("operation"), F.count("*").alias("uses"))
    for c in ("upstream", "downstream"):
        # Each name of an object once before names are listed, so a much used object is no long list.
        each = rows.select(object_, order.alias("o"), F.posexplode(c).alias("n", "name")).groupBy("object", "name").agg(F.min(F.struct("o", "n")).alias("first"))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"])
        lists = each.groupBy("object").agg(listed.alias(c))
        out = out.join(lists, "object", "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return out.select("object", "operation", "upstream", "downstream", "uses")


def shown(rows: DataFrame) -> DataFrame:
    """DDL always, reads and writes where their lineage is known."""
    return rows.where(F.col("operation").isin(*DDL) | (F.size("upstream") > 0) | (F.size("downstream") > 0))
