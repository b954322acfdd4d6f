"""Schemas of the review tables, severity order, and limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Names and order of severities.
SEVERITIES = ("critical", "high", "medium", "low")

FINDINGS = (
    "source string, file string, line int, severity string, category string, title string, "
    "description string, fix string, rule_id string, cwe string"
)
DIFFS = "pr_id string, diff string"
FILES = "repo string, ref string, ord int, path string, content string, size long"
TREE = "repo string, ord int, path string, type string, size long"
COMMENTS = (
    "review_id string, ord int, file string, line_range string, severity string, category string, comment string, suggestion string"
)
EDGES = "DB string, SCHEMA string, OBJ string, REFERENCED_DATABASE string, REFERENCED_SCHEMA string, REFERENCED_OBJECT_NAME string, DEPENDENCY_TYPE string"
SIGNATURE = "struct<name: string, kind: string, params: array<string>, return_type: string, decorators: array<string>, is_async: boolean, bases: array<string>>"
SYMBOLS = f"file string, line int, end_line int, qualified string, signature {SIGNATURE}, body_hash string"
SYMBOL_INDEX = "repo string, name string, file string, line int, kind string, snippet string"
USAGES = (
    "file string, line int, raw_ref string, catalog string, schema string, table string, operation string, snippet string, "
    "context string, upstream array<string>, downstream array<string>"
)
PR_HISTORY = (
    "pr_number int, title string, merged_at string, author string, files_changed array<string>, body_snippet string, "
    "verdict string, risk_level string, summary string"
)
CATALOG_CONSUMERS = "feature_name string, repo string, file string, line int, role string, snippet string"
EVENTS = "event string, action string, repository struct<full_name: string>, pull_request struct<number: int, title: string>"


@dataclass(frozen=True)
class Limits:
    """Caps of the review and audit pipelines; fixed values."""

    files: int = 30
    file_bytes: int = 500_000
    total_bytes: int = 1_000_000
    sql_file_bytes: int = 80_000
    diff_warning_bytes: int = 100_000
    index_files: int = 2_000
    index_file_bytes: int = 1_000_000
    index_matches: int = 50
    snippet_chars: int = 120
    shown_matches: int = 10
    feature_consumers: int = 20
    audit_files: int = 60
    audit_file_chars: int = 20_000
    modules: int = 6
    module_files: int = 12
    module_file_chars: int = 12_000
    key_files: int = 10
    key_file_chars: int = 5_000
    history: int = 3
    related_history: int = 5
    remediation_steps: int = 6
    suggestions: int = 8
    search_calls: int = 28
    search_seconds: int = 60


LIMITS = Limits()


def severity_rank(severity: Column) -> Column:
    """0 for critical to 3 for low, 9 for anything else; upper and lower case are the same."""
    out = F.lit(9)
    for n, name in reversed(list(enumerate(SEVERITIES))):
        out = F.when(F.lower(severity) == name, n).otherwise(out)
    return out
