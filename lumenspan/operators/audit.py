"""Checks of whole files; a match may span lines, so files go through Python once."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from lumenspan.functions.workers import flat_map, line_starts

SCHEMA = "repo string, file string, line int, checker string, severity string, category string, title string, description string, fix string"


@dataclass(frozen=True)
class Check:
    checker: str
    severity: str
    category: str
    endings: tuple[str, ...]
    pattern: str
    title: str
    description: str
    fix: str
    flags: int = 0
    near: str | None = None  # must be within 200 characters
    never: str | None = None  # must not be in the match
    excluded_endings: tuple[str, ...] = ()


# Names, severities, categories, file endings and patterns of the checks.
CHECKS = (
    Check("IntOverflowChecker", "high", "data_integrity", (".py",), r"""\.cast\(["']int["']\)""", "Cast to int of a field that may be large", "Values above 2,147,483,647 become negative.", "Cast to long.", re.I, near=r"(rowid|row_id|id|pk|primary_key|sequence|serial|bigint|number\(38)"),
    Check("SqlInjectionChecker", "critical", "security", (".py", ".sql"), r"""f["'].*?(SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|MERGE|TRUNCATE|EXEC)""", "SQL text with interpolated values", "Values in the text of a statement can change it. (CWE-89)", "Pass values as parameters; check names against a list.", re.I),
    Check("SqlInjectionChecker", "critical", "security", (".py", ".sql"), r"""["'].*?(SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER)\s.*?["'].*?(%\s*[(\[]|\.[Ff]ormat\()""", "SQL text with formatted values", "Values in the text of a statement can change it. (CWE-89)", "Pass values as parameters; check names against a list.", re.I),
    Check("CicdDependencyChecker", "high", "cicd", (".yml", ".yaml", ".json"), r"fail_on_run_failure\s*:\s*false", "Failed run does not fail the job", "Jobs that need this one run on without its output.", "Set it to true for jobs that others need.", re.I),
    Check("HardcodedEmailChecker", "medium", "cicd", (".yml", ".yaml"), r"(on_failure|on_success|email_notifications)[^\n]*\n(?:[^\n]*\n){0,3}[^\n]*[\w.\-]+@[\w.\-]+\.[a-z]{2,}", "Personal address in a notification", "Alerts are lost when the person leaves.", "Use a shared destination.", re.I, never="[EMAIL_ADDRESS:"),
    Check("SchemaDriftChecker", "medium", "data_integrity", (".py",), r"""\.option\(["']mergeSchema["'],\s*["']true["']\)""", "Schema merging left on", "New columns arrive unnoticed.", "Turn it off after the migration.", re.I),
    Check("HardcodedSecretChecker", "critical", "security", (), r"""(password|passwd|secret|token|api_key|apikey|auth_key)\s*=\s*["'][^"']{6,}["']""", "Credential in a source file", "It stays in the history after removal. (CWE-798)", "Read it from the environment and rotate it.", re.I, excluded_endings=(".md", ".txt", ".lock")),
    Check("HardcodedSecretChecker", "critical", "security", (), r"ghp_[A-Za-z0-9]{36}", "Access token in a source file", "It stays in the history after removal. (CWE-798)", "Read it from the environment and rotate it.", excluded_endings=(".md", ".txt", ".lock")),
    Check("HardcodedSecretChecker", "critical", "security", (), r"sk-ant-[A-Za-z0-9\-_]{20,}", "Model service key in a source file", "It stays in the history after removal. (CWE-798)", "Read it from the environment and rotate it.", excluded_endings=(".md", ".txt", ".lock")),
    Check("HardcodedSecretChecker", "critical", "security", (), r"AKIA[0-9A-Z]{16}", "Cloud access key in a source file", "It stays in the history after removal. (CWE-798)", "Read it from the environment and rotate it.", excluded_endings=(".md", ".txt", ".lock")),
    Check("MissingErrorHandlerChecker", "medium", "code_quality", (".py",), r"except\s*:", "Handler for every exception", "Failures look like success.", "Name the exceptions and log them."),
    Check("MissingErrorHandlerChecker", "medium", "code_quality", (".py",), r"except[^:]*:\s*\n\s*pass", "Exception dropped", "Failures look like success.", "Log it or raise it again."),
)


def check_file(row: dict) -> Iterator[dict]:
    """Findings of one file, in the order of the checks and places."""
    path, text = row["path"] or "", row["content"] or ""
    starts = None
    for c in CHECKS:
        if (c.endings and not path.endswith(c.endings)) or (c.excluded_endings and path.endswith(c.excluded_endings)):
            continue
        for m in re.finditer(c.pattern, text, c.flags):
            if c.near and not re.search(c.near, text[max(0, m.start() - 200) : m.end() + 200], re.I):
                continue
            if c.never and c.never in m[0]:
                continue
            starts = starts or line_starts(text)
            yield {
                "repo": row["repo"], "file": path, "line": bisect_right(starts, m.start()), "checker": c.checker, "severity": c.severity,
                "category": c.category, "title": c.title, "description": c.description, "fix": c.fix,
            }


def audit(files: DataFrame) -> DataFrame:
    """All checks over ``(repo, path, content)``. Null contents have no findings."""
    return flat_map(files.select("repo", "path", "content"), check_file, SCHEMA)
