"""Saved reports: front matter, verdicts, dashboards, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenspan.functions import text as T
from lumenspan.operators.stores import latest_with_history


def verdict_of(text: Column) -> Column:
    """``struct(verdict, risk)`` that a review's text tells; ``unknown`` and ``UNKNOWN`` if it doesn't."""
    pattern = r"\*\*Review:\*\*\s*(.+?)\s*(?:&nbsp;·&nbsp;|\s*·\s*)\s*\*\*Risk:\*\*\s*`([^`]+)`"
    raw, low = F.regexp_extract(text, pattern, 1), F.lower(F.regexp_extract(text, pattern, 1))
    named = (
        F.when(raw.contains("✅") | low.contains("okay") | low.contains("approve"), "approve")
        .when(raw.contains("💬") | low.contains("attention") | low.contains("comment"), "comment")
        .when(raw.contains("❌") | low.contains("revisit") | low.contains("changes"), "request_changes")
        .otherwise("unknown")
    )
    by_title = (
        F.when(text.rlike(r"(?m)^## .*Code Review ✅"), "approve")
        .when(text.rlike(r"(?m)^## .*Code Review 💬"), "comment")
        .when(text.rlike(r"(?m)^## .*Code Review ❌"), "request_changes")
        .when(text.contains("**Needs attention**"), "comment")
    )
    risk = F.coalesce(F.nullif(F.regexp_extract(text, r"Risk:\s*`?([A-Z]+)`?", 1), F.lit("")), F.lit("UNKNOWN"))
    return F.when(raw != "", F.struct(named.alias("verdict"), F.upper(F.trim(F.regexp_extract(text, pattern, 2))).alias("risk"))).otherwise(
        F.struct(F.coalesce(by_title, F.lit("unknown")).alias("verdict"), F.when(by_title.isNotNull(), risk).otherwise("UNKNOWN").alias("risk"))
    )


def _read(files: DataFrame, **more: Column) -> DataFrame:
    """``files`` with their front matter as ``fm``, and ``more``: each parsed once, whatever reads it later."""
    # What a generator gives isn't put into the expressions that read it, nor are filters on it.
    parsed = F.struct(T.front_matter(F.col("text")).alias("fm"), *[c.alias(n) for n, c in more.items()])
    return files.select("*", F.explode(F.array(parsed)).alias("_parsed")).select("*", "_parsed.*").drop("_parsed")


def reviews(files: DataFrame) -> DataFrame:
    """Review rows of ``(path, text, mtime)``; files without a ``repo`` in their front matter are left out."""
    fm, told, get = F.col("fm"), F.col("told"), lambda k: F.coalesce(F.col("fm")[k], F.lit(""))
    rows = _read(files, told=verdict_of(F.col("text"))).where(get("repo") != "")
    two = get("repo").contains("/")
    return rows.select(
        get("repo").alias("repo"),
        F.when(two, F.substring_index(get("repo"), "/", 1)).otherwise("").alias("owner"),
        F.when(two, F.regexp_replace(get("repo"), "^[^/]*/", "")).otherwise(get("repo")).alias("repo_name"),
        get("pr").alias("pr"),
        F.coalesce(get("pr").try_cast("int"), F.lit(0)).alias("pr_number"),
        F.coalesce(fm["title"], F.concat(F.lit("PR #"), F.coalesce(F.nullif(get("pr"), F.lit("")), F.lit("?")))).alias("title"),
        get("date").alias("date"),
        T.parsed_date(fm["timestamp_utc"], get("date"), F.unix_timestamp("mtime").cast("double")).alias("timestamp"),
        get("url").alias("url"),
        get("requested_by").alias("by"),
        told["verdict"].alias("verdict"),
        told["risk"].alias("risk"),
        get("files_analyzed").alias("files_analyzed"),
        get("pr_status").alias("pr_status"),
        F.coalesce(get("cost_usd").try_cast("double"), F.lit(0.0)).alias("cost_usd"),
        "path",
    )


def evaluations(files: DataFrame) -> DataFrame:
    """Evaluation rows of ``(path, text, mtime)``."""
    fm, get = F.col("fm"), lambda k: F.coalesce(F.col("fm")[k], F.lit(""))
    rows = _read(files).where(get("repo") != "")
    section = lambda name: F.nullif(F.regexp_extract("text", rf"(?s)## {name}\n\n(.+?)(?:\n\n##|\z)", 1), F.lit(""))
    summary = F.coalesce(section("Executive summary"), section("What this repo is"), F.lit("Repo evaluation"))
    return rows.select(
        get("repo").alias("repo"),
        F.coalesce(fm["branch"], F.lit("main")).alias("branch"),
        get("date").alias("date"),
        T.parsed_date(fm["timestamp_utc"], get("date"), F.unix_timestamp("mtime").cast("double")).alias("timestamp"),
        F.upper(F.coalesce(F.nullif(fm["risk_level"], F.lit("")), F.lit("unknown"))).alias("risk"),
        get("overall_grade").alias("grade"),
        T.first_sentence(summary).alias("summary"),
        (F.lower(get("synthesis_failed")) == "true").alias("synthesis_failed"),
        get("scoped_path").alias("scoped_path"),
        "path",
    )


def grouped_reviews(rows: DataFrame) -> DataFrame:
    """One row for each pull request: its latest review, and the newest three as history."""
    columns = [c for c in rows.columns if c not in ("repo", "pr")]
    return latest_with_history(rows, ["repo", "pr"], [F.desc("timestamp"), F.col("path")], columns)


def grouped_evaluations(rows: DataFrame) -> DataFrame:
    columns = [c for c in rows.columns if c != "repo"]
    return latest_with_history(rows, ["repo"], [F.desc("timestamp"), F.col("path")], columns)


def review_kpis(grouped: DataFrame) -> DataFrame:
    """Figures of the dashboard, in one row."""
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    return grouped.agg(
        F.count("*").alias("total"),
        is_("approve").alias("approved"),
        is_("request_changes").alias("blocked"),
        is_("comment").alias("comment"),
        F.count_if(F.col("risk").isin("CRITICAL", "HIGH")).alias("critical"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 2).alias("total_cost"),
    )


def evaluation_kpis(grouped: DataFrame) -> DataFrame:
    return grouped.agg(F.count("*").alias("total"), F.count_if(F.col("risk").isin("CRITICAL", "HIGH")).alias("critical"))


def filtered(rows: DataFrame, text: str = "", verdict: str = "", risk: str = "", status: str = "", days: int = 0, now: Column | None = None) -> DataFrame:
    """Dashboard rows by free text, verdict, risk, status and age."""
    if text:
        rows = rows.where(F.lower(F.concat_ws(" ", "repo", "title", "by", "pr")).contains(text.lower()))
    for column, value in (("verdict", verdict), ("risk", risk), ("pr_status", status)):
        if value:
            rows = rows.where(F.lower(column) == value.lower())
    if days:
        rows = rows.where((F.unix_timestamp() if now is None else now) - F.col("timestamp") <= days * 86_400)
    return rows


def bullets(text: Column) -> Column:
    """The items of a bullet list."""
    lines = F.transform(T.to_lines(text), T.strip)
    return F.transform(F.filter(lines, lambda x: x.startswith("- ")), lambda x: F.substring(x, F.lit(3), F.char_length(x)))


def code_block(text: Column) -> Column:
    """``struct(before, code)`` of the first fenced block, both empty if there is none."""
    pattern = r"(?s)^(.*?)```[a-z]*\n(.*?)\n```"
    return F.struct(T.strip(F.regexp_extract(text, pattern, 1)).alias("before"), F.regexp_extract(text, pattern, 2).alias("code"))


def table(text: Column) -> Column:
    """``struct(before, headers, rows)`` of a markdown table."""
    lines = F.filter(F.transform(T.to_lines(text), T.strip), lambda x: x.startswith("|"))
    cells = lambda row: F.transform(F.split(F.regexp_replace(row, r"^\|+|\|+$", ""), r"\|"), T.strip)
    two = F.size(lines) >= 2
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(text.contains("|"), T.strip(F.substring_index(text, "|", 1))).otherwise("").alias("before"),
        F.when(two, cells(F.get(lines, F.lit(0)))).otherwise(none).alias("headers"),
        F.when(two, F.transform(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), cells)).otherwise(F.array().cast("array<array<string>>")).alias("rows"),
    )


def misc_issues(text: Column) -> Column:
    """``struct(severity, file_path, line_ref, description)`` of each issue bullet."""
    pattern = r"^-\s+\*\*`([A-Z]+)`\*\*\s+`([^`]+)`(?::([0-9][0-9\-]*))?(?:\s+—\s+(.+))?"
    got = lambda x, n: F.regexp_extract(x, pattern, n)
    return F.transform(
        F.filter(F.transform(T.to_lines(text), T.strip), lambda x: x.rlike(pattern)),
        lambda x: F.struct(got(x, 1).alias("severity"), got(x, 2).alias("file_path"), F.nullif(got(x, 3), F.lit("")).alias("line_ref"), T.strip(got(x, 4)).alias("description")),
    )


def remediation_items(text: Column) -> Column:
    """``struct(severity, file_path, line_ref, description, tip, code)`` of each remediation block."""
    start = r"\*\*`[A-Z]+`\*\*"
    head = r"^\*\*`([A-Z]+)`\*\*\s*`([^`]+)`(?:\s*\(lines?\s*([^)]+)\))?"
    blocks = F.filter(F.transform(F.split(text, rf"(?m)(?=^{start})"), T.strip), lambda b: b.rlike(head))
    rest = lambda b: T.strip(F.regexp_replace(b, head, ""))
    bare = lambda b: T.strip(F.regexp_replace(rest(b), r"(?s)```\w*\n.*?```", ""))
    none = lambda c: F.nullif(c, F.lit(""))
    return F.transform(
        blocks,
        lambda b: F.struct(
            F.regexp_extract(b, head, 1).alias("severity"),
            F.regexp_extract(b, head, 2).alias("file_path"),
            none(T.strip(F.regexp_extract(b, head, 3))).alias("line_ref"),
            T.strip(F.regexp_replace(bare(b), r"(?ms)^>\s*💡?\s*.*$", "")).alias("description"),
            none(T.strip(F.regexp_extract(bare(b), r"(?m)^>\s*💡?\s*(.+?)$", 1))).alias("tip"),
            none(F.regexp_replace(F.regexp_extract(rest(b), r"(?s)```\w*\n(.*?)```", 1), r"\s+$", "")).alias("code"),
        ),
    )


def listed(rows: DataFrame, repo: str | None = None) -> DataFrame:
    """Saved reports by folder."""
    found = rows.where(F.col("repo") == repo) if repo else rows
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return found.groupBy(folder.alias("folder")).agg(F.sort_array(F.collect_list(T.base_name(F.col("path")))).alias("files"))


def _blocks(text: Column, start: str) -> Column:
    """The parts of a text that begin with a line of a pattern."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), rf"(?m)(?=^{start})"), T.strip), lambda b: b.rlike(rf"\A{start}"))


def _labelled(block: Column, label: str, until: str) -> Column:
    return T.strip(F.regexp_extract(block, rf"(?s)\*\*{label}:\*\*\s*(.+?)(?:{until})", 1))


def evaluation_findings(text: Column) -> Column:
    """``struct(severity, title, location, description, fix)`` of each finding under ``### [SEVERITY] title``."""
    head, fix = r"### \[([A-Z]+)\][ \t]*([^\n]+)", r"(?s)\*\*Fix:\*\*\s*(.+?)(?:\n\n|\z)"
    location = r"\*\*Location:\*\*\s*(.+?)(?:\n|\z)"
    body = lambda b: F.regexp_replace(F.regexp_replace(b, rf"\A{head}\s*", ""), rf"(?s)\A.*?{location}", "")
    return F.transform(
        _blocks(text, head),
        lambda b: F.struct(
            F.regexp_extract(b, head, 1).alias("severity"),
            T.strip(F.regexp_extract(b, head, 2)).alias("title"),
            T.strip(F.regexp_extract(b, location, 1)).alias("location"),
            T.strip(F.regexp_replace(body(b), r"(?s)\*\*Fix:\*\*\s*.+", "")).alias("description"),
            T.strip(F.regexp_extract(body(b), fix, 1)).alias("fix"),
        ),
    )


def grades(text: Column) -> Column:
    """``struct(security, secrets, pii)`` of the line of grades, empty where there is none."""
    pattern = r"\*\*Security:\*\*\s*(\S+)\s*\|\s*Secrets:\s*(\S+)\s*\|\s*PII:\s*(\S+)"
    return F.struct(*[F.coalesce(F.regexp_extract(text, pattern, n), F.lit("")).alias(name) for n, name in enumerate(("security", "secrets", "pii"), 1)])


def evaluated_modules(text: Column) -> Column:
    """``struct(name, purpose)`` of each module: its heading, and the first line below."""
    head = r"### `([^`]+)`\n"
    return F.transform(
        _blocks(text, head),
        lambda b: F.struct(T.strip(F.regexp_extract(b, head, 1)).alias("name"), T.strip(F.substring_index(T.strip(F.regexp_replace(b, rf"\A{head}", "")), "\n", 1)).alias("purpose")),
    )


def remediation_plan(text: Column) -> Column:
    """``struct(priority, severity, title, files, problem, change_plan, acceptance_check)`` of each numbered step."""
    head = r"### (\d+)\. \[([A-Z]+)\][ \t]*([^\n]+)"
    got = lambda b, n: T.strip(F.regexp_extract(b, head, n))
    part = r"\n\*\*|\z"
    return F.transform(
        _blocks(text, head),
        lambda b: F.struct(
            got(b, 1).alias("priority"), got(b, 2).alias("severity"), got(b, 3).alias("title"), _labelled(b, "Files", r"\n|\z").alias("files"),
            _labelled(b, "Problem", part).alias("problem"), _labelled(b, "Change plan", part).alias("change_plan"), _labelled(b, "Acceptance check", part).alias("acceptance_check"),
        ),
    )
