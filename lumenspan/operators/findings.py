"""Rollups over findings: counts, grades, verdicts, merges, remediation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenspan.operators.select import keep_first, top_n
from lumenspan.schemas import LIMITS, SEVERITIES, severity_rank


def severity_counts(df: DataFrame, *keys: str, severity: str = "severity") -> DataFrame:
    """``(keys, critical, high, medium, low, total)``, letter case of severities left aside."""
    low = F.lower(severity)
    return df.groupBy(*keys).agg(*[F.count_if(low == s).alias(s) for s in SEVERITIES], F.count("*").alias("total"))


def histogram(counts: DataFrame, *keys: str) -> DataFrame:
    """Counts as text in the order of severity, such as ``1 critical, 2 low``."""
    parts = [F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in SEVERITIES]
    return counts.select(*keys, F.concat_ws(", ", *parts).alias("histogram"))


def at_least(df: DataFrame, severity: Column, least: str) -> DataFrame:
    """Rows of a severity as bad as ``least`` or worse; unknown severities count as worst-known."""
    return df.where(severity_rank(severity) <= severity_rank(F.lit(least)))


def letter_grade(critical: Column, high: Column, medium: Column) -> Column:
    return (
        F.when(critical > 0, "F").when(high >= 3, "D").when(high >= 1, "C").when(medium >= 3, "C+").when(medium >= 1, "B").otherwise("A")
    )


def risk_level(critical: Column, high: Column, total: Column) -> Column:
    return F.when(critical > 0, "critical").when(high > 0, "high").when(total > 0, "medium").otherwise("low")


def secrets_status(df: DataFrame, *keys: str) -> DataFrame:
    """fail: a critical finding about secrets; warn: any such; pass: none."""
    title = F.lower(F.coalesce("title", F.lit("")))
    secret = (F.col("category") == "secrets") | title.contains("secret") | title.contains("token") | title.contains("credential")
    worst = df.groupBy(*keys).agg(F.bool_or(secret & (F.lower("severity") == "critical")).alias("bad"), F.bool_or(secret).alias("some"))
    return worst.select(*keys, F.when(F.col("bad"), "fail").when(F.col("some"), "warn").otherwise("pass").alias("secrets_status"))


def ratings(profile: DataFrame) -> DataFrame:
    """Grades of repositories from ``(repo, critical, high, medium, secrets_status, top_level_dirs,
    readme_excerpt, signals, audit_scanned, audit_eligible)``."""
    grade = letter_grade(F.col("critical"), F.col("high"), F.col("medium"))
    dirs, readme = F.col("top_level_dirs"), F.char_length(F.coalesce("readme_excerpt", F.lit("")))
    data = F.array_contains(dirs, "data") | F.array_contains(dirs, "out")
    partial = (F.col("audit_eligible") > 0) & (F.col("audit_scanned") < F.col("audit_eligible"))
    notes = F.array_compact(
        F.array(
            F.when(data, "Folders named data/ or out/ may hold personal data."),
            F.when(partial, F.format_string("Audit scanned %s of %s eligible files; scores are partial.", "audit_scanned", "audit_eligible")),
        )
    )
    return profile.select(
        "repo",
        F.when(F.col("secrets_status") == "fail", "F").otherwise(grade).alias("overall_grade"),
        grade.alias("security_grade"),
        "secrets_status",
        F.when(data, "warn").otherwise("pass").alias("pii_status"),
        F.when(readme > 400, 4).when(readme == 0, 2).otherwise(3).alias("documentation_score"),
        F.when(F.array_contains(dirs, "tests"), 4).otherwise(2).alias("testability_score"),
        F.when(F.size("signals") >= 2, 4).otherwise(3).alias("maintainability_score"),
        notes.alias("rating_notes"),
    )


def verdict(claimed: Column, critical: Column, high: Column) -> Column:
    """The verdict that the findings allow: changes are asked for only with a critical one, and
    nothing is approved with a critical or two high ones."""
    asked = F.when((claimed == "request_changes") & (critical == 0), "comment").otherwise(claimed)
    return F.when((asked == "approve") & ((critical > 0) | (high >= 2)), "comment").otherwise(asked)


def demoted_risk(claimed: Column, critical: Column, high: Column) -> Column:
    """The risk that the findings allow, taken down step by step."""
    one = F.when((claimed == "critical") & (critical < 2), "high").otherwise(claimed)
    two = F.when((one == "high") & (critical == 0) & (high < 2), "medium").otherwise(one)
    return F.when((two == "medium") & (critical == 0) & (high == 0), "low").otherwise(two)


def fill_gaps(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of ``first`` and those of ``second`` with a key that it doesn't have, each key once."""
    both = first.withColumn("_source", F.lit(0)).unionByName(second.withColumn("_source", F.lit(1)))
    order = [F.col(c) for c in first.columns if c not in keys]
    return keep_first(both, keys, "_source", *order).drop("_source")


def weakness(description: Column) -> Column:
    """The first weakness number in a text."""
    return F.nullif(F.regexp_extract(description, r"CWE-\d+", 0), F.lit(""))


def as_evaluation(df: DataFrame) -> DataFrame:
    """Audit findings in the form of evaluation findings."""
    category = F.when(F.col("checker") == "HardcodedSecretChecker", "secrets").otherwise(F.col("category"))
    return df.select(
        "file", "line", "severity", category.alias("category"), "title", "description", "fix",
        F.lit("deterministic").alias("source"), weakness(F.col("description")).alias("cwe"),
    )


def remediation(df: DataFrame, *keys: str, steps: int = LIMITS.remediation_steps) -> DataFrame:
    """The worst findings as numbered steps, each file and title once."""
    rank = severity_rank(F.col("severity"))
    once = keep_first(df.withColumn("_rank", rank), [*keys, "file", "title"], "_rank", "line")
    order = Window.partitionBy(*keys).orderBy("_rank", "file", "title") if keys else Window.orderBy("_rank", "file", "title")
    best = top_n(once, list(keys), steps, "_rank", "file", "title") if keys else once.orderBy("_rank", "file", "title").limit(steps)
    place = F.concat(F.lit("`"), F.col("file"), F.lit("`"), F.when(F.col("line") > 0, F.concat(F.lit(" line "), F.col("line").cast("string"))).otherwise(""))
    plan = F.coalesce(F.nullif("fix", F.lit("")), F.concat(F.lit("Edit "), place, F.lit(": use a safe form and add a regression test.")))
    return best.withColumn("priority", F.row_number().over(order)).select(
        *keys, "priority", "severity", F.substring("title", 1, 80).alias("title"), "file",
        F.substring(F.coalesce(F.nullif("description", F.lit("")), F.col("title")), 1, 400).alias("problem"), plan.alias("change_plan"),
    )


def cost_usd(fresh: Column, written: Column, read: Column, out: Column) -> Column:
    """Price of model tokens; fixed values: 3.00, 3.75, 0.30 and 15.00 dollars a million."""
    return (fresh * 3.0 + written * 3.75 + read * 0.3 + out * 15.0) / 1e6


def cache_hit_rate(fresh: Column, written: Column, read: Column) -> Column:
    total = fresh + written + read
    return F.when(total > 0, read / total).otherwise(0.0)


def token_estimate(chars: Column) -> Column:
    return F.floor(chars / 4)


def review_minutes(files: Column, lines: Column) -> Column:
    """Two minutes a file and one for fifty lines, ten at least."""
    return F.greatest(files * 2 + F.floor(lines / 50), F.lit(10))


def agent_totals(agents: DataFrame, *keys: str) -> DataFrame:
    """``(keys, agents, failed, findings)`` of ``(keys, error, findings array)``: findings of agents without an error."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    counted = F.when(~failed, F.coalesce(F.size("findings"), F.lit(0))).otherwise(0)
    return agents.groupBy(*keys).agg(F.count("*").alias("agents"), F.count_if(failed).alias("failed"), F.sum(counted).cast("long").alias("findings"))
