"""Rule scans over documents and the rollups of what they find."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.functions import text as T
from lumenspan.operators import findings, select
from lumenspan.plans.shared import FINDINGS_SQL, SEVERITY_SQL, document_findings, query, severity, table


@query(f"WITH {FINDINGS_SQL} SELECT doc_id, line, rule_id, severity, category FROM findings")
def rule_scan(spark, sf_dir):
    return document_findings(spark, sf_dir).select("doc_id", "line", "rule_id", "severity", "category")


@query(f"WITH {FINDINGS_SQL} SELECT doc_id, line, rule_id, matched FROM findings")
def rule_scan_masked(spark, sf_dir):
    return document_findings(spark, sf_dir).select("doc_id", "line", "rule_id", "matched")


@query(
    r"""SELECT doc_id, regexp_replace(text, '(password|secret|token|api_key)\s*=\s*[''"][^''"]{6,}[''"]', '\1=****', 'gi') AS redacted
    FROM documents WHERE regexp_matches(text, '(?i)(password|secret|token|api_key)\s*=\s*[''"][^''"]{6,}[''"]')"""
)
def redact_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("redacted", T.redacted(F.col("text")))
    return docs.where("redacted <> text").select("doc_id", "redacted")


COUNTS_SQL = "count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS total"
GRADE_SQL = "CASE WHEN critical > 0 THEN 'F' WHEN high >= 3 THEN 'D' WHEN high >= 1 THEN 'C' WHEN medium >= 3 THEN 'C+' WHEN medium >= 1 THEN 'B' ELSE 'A' END"


@query(f"WITH {FINDINGS_SQL} SELECT source, {COUNTS_SQL} FROM findings GROUP BY source")
def severity_rollup(spark, sf_dir):
    return findings.severity_counts(document_findings(spark, sf_dir), "source")


@query(
    f"""WITH {FINDINGS_SQL}, c AS (SELECT doc_id, {COUNTS_SQL} FROM findings GROUP BY doc_id)
    SELECT doc_id, array_to_string(list_filter([CASE WHEN critical > 0 THEN critical || ' critical' END, CASE WHEN high > 0 THEN high || ' high' END,
      CASE WHEN medium > 0 THEN medium || ' medium' END, CASE WHEN low > 0 THEN low || ' low' END], lambda x: x IS NOT NULL), ', ') AS histogram FROM c"""
)
def severity_histogram(spark, sf_dir):
    return findings.histogram(findings.severity_counts(document_findings(spark, sf_dir), "doc_id"), "doc_id")


@query(
    f"""WITH {FINDINGS_SQL}, c AS (SELECT source, {COUNTS_SQL} FROM findings GROUP BY source), s AS (SELECT DISTINCT source FROM documents),
    z AS (SELECT s.source, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(total, 0) AS total FROM s LEFT JOIN c USING (source))
    SELECT source, critical, high, medium, total, {GRADE_SQL} AS grade,
      CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high' WHEN total > 0 THEN 'medium' ELSE 'low' END AS risk FROM z"""
)
def letter_grade(spark, sf_dir):
    counts = findings.severity_counts(document_findings(spark, sf_dir), "source")
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    full = sources.join(counts, "source", "left").na.fill(0)
    c, h, m, t = (F.col(x) for x in ("critical", "high", "medium", "total"))
    return full.select("source", c, h, m, t, findings.letter_grade(c, h, m).alias("grade"), findings.risk_level(c, h, t).alias("risk"))


@query(
    f"""WITH {FINDINGS_SQL} SELECT source, CASE WHEN bool_or(category = 'secrets' AND severity = 'critical') THEN 'fail'
    WHEN bool_or(category = 'secrets') THEN 'warn' ELSE 'pass' END AS secrets_status FROM findings GROUP BY source"""
)
def secrets_status(spark, sf_dir):
    return findings.secrets_status(document_findings(spark, sf_dir).withColumn("title", F.lit("")), "source")


@query(
    f"""SELECT o_orderstatus, severity, count(*) AS n FROM (SELECT *, {SEVERITY_SQL} AS severity FROM orders)
    WHERE severity IN ('critical', 'high') GROUP BY ALL"""
)
def min_severity(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("severity", severity())
    return findings.at_least(orders, F.col("severity"), "high").groupBy("o_orderstatus", "severity").agg(F.count("*").alias("n"))


@query(
    f"""WITH o AS (SELECT o_custkey, o_orderkey, {SEVERITY_SQL} AS severity, o_orderstatus AS title FROM orders),
    f AS (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS r FROM o),
    once AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey, title ORDER BY r, o_orderkey) = 1)
    SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY r, title)::INT AS priority, severity, title FROM once"""
)
def remediation_steps(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("line"), severity().alias("severity"), F.col("o_orderstatus").alias("title"))
    full = orders.select("*", F.lit("orders").alias("file"), F.lit("").alias("description"), F.lit("").alias("fix"))
    return findings.remediation(full, "o_custkey").select("o_custkey", "priority", "severity", "title")


@query(
    f"""SELECT o_orderstatus, o_orderkey, severity, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY
      CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderkey)::INT AS rn
      FROM (SELECT *, {SEVERITY_SQL} AS severity FROM orders)) WHERE rn <= 10"""
)
def severity_topk(spark, sf_dir):
    from pyspark.sql import Window

    from lumenspan.schemas import severity_rank

    orders = table(spark, sf_dir, "orders").withColumn("severity", severity())
    order = [severity_rank(F.col("severity")), F.desc("o_totalprice"), F.col("o_orderkey")]
    best = select.top_n(orders, ["o_orderstatus"], 10, *order)
    return best.select("o_orderstatus", "o_orderkey", "severity", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(*order)).alias("rn"))


@query(
    f"""WITH o AS (SELECT o_custkey, {SEVERITY_SQL} AS severity FROM orders), c AS (SELECT o_custkey, {COUNTS_SQL} FROM o GROUP BY 1),
    v AS (SELECT *, ['approve', 'comment', 'request_changes'][(o_custkey % 3)::INT + 1] AS claimed, ['low', 'medium', 'high', 'critical'][(o_custkey % 4)::INT + 1] AS risk FROM c),
    a AS (SELECT *, CASE WHEN claimed = 'request_changes' AND critical = 0 THEN 'comment' ELSE claimed END AS x,
      CASE WHEN risk = 'critical' AND critical < 2 THEN 'high' ELSE risk END AS y FROM v),
    b AS (SELECT *, CASE WHEN y = 'high' AND critical = 0 AND high < 2 THEN 'medium' ELSE y END AS z FROM a)
    SELECT o_custkey, claimed, CASE WHEN x = 'approve' AND (critical > 0 OR high >= 2) THEN 'comment' ELSE x END AS verdict,
      CASE WHEN z = 'medium' AND critical = 0 AND high = 0 THEN 'low' ELSE z END AS risk FROM b"""
)
def verdict_rules(spark, sf_dir):
    counts = findings.severity_counts(table(spark, sf_dir, "orders").withColumn("severity", severity()), "o_custkey")
    pick = lambda *names: F.get(F.array(*map(F.lit, names)), F.col("o_custkey") % len(names))
    claimed, risk = pick("approve", "comment", "request_changes"), pick("low", "medium", "high", "critical")
    c, h = F.col("critical"), F.col("high")
    return counts.select("o_custkey", claimed.alias("claimed"), findings.verdict(claimed, c, h).alias("verdict"), findings.demoted_risk(risk, c, h).alias("risk"))


@query(
    f"""WITH {FINDINGS_SQL}, d AS (SELECT doc_id, line, rule_id FROM findings WHERE severity IN ('critical', 'high')),
    e AS (SELECT doc_id, 0 AS line, 'LBL' AS rule_id FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, line, rule_id FROM findings)
    SELECT * FROM d UNION ALL SELECT DISTINCT doc_id, line::INT, rule_id FROM e ANTI JOIN d USING (doc_id, line, rule_id)"""
)
def fills_gap_merge(spark, sf_dir):
    found = document_findings(spark, sf_dir).select("doc_id", "line", "rule_id", "severity")
    first = found.where("severity in ('critical', 'high')").drop("severity")
    labels = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(0).alias("line"), F.lit("LBL").alias("rule_id"))
    second = labels.unionByName(found.drop("severity"))
    return findings.fill_gaps(first, second, ["doc_id", "line", "rule_id"])


@query(
    """WITH c AS (SELECT role, sum(length(text) // 4) AS tokens, count(*) AS n FROM conversations GROUP BY role)
    SELECT role, tokens::BIGINT AS tokens, round((tokens * 3.0::DOUBLE + n * 3.75::DOUBLE + n * 0.3::DOUBLE + tokens * 15.0::DOUBLE) / 1e6, 4) AS cost,
      round(n::DOUBLE / (tokens + 2 * n), 6) AS hit_rate FROM c"""
)
def token_cost(spark, sf_dir):
    tokens = findings.token_estimate(F.char_length("text"))
    rows = table(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(tokens).alias("tokens"), F.count("*").alias("n"))
    t, n = F.col("tokens"), F.col("n")
    return rows.select("role", "tokens", F.round(findings.cost_usd(t, n, n, t), 4).alias("cost"), F.round(findings.cache_hit_rate(t, n, n), 6).alias("hit_rate"))


@query(
    """SELECT l_orderkey, count(*) AS files, sum(l_quantity)::BIGINT AS lines, greatest(count(*) * 2 + sum(l_quantity)::BIGINT // 50, 10)::BIGINT AS minutes
    FROM lineitem GROUP BY l_orderkey"""
)
def review_time(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("files"), F.sum("l_quantity").cast("long").alias("lines"))
    return rows.select("*", findings.review_minutes(F.col("files"), F.col("lines")).cast("long").alias("minutes"))
