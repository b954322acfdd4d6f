"""Reports, catalogs and histories made of the tables' rows, through the operators that read them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.functions.workers import spread, tasks_for
from lumenspan.operators import features, findings, index, lineage, pipelines, reports, schema_changes, select, stores
from lumenspan.plans.groups import LATEST_SQL, TOKENS_SQL, _index, _latest
from lumenspan.plans.joins import SETS_SQL, _sets
from lumenspan.plans.shared import SEVERITY_SQL, query, severity, table
from lumenspan.streaming import events


def _joined(rows, key, order, block):
    """Blocks of text of a key in order as one text."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))), lambda x: x["b"])
    return rows.groupBy(key).agg(F.array_join(listed, "").alias("text"))


def _said(*parts):
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.col(p).cast("string") for i, p in enumerate(parts)])


@query(
    f"""SELECT o_custkey, upper({SEVERITY_SQL}) AS severity, 'Order ' || o_orderkey AS title, 'orders.py:' || o_orderkey AS location,
      'Placed by ' || o_custkey || '.' || chr(10) || 'Status ' || o_orderstatus AS description, 'Call ' || o_custkey AS fix FROM orders"""
)
def evaluation_findings(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("severity", F.upper(severity()))
    block = _said(
        "### [", "severity", "] Order ", "o_orderkey", "\n**Location:** orders.py:", "o_orderkey", "\nPlaced by ", "o_custkey", ".\nStatus ", "o_orderstatus",
        "\n\n**Fix:** Call ", "o_custkey", "\n\n",
    )
    text = _joined(orders, "o_custkey", "o_orderkey", block)
    return text.select("o_custkey", F.explode(reports.evaluation_findings(F.col("text"))).alias("f")).select("o_custkey", "f.*")


@query(
    f"""SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::VARCHAR AS priority, upper({SEVERITY_SQL}) AS severity, 'Order ' || o_orderkey AS title,
      'a' || o_orderkey || '.py' AS files, 'Status' || chr(10) || o_orderstatus AS problem, 'Pay' AS change_plan, CASE WHEN o_orderkey % 2 = 0 THEN 'Paid by ' || o_custkey ELSE '' END AS acceptance_check FROM orders"""
)
def remediation_plan(spark, sf_dir):
    orders = select.top_n(table(spark, sf_dir, "orders").withColumn("severity", F.upper(severity())), ["o_custkey", "o_orderkey"], 1, "o_orderkey")
    from pyspark.sql import Window

    ranked = orders.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    block = _said("### ", "n", ". [", "severity", "] Order ", "o_orderkey", "\n**Files:** a", "o_orderkey", ".py\n**Problem:** Status\n", "o_orderstatus", "\n**Change plan:** Pay\n")
    check = F.when(F.col("o_orderkey") % 2 == 0, _said("**Acceptance check:** Paid by ", "o_custkey", "\n\n")).otherwise("\n")
    text = _joined(ranked, "o_custkey", "o_orderkey", F.concat(block, check))
    return text.select("o_custkey", F.explode(reports.remediation_plan(F.col("text"))).alias("s")).select("o_custkey", "s.*")


@query("SELECT n_regionkey, n_name AS name, 'Nation number ' || n_nationkey AS purpose, 'A' || n_regionkey AS security, 'pass' AS secrets, 'B+' AS pii FROM nation")
def evaluated_modules(spark, sf_dir):
    block = _said("### `", "n_name", "`\nNation number ", "n_nationkey", "\nand more of it\n\n")
    text = _joined(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", block)
    marked = text.withColumn("text", F.concat(F.lit("**Security:** A"), F.col("n_regionkey").cast("string"), F.lit(" | Secrets: pass | PII: B+\n\n"), F.col("text")))
    grades = reports.grades(F.col("text"))
    return marked.select("n_regionkey", grades.alias("g"), F.explode(reports.evaluated_modules(F.col("text"))).alias("m")).select("n_regionkey", "m.*", "g.*")


OBJECT_SQL = "CASE WHEN l_linenumber = 7 THEN l_returnflag ELSE 'S.T' || (l_suppkey % 9) || '.c' || lpad((l_partkey % 23)::VARCHAR, 2, '0') END"


@query(
    f"""WITH c AS (SELECT CASE WHEN contains(n, '.') THEN regexp_extract(n, '^(.*)\\.', 1) ELSE '—' END AS object, regexp_extract(n, '([^.]*)$', 1) AS col FROM (SELECT {OBJECT_SQL} AS n FROM lineitem))
    SELECT object, count(*) AS refs, array_to_string(list_sort(list(DISTINCT col))[:5], ',') AS columns, greatest(count(DISTINCT col) - 5, 0)::BIGINT AS more FROM c GROUP BY object"""
)
def consumers_by_object(spark, sf_dir):
    name = F.when(F.col("l_linenumber") == 7, F.col("l_returnflag")).otherwise(
        F.concat(F.lit("S.T"), (F.col("l_suppkey") % 9).cast("string"), F.lit(".c"), F.lpad((F.col("l_partkey") % 23).cast("string"), 2, "0"))
    )
    found = schema_changes.consumers_by_object(table(spark, sf_dir, "lineitem").select(name.alias("name")))
    return found.select("object", "refs", F.array_join("columns", ",").alias("columns"), "more")


@query("SELECT o_custkey, count(*) AS agents, count(*) FILTER (o_orderstatus = 'P') AS failed, coalesce(sum(o_orderkey % 4) FILTER (o_orderstatus <> 'P'), 0)::BIGINT AS findings FROM orders GROUP BY 1")
def agent_totals(spark, sf_dir):
    error = F.when(F.col("o_orderstatus") == "P", "timeout")
    agents = table(spark, sf_dir, "orders").select("o_custkey", error.alias("error"), F.array_repeat(F.lit("x"), (F.col("o_orderkey") % 4).cast("int")).alias("findings"))
    return findings.agent_totals(agents, "o_custkey")


@query(
    """WITH c AS (SELECT DISTINCT 'f' || (p_partkey % 500) AS name, 'features/brand_' || substr(p_brand, 7) || '_features.py' AS file, p_size AS line FROM part WHERE p_size < 40),
    e AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY name ORDER BY file DESC, line DESC) = 1),
    j AS (SELECT n_name AS job, ['brand_', 'brand_1', 'nothing'][n_nationkey % 3 + 1] || CASE n_nationkey % 3 WHEN 0 THEN (n_nationkey % 26)::VARCHAR ELSE '' END AS grp FROM nation WHERE n_nationkey % 2 = 0)
    SELECT name AS feature_name, replace(replace(file, 'features/', ''), '_features.py', '') AS feature_group, coalesce(array_to_string(list_sort(list(DISTINCT job) FILTER (job IS NOT NULL)), ','), '') AS load_jobs
    FROM e LEFT JOIN j ON contains(file, grp) GROUP BY ALL"""
)
def feature_catalog(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    columns = part.select(
        F.concat(F.lit("f"), (F.col("p_partkey") % 500).cast("string")).alias("column_name"), F.when(F.col("p_size") < 40, "added").otherwise("removed").alias("change_type"),
        F.concat(F.lit("features/brand_"), F.expr("substring(p_brand, 7)"), F.lit("_features.py")).alias("file"), F.col("p_size").alias("line"),
    )
    n = F.col("n_nationkey")
    group = F.when(n % 3 == 0, F.concat(F.lit("brand_"), (n % 26).cast("string"))).when(n % 3 == 1, "brand_1").otherwise("nothing")
    jobs = table(spark, sf_dir, "nation").select(F.col("n_name").alias("job_name"), F.when(n % 2 == 0, "load").otherwise("aggregate").alias("job_kind"), F.array(group).alias("feature_groups"))
    return features.catalog(columns, jobs, "repo", 0.0).select("feature_name", "feature_group", F.array_join("load_jobs", ",").alias("load_jobs"))


@query(
    """WITH h AS (SELECT r_name AS upstream, n_name || '.task' AS downstream, CASE WHEN r_regionkey % 3 = 0 THEN 'silent_cascade' WHEN r_regionkey % 2 = 1 THEN 'schedule_conflict' ELSE 'missing_output' END AS risk FROM nation JOIN region ON n_regionkey = r_regionkey),
    f AS (SELECT n_nationkey AS ord, 'jobs/' || n_name || '.yml' AS path, n_name AS job FROM nation WHERE n_nationkey < 10 AND n_nationkey <> 2)
    SELECT upstream, downstream, path AS downstream_file, risk FROM h LEFT JOIN f ON contains(downstream, job) QUALIFY row_number() OVER (PARTITION BY upstream, downstream ORDER BY ord) = 1"""
)
def downstream_files(spark, sf_dir):
    nation, r = table(spark, sf_dir, "nation"), F.col("r_regionkey")
    region = table(spark, sf_dir, "region")
    changed = region.select(F.lit("p").alias("pr_id"), F.col("r_name").alias("job_name"), F.when(r % 3 == 0, False).when(r % 3 == 1, True).alias("fail_flag"), (r % 2 == 1).alias("schedule_changed"))
    depends = nation.join(region, F.col("n_regionkey") == r).select(F.col("r_name").alias("upstream"), F.concat("n_name", F.lit(".task")).alias("downstream"))
    files = nation.where("n_nationkey < 10 and n_nationkey <> 2").select(
        F.col("n_nationkey").alias("ord"), F.concat(F.lit("jobs/"), "n_name", F.lit(".yml")).alias("path"), F.concat(F.lit("name: "), "n_name", F.lit("\n")).alias("content")
    )
    return pipelines.dependency_risks(changed, depends, files).drop("pr_id")


@query(
    """SELECT user_id, event_type, event_id % 50 AS line, max(event_id) AS pos FROM events GROUP BY ALL"""
)
def last_of_line(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.lit("f").alias("file"), F.col("event_type").alias("change"), (F.col("event_id") % 50).alias("line"), F.col("event_id").alias("pos"))
    return features.last_of_line(rows, "user_id").select("user_id", F.col("change").alias("event_type"), "line", "pos")


@query(
    """WITH r AS (SELECT l_partkey AS feature_name, l_suppkey AS repo, l_orderkey AS file, l_linenumber AS line FROM lineitem), f AS (SELECT * FROM r WHERE line <= 3), o AS (SELECT DISTINCT * FROM r WHERE line >= 3)
    SELECT * FROM f UNION ALL SELECT * FROM o ANTI JOIN f USING (feature_name, repo, file, line)"""
)
def catalog_consumers(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("feature_name"), F.col("l_suppkey").alias("repo"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"))
    none = rows.select("feature_name", F.lit(0).alias("built_at")).limit(0)
    return stores.merge_catalog(none, none, rows.where("line >= 3"), rows.where("line <= 3"))[1]


REVIEWS_SQL = f"""WITH l AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'request_changes' WHEN 'signup' THEN 'comment' ELSE 'unknown' END AS verdict FROM events QUALIFY {LATEST_SQL} = 1)"""
KPI_SQL = """count(*) AS total, count(*) FILTER (verdict = 'approve') AS approved, count(*) FILTER (verdict = 'request_changes') AS blocked, count(*) FILTER (verdict = 'comment') AS comment,
  count(*) FILTER (event_type IN ('purchase', 'error')) AS critical, round(coalesce(sum(value), 0), 2) AS total_cost"""


def _reviews(spark, sf_dir):
    """The latest event of each user in the role of a review."""
    kind = F.col("event_type")
    verdict = F.when(kind == "purchase", "approve").when(kind == "error", "request_changes").when(kind == "signup", "comment").otherwise("unknown")
    risk = F.when(kind == "purchase", "CRITICAL").when(kind == "error", "HIGH").otherwise("LOW")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return _latest(spark, sf_dir, 1).select("user_id", verdict.alias("verdict"), risk.alias("risk"), F.col("value").alias("cost_usd"), seconds.alias("timestamp"))


@query(f"{REVIEWS_SQL} SELECT {KPI_SQL} FROM l")
def kpi_dashboard(spark, sf_dir):
    return reports.review_kpis(_reviews(spark, sf_dir))


@query(f"{REVIEWS_SQL}, m AS (SELECT max(ts) AS now FROM events) SELECT days, {KPI_SQL} FROM l, m, (VALUES (1), (7), (30)) d(days) WHERE ts >= now - to_days(days) GROUP BY days")
def age_filter_kpi(spark, sf_dir):
    now = table(spark, sf_dir, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)).first()[0] or 0.0  # one number
    rows, out = _reviews(spark, sf_dir), None
    for days in (1, 7, 30):
        figures = reports.review_kpis(reports.filtered(rows, days=days, now=F.lit(now))).where("total > 0").withColumn("days", F.lit(days))
        out = figures if out is None else out.union(figures)
    return out


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_custkey IS NOT NULL)")
def anti_unreviewed(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select(F.lit("r").alias("repo"), F.col("o_custkey").alias("pr_number"))
    asked = table(spark, sf_dir, "customer").select(F.lit("r").alias("repo"), F.col("c_custkey").alias("pr_number"))
    return events.unreviewed(asked, seen).select(F.col("pr_number").alias("c_custkey"))


@query(
    SETS_SQL.format(a=1996, b=1997)
    + """, k AS (SELECT DISTINCT o_custkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    d AS (SELECT k, p, bool_or(s = 'a') AS ina, bool_or(s = 'b') AS inb FROM (SELECT k, p, 'a' AS s FROM a UNION ALL SELECT k, p, 'b' FROM b) GROUP BY ALL)
    SELECT k, count(p) FILTER (inb AND NOT ina) AS added, count(p) FILTER (ina AND NOT inb) AS removed, count(p) FILTER (ina AND inb) AS modified FROM k LEFT JOIN d USING (k) GROUP BY k"""
)
def set_diff(spark, sf_dir):
    named = zip(pipelines.set_changes(F.col("b"), F.col("a")), ("added", "removed", "modified"), strict=True)
    return _sets(spark, sf_dir).select("k", *[F.size(c).cast("long").alias(n) for c, n in named])


@query(
    SETS_SQL.format(a=1996, b=1997)
    + """, x AS ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a)), k AS (SELECT DISTINCT o_custkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT k, coalesce(string_agg(lpad(p::VARCHAR, 2, '0'), ',' ORDER BY p), '') AS changed FROM k LEFT JOIN x USING (k) GROUP BY k"""
)
def sym_diff(spark, sf_dir):
    changed = pipelines.on_one_side(F.col("a"), F.col("b"))
    return _sets(spark, sf_dir).select("k", F.array_join(F.transform(changed, lambda x: F.lpad(x.cast("string"), 2, "0")), ",").alias("changed"))


USAGES_SQL = """WITH u AS (SELECT 'T' || (l_partkey % 300) AS object, CASE l_returnflag WHEN 'R' THEN 'CREATE' WHEN 'A' THEN 'DROP' ELSE CASE WHEN l_linenumber = 1 THEN 'WRITE' ELSE 'READ' END END AS operation,
  lpad(l_orderkey::VARCHAR, 9, '0') AS file, l_linenumber AS line, l_suppkey % 7 AS up FROM lineitem)"""


@query(
    f"""{USAGES_SQL} SELECT object, coalesce(arg_max(operation, (file, line, operation)) FILTER (operation IN ('CREATE', 'DROP')), arg_min(operation, (file, line, operation))) AS operation,
      array_to_string(list_sort(list(DISTINCT up::VARCHAR)), ',') AS upstream, count(*) AS uses FROM u GROUP BY object"""
)
def usage_labels(spark, sf_dir):
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("t"), (F.col("l_partkey") % 300).cast("string")).alias("raw_ref"),
        F.when(flag == "R", "CREATE").when(flag == "A", "DROP").when(F.col("l_linenumber") == 1, "WRITE").otherwise("READ").alias("operation"),
        F.lpad(F.col("l_orderkey").cast("string"), 9, "0").alias("file"), F.col("l_linenumber").alias("line"),
        F.array((F.col("l_suppkey") % 7).cast("string")).alias("upstream"), F.array().cast("array<string>").alias("downstream"),
    )
    return lineage.merged(rows).select("object", "operation", F.array_join(F.sort_array("upstream"), ",").alias("upstream"), "uses")


@query(
    f"""WITH {TOKENS_SQL}, i AS (SELECT * FROM t WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id, line) <= 50),
    w AS (SELECT DISTINCT unnest(string_split_regex(text, '[^A-Za-z0-9_]+')) AS name FROM benchmark)
    SELECT name, count(*) AS total, min(doc_id) AS first_doc FROM i SEMI JOIN w USING (name) GROUP BY name"""
)
def index_search(spark, sf_dir):
    from lumenspan.operators import lines

    capped = select.top_n(_index(spark, sf_dir), ["name"], 50, "doc_id", "line")
    places = capped.select(F.lit("all").alias("repo"), "name", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("file"), "line", F.lit("word").alias("kind"), F.lit("").alias("snippet"))
    wanted = table(spark, sf_dir, "benchmark").select(F.explode(lines.tokens(F.col("text"))).alias("name")).distinct()
    return index.search(places, wanted).select("name", "total", F.col("matches")[0]["file"].cast("long").alias("first_doc"))


DIFF_SQL = """WITH i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n,
    CASE l_returnflag WHEN 'R' THEN 'removed' WHEN 'A' THEN 'added' ELSE 'context' END AS change,
    CASE WHEN l_partkey % 5 = 0 THEN '-- part ' WHEN l_partkey % 5 = 1 THEN '++ part ' ELSE 'part ' END || l_partkey AS text FROM lineitem)"""


@query(
    f"""{DIFF_SQL} SELECT l_orderkey::VARCHAR AS pr_id, 'o/' || l_orderkey || '.sql' AS file, 1 AS hunk_id, change, text,
      CASE WHEN change <> 'added' THEN 9 + count(*) FILTER (change <> 'added') OVER w END::INT AS old_line,
      CASE WHEN change <> 'removed' THEN 19 + count(*) FILTER (change <> 'removed') OVER w END::INT AS new_line
    FROM i WINDOW w AS (PARTITION BY l_orderkey ORDER BY n)"""
)
def diff_cursor(spark, sf_dir):
    """A diff of each order: its line items as added, removed and kept lines, some of which look like file headers."""
    from pyspark.sql import Window

    from lumenspan.operators import lines

    order = Window.partitionBy("pr_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    kind, part = F.col("l_returnflag"), F.col("l_partkey")
    sign = F.when(kind == "R", "-").when(kind == "A", "+").otherwise(" ")
    text = F.concat(F.when(part % 5 == 0, "-- part ").when(part % 5 == 1, "++ part ").otherwise("part "), part.cast("string"))
    given = table(spark, sf_dir, "lineitem")
    own = given.withColumn("pr_id", F.col("l_orderkey").cast("string")).repartition(tasks_for(given), "pr_id")  # the only shuffle
    items = own.select("pr_id", F.row_number().over(order).alias("n"), sign.alias("sign"), F.concat(sign, text, F.lit("\n")).alias("raw"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "raw"))), lambda x: x["raw"]), "")
    grouped = items.groupBy("pr_id").agg(F.count_if(F.col("sign") != "+").alias("old"), F.count_if(F.col("sign") != "-").alias("new"), body.alias("body"))
    name = F.concat(F.lit("o/"), "pr_id", F.lit(".sql"))
    head = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.lit("\n+++ b/"), name)
    hunk = F.format_string("\n@@ -10,%d +20,%d @@\n", "old", "new")
    diffs = grouped.select("pr_id", F.concat(head, hunk, "body").alias("diff"))
    return lines.diff_cursor(lines.diff_lines(diffs)).drop("pos")


@query(
    """SELECT o_custkey, 'Order ' || o_orderkey AS heading, 'Status ' || o_orderstatus || chr(10) || '```' || chr(10) || '### fenced' || chr(10) || '```' || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'end' ELSE '' END AS body FROM orders"""
)
def fence_sections(spark, sf_dir):
    from lumenspan.operators import lines

    block = F.concat(_said("### Order ", "o_orderkey", "\nStatus ", "o_orderstatus", "\n```\n### fenced\n```\n"), F.when(F.col("o_orderkey") % 2 == 0, "end\n\n").otherwise("\n"))
    text = _joined(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", block)
    return lines.sections(lines.explode_lines(text, "text", "o_custkey"), "o_custkey").select("o_custkey", "heading", "body")


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'x' || event_id WHEN 1 THEN 'y' || event_id END AS first, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS n FROM events"""
)
def list_or_object(spark, sf_dir):
    from lumenspan.functions import text as T

    kind = F.col("event_id") % 3
    text = F.when(kind == 0, _said('[{"name": "x', "event_id", '"}, {"name": "z"}]')).when(kind == 1, _said('```json\n{"name": "y', "event_id", '"}\n```')).otherwise("broken")
    parsed = table(spark, sf_dir, "events").select("event_id", T.list_or_object(text, "struct<name: string>").alias("a"))
    one = F.get("a", F.lit(0))["name"]
    return parsed.select("event_id", one.alias("first"), F.when(one.isNotNull(), F.size("a")).alias("n"))


SAVED_SQL = """WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'request_changes' ELSE 'comment' END AS verdict,
    CASE event_type WHEN 'error' THEN 'CRITICAL' ELSE 'LOW' END AS risk, (event_id % 100) / 100.0 AS cost FROM events),
  l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)"""


def _saved(spark, sf_dir):
    """Each event as a saved review of its user, and what is read from these."""
    kind = F.col("event_type")
    verdict = F.when(kind == "purchase", "✅ Looks okay").when(kind == "error", "❌ Please revisit").otherwise("💬 Needs attention")
    rows = spread(table(spark, sf_dir, "events")).withColumn("said", verdict).withColumn("risk", F.when(kind == "error", "CRITICAL").otherwise("LOW")).withColumn("cents", F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"))
    text = _said(
        "---\nrepo: acme/shop\npr: ", "user_id", "\ntitle: Change ", "user_id", "\ndate: 2024-05-01 10:00 UTC\ntimestamp_utc: ", "event_id", "\ncost_usd: 0.", "cents",
        "\nrequested_by: ann\n---\n## Code Review\n\n**Review:** ", "said", " &nbsp;·&nbsp; **Risk:** `", "risk", "`\n",
    )
    files = rows.select(_said("s/", "event_id", ".md").alias("path"), text.alias("text"), F.lit("2024-06-01").cast("timestamp").alias("mtime"))
    return reports.grouped_reviews(reports.reviews(files))


@query(f"{SAVED_SQL} SELECT user_id::VARCHAR AS pr, verdict, risk, (SELECT least(count(*), 3) FROM events x WHERE x.user_id = l.user_id)::INT AS history FROM l")
def review_history(spark, sf_dir):
    return _saved(spark, sf_dir).select("pr", "verdict", "risk", F.size("history").alias("history"))


@query(
    f"""{SAVED_SQL} SELECT count(*) AS total, count(*) FILTER (verdict = 'approve') AS approved, count(*) FILTER (verdict = 'request_changes') AS blocked, count(*) FILTER (verdict = 'comment') AS comment,
    count(*) FILTER (risk = 'CRITICAL') AS critical, round(sum(cost)::DOUBLE, 2) AS total_cost FROM l"""
)
def review_kpis(spark, sf_dir):
    return reports.review_kpis(_saved(spark, sf_dir))
