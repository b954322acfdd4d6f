"""Joins, set operations and graph searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.functions.workers import tasks_for
from lumenspan.operators import graph, joins, select, stores
from lumenspan.plans.shared import documents, query, table


@query(
    """SELECT event_id FROM events p WHERE event_type = 'purchase' AND EXISTS
    (SELECT 1 FROM events e WHERE e.user_id = p.user_id AND e.event_type = 'error' AND e.ts BETWEEN p.ts AND p.ts + INTERVAL 1 HOUR)"""
)
def interval_semi(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("until"))
    return joins.touched(bought, events.where("event_type = 'error'"), ["user_id"], "ts", "until", "ts").select("event_id")


@query(
    """WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY ALL)
    SELECT user_id, event_type, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS change, a.n AS old, b.n AS new
    FROM a FULL JOIN b USING (user_id, event_type)"""
)
def full_outer_diff(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stamp = lambda t: F.lit(t).cast("timestamp_ntz")
    sides = [events.where(w).groupBy("user_id", "event_type").agg(F.count("*").alias("n")) for w in (F.col("ts") < stamp("2024-01-16"), F.col("ts") >= stamp("2024-01-16"))]
    return joins.changes(*sides, ["user_id", "event_type"], "n")


@query(
    """WITH r AS (SELECT p_type, p_brand, p_partkey AS old, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS k FROM part WHERE p_size <= 25),
    a AS (SELECT p_type, p_brand, p_partkey AS new, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS k FROM part WHERE p_size > 25)
    SELECT p_type, p_brand, old, new FROM r JOIN a USING (p_type, p_brand, k)"""
)
def rename_pairing(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return joins.paired(part.where("p_size <= 25"), part.where("p_size > 25"), ["p_type", "p_brand"], "p_partkey")


@query(
    """WITH c AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R'), s AS (SELECT DISTINCT l_orderkey FROM lineitem SEMI JOIN c USING (l_partkey))
    SELECT o_orderkey FROM orders JOIN s ON o_orderkey = l_orderkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 5"""
)
def overlap_recent5(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    own = items.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").repartition(tasks_for(items), "o_orderkey")
    history = orders.join(own, "o_orderkey")
    changed = items.where("l_quantity = 50 and l_returnflag = 'R'")
    return stores.related(history, ["o_orderkey"], "l_partkey", changed, [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey")


@query(
    """SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 50)
    OR p_partkey IN (SELECT l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 0)"""
)
def or_semi(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    poor = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    used = table(spark, sf_dir, "lineitem").join(poor, "l_suppkey", "left_semi").select(F.col("l_partkey").alias("p_partkey"))
    return joins.either(part.select("p_partkey", "p_brand"), [(part.where("p_size = 50"), "p_brand"), (used, "p_partkey")]).select("p_partkey")


@query(
    """SELECT p_partkey, n_name FROM part JOIN (SELECT n_nationkey, n_name, ['ring', 'blue', 'red', 'o', 'small'][(n_nationkey % 5)::INT + 1] AS w FROM nation) n ON contains(lower(p_name), w)
    QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY n_nationkey) = 1"""
)
def theta_substring(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.get(F.array(*map(F.lit, ("ring", "blue", "red", "o", "small"))), F.col("n_nationkey") % 5).alias("w"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return joins.first_within(parts, nations, ["p_partkey"], F.lower("p_name"), "w", "n_nationkey").select("p_partkey", "n_name")


@query(
    """WITH w AS (SELECT lower(substr(n_name, 1, 3)) AS word FROM nation UNION SELECT substr(p_name, 1, 4) FROM part)
    SELECT word, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents d JOIN w ON contains(lower(d.text), word) GROUP BY 1"""
)
def words_in_texts(spark, sf_dir):
    """How many documents hold the beginning of a nation's or a part's name anywhere in their text."""
    nations = table(spark, sf_dir, "nation").select(F.lower(F.substring("n_name", 1, 3)).alias("word"))
    words = nations.union(table(spark, sf_dir, "part").select(F.substring("p_name", 1, 4))).distinct()
    found = joins.within(documents(spark, sf_dir).select("doc_id", "text"), words, ["doc_id"], F.lower("text"), "word")
    return found.groupBy("word").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def _edges(spark, sf_dir):
    """A graph with a hub, a cycle and a loop: regions, nations, suppliers, customers."""
    nation, key = table(spark, sf_dir, "nation"), lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    pair = lambda df, child, parent: df.select(child.alias("OBJ"), parent.alias("REFERENCED_OBJECT_NAME"))
    cycle = F.concat(F.lit("N"), ((F.col("n_nationkey") + 1) % 25).cast("string"))
    return (
        pair(nation, key("n", "n_nationkey"), key("r", "n_regionkey"))
        .union(pair(table(spark, sf_dir, "supplier"), key("s", "s_suppkey"), key("n", "s_nationkey")))
        .union(pair(table(spark, sf_dir, "customer"), key("c", "c_custkey"), key("N", "c_nationkey")))
        .union(pair(nation, key("n", "n_nationkey"), cycle))
        .union(pair(nation.where("n_nationkey = 3"), key("n", "n_nationkey"), key("n", "n_nationkey")))
    )


EDGES_SQL = """e AS (SELECT 'N' || n_nationkey AS child, 'R' || n_regionkey AS parent FROM nation UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
  UNION SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer UNION SELECT 'N' || n_nationkey, 'N' || ((n_nationkey + 1) % 25) FROM nation UNION SELECT 'N3', 'N3')"""
SEARCH_SQL = "WITH RECURSIVE {edges}, w AS (SELECT s AS start, s AS node, 0 AS hop FROM (VALUES {starts}) v(s) UNION SELECT start, {to}, hop + 1 FROM w JOIN e ON node = {frm} WHERE hop < {depth}) SELECT start, node, min(hop)::INT AS hop FROM w WHERE hop > 0 AND node <> start GROUP BY ALL"


def _search(spark, sf_dir, starts, mode, depth):
    return graph.search(_edges(spark, sf_dir), spark.createDataFrame([(s,) for s in starts], "start string"), depth, mode)


@query(SEARCH_SQL.format(edges=EDGES_SQL, starts="('R1')", frm="parent", to="child", depth=3))
def bfs_down(spark, sf_dir):
    return _search(spark, sf_dir, ["r1"], "downstream", 3)


@query(SEARCH_SQL.format(edges=EDGES_SQL, starts="('C7')", frm="child", to="parent", depth=4))
def bfs_up(spark, sf_dir):
    return _search(spark, sf_dir, ["c7"], "upstream", 4)


@query(SEARCH_SQL.format(edges=EDGES_SQL, starts="('N3'), ('S5'), ('N9'), ('nothing')", frm="child", to="parent", depth=3))
def bfs_multi(spark, sf_dir):
    return _search(spark, sf_dir, ["n3", "S5", "N9", "NONE"], "upstream", 3)


@query(f"WITH {EDGES_SQL}, p AS (SELECT DISTINCT parent AS node FROM e) SELECT node FROM p WHERE node NOT IN (SELECT child FROM e)")
def graph_roots(spark, sf_dir):
    edges = _edges(spark, sf_dir).select(F.upper("OBJ").alias("child"), F.upper("REFERENCED_OBJECT_NAME").alias("parent"))
    return graph.roots(edges)


@query(
    f"""WITH RECURSIVE {EDGES_SQL}, r AS (SELECT DISTINCT parent AS node FROM e WHERE parent NOT IN (SELECT child FROM e)),
    p AS (SELECT [node] AS path, false AS cycle FROM r UNION ALL SELECT list_append(path, child), list_contains(path, child) FROM p JOIN e ON e.parent = path[-1] WHERE NOT cycle AND len(path) <= 10)
    SELECT array_to_string(path, '>') AS path, cycle FROM p"""
)
def graph_paths(spark, sf_dir):
    """All paths of up to ten edges down from the regions, around the ring of nations."""
    edges = _edges(spark, sf_dir).select(F.upper("OBJ").alias("child"), F.upper("REFERENCED_OBJECT_NAME").alias("parent"))
    return graph.paths(edges, 10).select(F.array_join("path", ">").alias("path"), "cycle")


@query(f"WITH {EDGES_SQL}, n AS (SELECT child AS name FROM e UNION SELECT parent FROM e) SELECT name FROM n WHERE contains(name, 'S1') ORDER BY name LIMIT 8")
def similar_objects(spark, sf_dir):
    return graph.suggestions(_edges(spark, sf_dir), "db.schema.s1")


LINEAGE_SQL = """WITH u AS (SELECT o_custkey AS k, l_orderkey AS f, l_partkey % 40 AS t, CASE WHEN l_linenumber = 1 THEN 'CREATE' ELSE 'READ' END AS op FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  m AS (SELECT DISTINCT k, f, t FROM u WHERE op = 'CREATE'), r AS (SELECT DISTINCT k, f, t FROM u WHERE op = 'READ'), known AS (SELECT DISTINCT k, t FROM m),
  p AS (SELECT DISTINCT m.k, m.t AS made, r.t AS read FROM m JOIN r ON m.k = r.k AND m.f = r.f AND m.t <> r.t SEMI JOIN known ON known.k = m.k AND known.t = r.t),
  a AS (SELECT k, made AS t, list(read ORDER BY read) AS up FROM p GROUP BY ALL), b AS (SELECT k, read AS t, list(made ORDER BY made) AS down FROM p GROUP BY ALL)
  SELECT k, t, coalesce(array_to_string(up, ','), '') AS upstream, coalesce(array_to_string(down, ','), '') AS downstream FROM a FULL JOIN b USING (k, t)"""


@query(LINEAGE_SQL.replace("l_partkey % 40 AS t", "lpad((l_partkey % 40)::VARCHAR, 2, '0') AS t"))
def pr_lineage_pairs(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    usages = items.select(
        F.col("o_custkey").alias("k"), F.col("l_orderkey").alias("file"), F.lpad((F.col("l_partkey") % 40).cast("string"), 2, "0").alias("t"),
        F.when(F.col("l_linenumber") == 1, "CREATE").otherwise("READ").alias("operation"),
    )
    return graph.change_lineage(usages, "k", "t").select("k", "t", F.array_join("upstream", ",").alias("upstream"), F.array_join("downstream", ",").alias("downstream"))


SETS_SQL = """WITH a AS (SELECT o_custkey AS k, l_partkey % 50 AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) = {a} GROUP BY ALL),
  b AS (SELECT o_custkey AS k, l_partkey % 50 AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) = {b} GROUP BY ALL)"""


def _sets(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    year = F.year("o_orderdate")
    own = lambda y: F.collect_set(F.when(year == y, F.col("l_partkey") % 50))  # noqa: E731  fifty values at most
    return items.groupBy(F.col("o_custkey").alias("k")).agg(own(1996).alias("a"), own(1997).alias("b"))


@query("SELECT p_brand AS feature_name, count(DISTINCT l_suppkey) AS repos, count(*) AS consumers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def catalog_counts(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("feature_name"))
    used = table(spark, sf_dir, "lineitem").join(part, "l_partkey").select("feature_name", F.col("l_suppkey").alias("repo"))
    return stores.consumer_counts(used)


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def capped_groups(spark, sf_dir):
    return select.top_n(table(spark, sf_dir, "orders"), ["o_custkey"], 2, F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey")
