"""Latest rows, first rows, caps, budgets and stores."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lumenspan.functions import text as T
from lumenspan.operators import features, graph, lines, select, stores
from lumenspan.plans.shared import documents, query, severity, table

LATEST_SQL = "row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id)"


@query(f"SELECT user_id, event_id, event_type, value FROM events QUALIFY {LATEST_SQL} = 1")
def latest_per_key(spark, sf_dir):
    return _latest(spark, sf_dir).select("user_id", "event_id", "event_type", "value")


def _latest(spark, sf_dir, n=3):
    events = table(spark, sf_dir, "events")
    return stores.latest_with_history(events, ["user_id"], [F.desc("ts"), F.col("event_id")], ["ts", "event_id", "event_type", "value"], n)


@query(
    f"""SELECT user_id, array_to_string(list(event_id ORDER BY rn), ',') AS history, count(*)::INT AS n
    FROM (SELECT user_id, event_id, {LATEST_SQL} AS rn FROM events) WHERE rn <= 3 GROUP BY user_id"""
)
def history3(spark, sf_dir):
    ids = F.transform("history", lambda x: x["event_id"].cast("string"))
    return _latest(spark, sf_dir).select("user_id", F.array_join(ids, ",").alias("history"), F.size("history").alias("n"))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def keep_first_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return select.keep_first(docs, ["key"], "doc_id").select("doc_id")


@query(
    """SELECT user_id, array_to_string(list(event_type ORDER BY first, event_type), ',') AS types
    FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id"""
)
def ordered_distinct(spark, sf_dir):
    return graph.ordered_once(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id").select("user_id", F.array_join("event_types", ",").alias("types"))


@query("SELECT p_type AS name, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, min(p_partkey), p_type LIMIT 15")
def ext_top15(spark, sf_dir):
    return select.most_common(table(spark, sf_dir, "part"), F.col("p_type"), 15, "name", "p_partkey")


@query("SELECT DISTINCT regexp_extract(url, '://[^/]*/([^/?#]+)', 1) AS dir FROM pages WHERE regexp_extract(url, '://[^/]*/([^/?#]+)', 1) <> '' ORDER BY dir LIMIT 20")
def top_dirs(spark, sf_dir):
    name = F.regexp_extract("url", "://[^/]*/([^/?#]+)", 1)
    return table(spark, sf_dir, "pages").select(name.alias("dir")).where("dir <> ''").distinct().orderBy("dir").limit(20)


def _hosts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, "://([^/?#]*)", 1).alias("host"), F.char_length("html").alias("size"), url)


@query(
    """WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, url FROM pages),
    r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY CASE WHEN contains(url, '/en/') THEN 0 WHEN ends_with(url, '.html') THEN 1 ELSE 2 END, page_id) AS rn FROM p),
    m AS (SELECT host, count(*)::INT AS files, count(*) + CASE WHEN starts_with(host, 'blog.') THEN 50.0::DOUBLE ELSE 0 END AS score FROM r WHERE rn <= 12 GROUP BY host)
    SELECT host, files, score FROM m WHERE files >= 2 OR starts_with(host, 'blog.') ORDER BY score DESC, host LIMIT 6"""
)
def module_partition(spark, sf_dir):
    url = F.col("url")
    picked = select.priority_fill(_hosts(spark, sf_dir), [url.contains("/en/"), url.endswith(".html"), F.lit(True)], 12, ["page_id"], ["host"])
    blog = F.col("host").startswith("blog.")
    plans = picked.groupBy("host").agg(F.count("*").cast("int").alias("files"))
    scored = plans.withColumn("score", F.col("files") + F.when(blog, 50.0).otherwise(0.0)).where((F.col("files") >= 2) | blog)
    return scored.orderBy(F.desc("score"), "host").limit(6)


@query(
    """SELECT doc_id, priority FROM (SELECT doc_id, CASE WHEN contains(text, 'icense') THEN 0 WHEN contains(text, '@') THEN 1 WHEN lang = 'de' THEN 2 END::INT AS priority FROM documents)
    WHERE priority IS NOT NULL ORDER BY priority, doc_id LIMIT 60"""
)
def priority_fill(spark, sf_dir):
    text = F.col("text")
    docs = table(spark, sf_dir, "documents")
    return select.priority_fill(docs, [text.contains("icense"), text.contains("@"), F.col("lang") == "de"], 60, ["doc_id"]).select("doc_id", "priority")


@query(
    """WITH d AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
    b AS (SELECT *, coalesce(sum(CASE WHEN n <= 30 THEN least(n_chars, 5000) ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
    SELECT doc_id, CASE WHEN n > 30 THEN 'file_cap' WHEN before >= 40000 THEN 'byte_cap' WHEN n_chars > 5000 THEN 'truncated' ELSE 'ok' END AS status FROM b"""
)
def byte_budget(spark, sf_dir):
    return select.byte_budget(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], F.col("n_chars"), 40_000, 30, 5_000).select("doc_id", "status")


RUN_SQL = "sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND {} )"


@query(f"SELECT doc_id FROM documents QUALIFY {RUN_SQL.format('CURRENT ROW')} <= 60000")
def within_budget(spark, sf_dir):
    return select.within_budget(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], F.col("n_chars"), 60_000).select("doc_id")


@query(f"SELECT doc_id FROM documents QUALIFY coalesce({RUN_SQL.format('1 PRECEDING')}, 0) <= 60000")
def until_over(spark, sf_dir):
    return select.until_over(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], F.col("n_chars"), 60_000).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE lang = 'en' QUALIFY coalesce({RUN_SQL.format('1 PRECEDING')}, 0) < 60000")
def until_reached(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source", "n_chars")
    return select.until_over(docs, ["source"], ["doc_id"], F.col("n_chars"), 60_000, strict=True).select("doc_id")


@query(
    """SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS calls FROM events"""
)
def rate_window(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    by = Window.partitionBy("user_id").orderBy(seconds).rangeBetween(-6 * 3600 * 1_000_000, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.count("*").over(by).alias("calls"))


UPSERT_SQL = """WITH o AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-20'), n AS (SELECT * REPLACE (value + 1 AS value) FROM events WHERE ts >= TIMESTAMP '2024-01-10')
  SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, 0 AS side FROM o UNION ALL SELECT *, 1 FROM n)
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC, side DESC) = 1"""


@query(UPSERT_SQL)
def upsert_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    stamp = lambda t: F.lit(t).cast("timestamp_ntz")
    old, new = events.where(F.col("ts") < stamp("2024-01-20")), events.where(F.col("ts") >= stamp("2024-01-10"))
    kept = stores.upsert(old, new.withColumn("value", F.col("value") + 1), ["user_id", "event_type"], "event_id")
    return kept.drop("ts").withColumn("value", F.round("value", 6))


@query(
    """WITH o AS (SELECT p_brand AS k, min(p_partkey) AS built FROM part WHERE p_size < 30 GROUP BY 1), f AS (SELECT p_type AS k, max(p_partkey) AS built FROM part GROUP BY 1
      UNION ALL SELECT p_brand, max(p_partkey) FROM part WHERE p_size > 45 GROUP BY 1)
    SELECT k AS feature_name, coalesce(o.built, f.built) AS built_at, CASE WHEN f.k IS NULL THEN 'old' ELSE 'fresh' END AS origin FROM f FULL JOIN o USING (k)"""
)
def catalog_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    entry = lambda df, name, how: df.groupBy(F.col(name).alias("feature_name")).agg(how("p_partkey").alias("built_at"))
    old = entry(part.where("p_size < 30"), "p_brand", F.min).withColumn("origin", F.lit("old"))
    fresh = entry(part, "p_type", F.max).union(entry(part.where("p_size > 45"), "p_brand", F.max)).withColumn("origin", F.lit("fresh"))
    none = old.select("feature_name", F.lit("").alias("repo"), F.lit("").alias("file"), F.lit(0).alias("line")).limit(0)
    return stores.merge_catalog(old, fresh, none, none)[0]


@query(
    """WITH o AS (SELECT l_partkey, l_suppkey, l_orderkey FROM lineitem WHERE l_linenumber = 1), n AS (SELECT l_partkey, l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem WHERE l_linenumber > 1 GROUP BY ALL)
    SELECT * FROM o UNION ALL SELECT n.* FROM n ANTI JOIN o USING (l_partkey, l_suppkey)"""
)
def insert_absent(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    first, second = (items.where(w).drop("l_linenumber") for w in ("l_linenumber = 1", "l_linenumber > 1"))
    return stores.insert_absent(first, second, ["l_partkey", "l_suppkey"])


TOKENS_SQL = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line FROM documents),
  t AS (SELECT DISTINCT doc_id, line, unnest(string_split_regex(content, '[^A-Za-z0-9_]+')) AS name FROM l)"""


def _index(spark, sf_dir):
    docs = lines.explode_lines(documents(spark, sf_dir).select("doc_id", "text"), "text", "doc_id")
    return docs.select("doc_id", "line", F.explode(lines.tokens(F.col("content"))).alias("name"))


@query(f"WITH {TOKENS_SQL} SELECT name, doc_id, line FROM t WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id, line) <= 50")
def inverted_index_capped(spark, sf_dir):
    return select.top_n(_index(spark, sf_dir), ["name"], 50, "doc_id", "line").select("name", "doc_id", "line")


#: Words as the operator takes them: letters, marks, digits and connectors of any script.
UNICODE_WORDS = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+"


@query(
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line FROM documents),
    w AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '{UNICODE_WORDS}')) AS word FROM benchmark),
    m AS (SELECT DISTINCT unnest(string_split_regex(lower(content), '{UNICODE_WORDS}')) AS word, doc_id, line FROM l)
    SELECT word, doc_id, line FROM m SEMI JOIN w USING (word) WHERE length(word) >= 3 QUALIFY row_number() OVER (PARTITION BY word ORDER BY doc_id, line) <= 20"""
)
def word_consumers(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), r"(?U)\W+")).alias("term")).distinct()
    docs = lines.explode_lines(documents(spark, sf_dir).select("doc_id", "text"), "text", "doc_id")
    return features.consumers(words, docs.toDF("path", "line", "content"), 20).select(F.col("term").alias("word"), F.col("path").alias("doc_id"), "line")


@query("SELECT doc_id, substr(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ' '), 1, 60) AS slug FROM documents")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query(
    r"""WITH r AS (SELECT doc_id, replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10), ' ') AS t FROM documents),
    s AS (SELECT doc_id, CASE WHEN contains(t, '. ') THEN string_split(t, '. ')[1] || '.' WHEN contains(t, '! ') THEN string_split(t, '! ')[1] || '!'
      WHEN contains(t, '? ') THEN string_split(t, '? ')[1] || '?' ELSE t END AS s FROM r)
    SELECT doc_id, substr(s, 1, 120) || CASE WHEN length(s) > 120 THEN '…' ELSE '' END AS sentence FROM s"""
)
def first_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("sentence"))


@query(
    r"""WITH w AS (SELECT doc_id, text, substr(text, 1, 1000) AS w, CASE doc_id % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'py' ELSE 'txt' END AS kind FROM documents),
    c AS (SELECT *, CASE WHEN kind = 'sql' AND contains(w, ';') THEN length(w) - position(';' IN reverse(w)) + 1 END AS q, CASE WHEN contains(w, chr(10)) THEN length(w) - position(chr(10) IN reverse(w)) + 1 END AS nl,
      CASE WHEN contains(w, chr(10) || chr(10)) THEN length(w) - position(chr(10) || chr(10) IN reverse(w)) + 1 END AS b FROM w),
    p AS (SELECT *, CASE kind WHEN 'sql' THEN coalesce(q + CASE WHEN substr(text, q + 1, 1) = chr(10) THEN 1 ELSE 0 END, 1000) WHEN 'py' THEN coalesce(b, nl, 1000) ELSE coalesce(nl, 1000) END AS place FROM c)
    SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, 1, place) || chr(10) || '-- [truncated: ' || (length(text) - place) || ' bytes omitted]' || chr(10) END AS cut FROM p"""
)
def truncate_boundary(spark, sf_dir):
    name = F.concat(F.lit("f."), F.get(F.array(F.lit("sql"), F.lit("py"), F.lit("txt")), F.col("doc_id") % 3))
    return table(spark, sf_dir, "documents").select("doc_id", T.truncated(F.col("text"), name, F.lit(1000)).alias("cut"))


@query(
    r"""SELECT doc_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(t, '\b[A-Z][A-Z0-9]*(?:\.[A-Z][A-Z0-9_]*)+\b', '', 'g'),
      '\b[A-Z][A-Z0-9_]{3,}\b', '', 'g'), '\b\d+\b', 'N', 'g')), '\s+', ' ', 'g')) AS comment
    FROM (SELECT doc_id, regexp_replace(text, '[^ -~\n]', '', 'g') AS t FROM documents)"""
)
def normalize_comment(spark, sf_dir):
    plain = F.regexp_replace("text", r"[^ -~\n]", "")
    return table(spark, sf_dir, "documents").select("doc_id", T.normalized_comment(plain).alias("comment"))


@query("SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k, count(DISTINCT json_extract_string(props, '$.k')) AS kinds FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("with_k"), F.count_distinct(k).alias("kinds"))


@query(
    """WITH o AS (SELECT o_orderkey, ['orders', 'customer'][(o_orderkey % 2)::INT + 1] AS t, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity, o_orderdate FROM orders)
    SELECT t, severity, count(*) AS n, sum(CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 1 ELSE 0 END)::BIGINT AS late FROM o GROUP BY ALL"""
)
def repo_profile(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("severity", severity()).withColumn("t", F.when(F.col("o_orderkey") % 2 == 0, "orders").otherwise("customer"))
    late = F.sum((F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).cast("long"))
    return orders.groupBy("t", "severity").agg(F.count("*").alias("n"), late.alias("late"))
