"""Line dedup by site-relative frequency.

Of each host, the pages that hold a line are divided by all its pages; lines above a ratio are
boilerplate and are dropped from every page of the host. Lines are counted by two 64-bit hashes: a
line's text is not shuffled, and counts are combined before they are, so neither a line on every
page nor a host with a third of all pages is a hot key.

Up to ``BROADCAST_LINES`` boilerplate lines are broadcast by host, and texts stay where they are: a
host's list is as long as the mean number of lines of its pages divided by the ratio at most, and a
text's lines meet it through a hash set. Beyond, boilerplate meets hashes of lines by (host, line),
with a frequent line's pages dealt over several keys, and each text is joined, by its own hash, with
the short list of its lines that go; there no row of either side depends on the size of a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenspan.llm import shared, simhash
from lumenspan.llm.components import components

RATIO, LEAST_PAGES = 0.05, 3
#: Bits of 64 that the fingerprints of near-equal pages may differ in.
NEAR_BITS = 4
#: A line on more pages than this is dealt over so many keys when its pages are looked up.
HOT_PAGES, MOST_SALTS = 100_000, 1024
#: Boilerplate lines that are broadcast at most (8 bytes each, besides host names).
BROADCAST_LINES = 1 << 20


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("x"), F.xxhash64(line, F.lit(1)).alias("y"))


def _keys(text: Column) -> Column:
    """Keys of the distinct lines of a text that aren't blank."""
    return F.transform(F.array_distinct(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")), _key)


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, near_words: int | None = None) -> DataFrame:
    """``(host, line, n)``: key of each boilerplate line of each host, and the pages that hold it.

    Null texts are no pages, empty and blank lines are no lines, null hosts are one host, each
    repeated row is a page. A line exactly at the ratio is none. An empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    pages = docs.where(text.isNotNull()).select(F.col(host_col).alias("host"), text.alias("text"))
    if near_words:
        found = _near_pages(pages, near_words)
        totals = found.groupBy("host").agg(F.count_distinct("page").alias("pages"))
        counts = found.select("host", "page", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count_distinct("page").alias("n"))
    else:
        totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
        counts = pages.select("host", F.explode(_keys(F.col("text"))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    often = counts.where(F.col("n") >= least_pages).join(totals.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")))
    return often.where(F.col("n") > F.lit(float(ratio)) * F.col("pages")).select("host", "line", "n")


def _near_pages(pages: DataFrame, words: int) -> DataFrame:
    """``(host, page, lines)`` of ``(host, text)``: near-equal pages have one number, lines are keys."""
    rows = shared.cut(simhash.fingerprints(pages.select("host", _keys(F.col("text")).alias("lines"), "text"), "text", words), "page-fingerprints")
    found = components(simhash.links(rows.select("fp").distinct(), NEAR_BITS))
    return rows.distinct().join(found, F.col("fp") == F.col("node"), "left").select("host", F.coalesce("root", "fp").alias("page"), "lines")


def _dropped(docs: DataFrame, found: DataFrame, host_col: str, text_col: str, hot_pages: int) -> DataFrame:
    """``(x, y, lines)``: of each distinct (host, text) that holds boilerplate its keys, by two hashes of the pair."""
    text = F.col(text_col).cast("string")
    pages = docs.where(text.isNotNull()).select(F.col(host_col).alias("host"), *_page(F.col(host_col), text), _keys(text).alias("keys"))
    salts = F.least(F.lit(MOST_SALTS), F.ceil(F.col("n") / F.lit(hot_pages))).cast("int")
    most = found.agg(F.max(salts)).first()[0] or 1
    # A line dealt over fewer keys than the most frequent one is repeated until it has as many.
    lines = found.select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("salt"))
    held = pages.select("host", "x", "y", F.explode("keys").alias("line"), F.pmod(F.col("x"), F.lit(most)).cast("int").alias("salt"))
    both = held.join(
        lines.toDF("of", "as", "at"), F.col("host").eqNullSafe(F.col("of")) & (F.col("line") == F.col("as")) & (F.col("salt") == F.col("at")), "left_semi"
    )
    return both.groupBy("x", "y").agg(F.collect_set("line").alias("lines"))


def _page(host: Column, text: Column) -> tuple[Column, Column]:
    return F.xxhash64(host.isNull(), host, text).alias("x"), F.xxhash64(F.lit(1), host.isNull(), host, text).alias("y")


def drop_boilerplate(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    length_col: str | None = None,
    ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
    near_words: int | None = None,
    dropped_col: str | None = None,
    hot_pages: int = HOT_PAGES,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """The rows of ``docs``, all columns, without the boilerplate lines of their host in the text.

    A line goes if it is on at least ``least_pages`` pages of the host and on more than ``ratio``
    of them. Lines are split at line feeds and compared as they are; blank lines stay. No text is
    spared: one of boilerplate alone becomes empty. ``length_col`` gets the new text's length, where
    named; ``dropped_col`` is a new column, the number of lines that went.

    Every row is a page, also a repeated one. With ``near_words``, pages whose fingerprints over
    shingles of so many words are linked at ``NEAR_BITS`` bits count as one page.

    A null text stays null, is no page and drops nothing. Rows with a null host are one host.
    Repeated rows stay repeated. Very long texts are taken whole. An empty table gives no rows.
    """
    found = shared.cut(boilerplate(docs, host_col, text_col, ratio, least_pages, near_words), "boilerplate")
    text, lines = F.col(text_col).cast("string"), shared.fresh(docs.columns, "page_lines")
    if found.count() <= broadcast_lines:
        host, of_host = (shared.fresh(docs.columns, c) for c in ("host", "host_lines"))
        by_host = found.groupBy("host").agg(F.collect_list("line.x").alias("lines")).toDF(host, of_host)
        own = F.array_intersect(F.transform(F.split(text, "\n"), lambda line: F.xxhash64(line)), F.col(of_host))
        joined = docs.join(F.broadcast(by_host), F.col(host_col).eqNullSafe(F.col(host)), "left").withColumn(lines, F.when(F.size(own) > 0, own))
        dropped = lambda line: F.array_contains(F.col(lines), F.xxhash64(line))
    else:
        own = shared.cut(_dropped(docs, found, host_col, text_col, hot_pages), "dropped-lines")
        x, y = (shared.fresh(docs.columns, c) for c in ("page_x", "page_y"))
        keys = zip((x, y), _page(F.col(host_col), text), strict=True)
        keyed = docs.withColumns({name: F.when(text.isNotNull(), key) for name, key in keys})
        joined = keyed.join(own.toDF(f"{x}_", f"{y}_", lines), (F.col(x) == F.col(f"{x}_")) & (F.col(y) == F.col(f"{y}_")), "left")
        dropped = lambda line: F.array_contains(F.col(lines), _key(line))
    all_lines = F.split(text, "\n")
    kept = F.filter(all_lines, lambda line: ~dropped(line))
    out = joined
    if dropped_col:
        out = out.withColumn(dropped_col, F.when(F.col(lines).isNotNull(), F.size(all_lines) - F.size(kept)).otherwise(F.lit(0)).cast("long"))
    out = out.withColumn(text_col, F.when(F.col(lines).isNotNull(), F.array_join(kept, "\n")).otherwise(text))
    if length_col:
        out = out.withColumn(length_col, F.char_length(F.col(text_col)).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns, *[dropped_col] * bool(dropped_col))


#: The dealt method as SQL: every row is a page, every line above the ratio goes from every page.
ORACLE = """
WITH pages AS (SELECT source, text, row_number() OVER () AS page FROM documents WHERE text IS NOT NULL),
totals AS (SELECT source, count(*) AS n FROM pages GROUP BY source),
lines AS (SELECT DISTINCT source, page, unnest(string_split(text, chr(10))) AS line FROM pages),
often AS (
  SELECT l.source, l.line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE trim(line) <> '' GROUP BY l.source, l.line, t.n HAVING count(*) >= 3 AND count(*) > 0.05::DOUBLE * t.n),
hosts AS (SELECT source, list(line) AS found FROM often GROUP BY source),
cut AS (
  SELECT d.doc_id, d.source, d.text, string_split(d.text, chr(10)) AS old, CASE WHEN found IS NULL THEN old ELSE
    list_filter(old, lambda x: NOT list_contains(found, x)) END AS kept
  FROM documents d LEFT JOIN hosts h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, source, CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(kept, chr(10)), '') END AS text,
  length(CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(kept, chr(10)), '') END)::BIGINT AS n_chars,
  coalesce(len(old) - len(kept), 0)::BIGINT AS n_dropped
FROM cut
"""
