"""What filters do to each other, over all orders, by edges of the lattice of their subsets.

A document contributes to 80 edges, each a set of filters that have been applied and the one that
comes next: it is removed there, stays, or fails what it would have been removed by earlier. What a
document contributes depends on the filters that it fails and its labels alone, so documents are
counted by these first, at most 128 groups a part; the groups are laid out on the edges, the edges
are summed, and each step of each order is a join with its edge.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, functions as F

from lumenspan.llm import shared

FILTERS = "ABCDE"
#: Words that a text needs, share of distinct ones and of capitals in a hundred, characters of junk.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, JUNK = 200, 50, 3, "[#$%&*|]"
WORD = r"[^\x20\x09-\x0D]+"
#: Places of its filter's bit, by letter.
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}


def failures(text: Column) -> Column:
    """Bits of the filters that look at a text alone, A to D, of which it fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = {
        "A": F.size(words) < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * LEAST_DISTINCT,
        "C": capitals * 100 > F.char_length(text) * MOST_CAPITALS,
        "D": text.rlike(JUNK),
    }
    mask = F.lit(0)
    for f, c in fails.items():
        mask = mask + F.when(c, BIT[f]).otherwise(0)
    return mask


def masks(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(part, mask, good, toxic, n)``: rows of each part that fail the same filters and are labelled alike.

    Texts travel as digests. Rows are counted by (id, digest) before they meet the labels and by
    digest after, so neither a text with many copies nor rows without an id make a hot key.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    own = own.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), failures(F.col("text")).alias("mask"))
    own = own.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    # No label has a salt of its own, so rows without an id are dealt out and meet none.
    own = own.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(0))
    told = lambda c: F.max(F.coalesce(F.col(c).cast("int") == 1, F.lit(False)))
    by_id = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(told("quality").alias("good"), told("toxic").alias("toxic"))
    rows = own.join(by_id.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left").fillna(False, ["good", "toxic"])
    # Of each digest the rows of its least id pass E, and so do rows without an id; the rest fail.
    group = ["digest", "mask", "part", "good", "toxic"]
    by_text = rows.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", F.col("n").alias("copies")))).alias("first"),
    )
    least = by_text.groupBy(F.col("digest").alias("of")).agg(F.min("first.id").alias("least"))
    by_text = by_text.join(least, F.col("digest") == F.col("of"))
    firsts = F.col("unnamed") + F.when(F.col("first.id") == F.col("least"), F.col("first.copies")).otherwise(0)
    both = F.explode(
        F.array(F.struct(F.col("mask").alias("fails"), firsts.alias("rows")), F.struct((F.col("mask") + BIT["E"]).alias("fails"), (F.col("n") - firsts).alias("rows")))
    )
    split = by_text.select("part", "good", "toxic", both.alias("x"))
    # A part without rows that pass or fail E still is a part: groups of no rows stay until the sums.
    return split.groupBy("part", F.col("x.fails").alias("mask"), "good", "toxic").agg(F.sum("x.rows").alias("n"))


def edges(by_mask: DataFrame) -> DataFrame:
    """``(part, applied, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost)``, 80 edges a part, zeros included."""
    lattice = [(sum(BIT[x] for x in done), f, BIT[f]) for f in FILTERS for k in range(len(FILTERS)) for done in combinations([x for x in FILTERS if x != f], k)]
    steps = F.array(*[F.struct(F.lit(a).alias("applied"), F.lit(f).alias("filter"), F.lit(b).alias("bit")) for a, f, b in lattice])
    laid = by_mask.select("*", F.explode(steps).alias("edge")).select("*", "edge.*")
    mask, bit, n = F.col("mask"), F.col("bit"), F.col("n")
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(F.col("applied")) != 0
    removed = fails & ~gone
    count = lambda c: F.sum(F.when(c, n).otherwise(0))
    return laid.groupBy("part", "applied", "filter").agg(
        count(~fails & ~gone).alias("kept"),
        count(removed).alias("removed"),
        count(fails & gone).alias("redundant"),
        count(mask == bit).alias("unique_fails"),
        count(removed & F.col("good")).alias("good_lost"),
        count(removed & F.col("toxic")).alias("toxic_lost"),
    )


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each part, order of the five filters and step: 600 a part, zeros included.

    ``kept`` after the step, ``removed`` here, ``redundant`` (failing its filter, removed earlier),
    ``unique_fails`` (failing its filter alone), ``good_lost`` and ``toxic_lost`` (removed here and
    labelled quality or toxic 1), and ``shapley``: what its filter removes, summed over all orders.

    A null text is empty and a null part the empty string. E fails for rows whose text, as it is, also
    stands under a smaller id; a row without an id neither fails it nor makes another fail, and rows of
    one id don't fail for each other. Repeated rows count each. A document is labelled 1 if any of its
    labels is; null labels and labels without an id say nothing. Texts are read whole, further columns
    aren't read, and an empty table has no part and gives no rows.
    """
    spark = docs.sparkSession
    summed = shared.cut(edges(masks(docs, labels, part_col, id_col, text_col)), "filter-edges")
    paths = [("".join(p), k + 1, p[k], sum(BIT[x] for x in p[:k])) for p in permutations(FILTERS) for k in range(len(FILTERS))]
    steps = spark.createDataFrame(paths, "filter_order string, step int, filter string, applied int")
    # Orders in which exactly this set comes before the filter.
    weight = steps.groupBy("filter", "applied").agg(F.count("*").alias("orders"))
    shapley = summed.join(F.broadcast(weight), ["filter", "applied"]).groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    out = summed.join(F.broadcast(steps), ["filter", "applied"]).join(shapley, ["part", "filter"])
    return out.select("part", "filter_order", "step", *(F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")))


#: Each order is walked document by document.
ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') AS split FROM documents),
words AS (SELECT *, list_filter(split, lambda w: w <> '') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM texts),
marks AS (
  SELECT w.part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda f: CASE f
      WHEN 'A' THEN len(ws) < 200
      WHEN 'B' THEN 100 * len(list_distinct(ws)) < 50 * len(ws)
      WHEN 'C' THEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text)
      WHEN 'D' THEN regexp_matches(text, '[#$%&*|]')
      ELSE coalesce(doc_id > least, false) END) AS fails,
    coalesce(doc_id IN (SELECT l.doc_id FROM labels l WHERE l.quality = 1 AND l.doc_id IS NOT NULL), false) AS good,
    coalesce(doc_id IN (SELECT l.doc_id FROM labels l WHERE l.toxic = 1 AND l.doc_id IS NOT NULL), false) AS toxic
  FROM words w),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, s::INT AS step, substr(o, s::INT, 1) AS f, string_split(left(o, s::INT - 1), '') AS before FROM orders, range(1, 6) r(s)),
walked AS (
  SELECT m.part, s.o, s.step, s.f,
    count(*) FILTER (NOT list_contains(fails, f) AND NOT list_has_any(fails, before)) AS kept,
    count(*) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, before)) AS removed,
    count(*) FILTER (list_contains(fails, f) AND list_has_any(fails, before)) AS redundant,
    count(*) FILTER (fails = [f]) AS unique_fails,
    count(*) FILTER (good AND list_contains(fails, f) AND NOT list_has_any(fails, before)) AS good_lost,
    count(*) FILTER (toxic AND list_contains(fails, f) AND NOT list_has_any(fails, before)) AS toxic_lost
  FROM marks m, steps s GROUP BY ALL)
SELECT part, o AS filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM walked
"""
