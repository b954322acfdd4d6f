import random

from pyspark.sql import functions as F

from lumenspan.functions.workers import tasks_for
from lumenspan.operators import lines
from lumenspan.operators.running import numbered, running


def brute(rows, before):
    out, total, last = [], {}, {}
    for k, at, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        old = (total.get(k, 0), last.get(k))
        total[k], last[k] = old[0] + (v or 0), v if v is not None else old[1]
        out.append((k, at, v, *(old if before else (total[k], last[k]))))
    return sorted(out, key=str)


def test_running_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [("hot", i, rng.choice([None, 0, 3, 7])) for i in range(4000)]
    rows += [(rng.choice(["a", "b", None, "z"]), 10_000 + i, rng.choice([None, 1, 2])) for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at long, v long")
    for before in (False, True):
        got = running(df, ["k"], ["at"], {"total": F.col("v")}, {"last": F.col("v")}, before=before, partitions=16)
        assert got.columns == ["k", "at", "v", "total", "last"]
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, before)


def test_a_key_with_all_rows_is_split(spark):
    df = spark.range(20_000).select(F.lit("one").alias("k"), F.col("id").alias("at"))
    got = numbered(df, ["k"], ["at"], partitions=16)
    assert got.where(F.col("n") != F.col("at") + 1).count() == 0 and got.count() == 20_000
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 10_000


def test_no_rows_and_several_keys(spark):
    df = spark.createDataFrame([(1, None, 1), (1, None, 2), (1, "x", 1), (2, "x", 1)], "a int, b string, at int")
    assert sorted((r.a, r.b or "", r.at, r.n) for r in numbered(df, ["a", "b"], ["at"]).collect()) == [(1, "", 1, 1), (1, "", 2, 2), (1, "x", 1, 1), (2, "x", 1, 1)]
    assert numbered(df.limit(0), ["a", "b"], ["at"]).collect() == []


def test_one_diff_in_many_tasks(spark):
    rng = random.Random(9)
    raw = []
    for f in range(40):
        raw += [f"diff --git a/f{f}.py b/f{f}.py", f"--- a/f{f}.py", f"+++ b/f{f}.py"]
        for h in range(rng.randint(0, 4)):
            body = [rng.choice([" ", "+", "-"]) + rng.choice(["x = 1", "-- not a header", "++ nor this"]) for _ in range(rng.randint(1, 30))]
            old, new = sum(b[0] != "+" for b in body), sum(b[0] != "-" for b in body)
            raw += [f"@@ -{h * 50},{old} +{h * 50 + 3},{new} @@ def f():", *body]
    rows = [("huge", n, text) for n, text in enumerate(raw)] + [("small", 0, "diff --git a/a b/a"), ("small", 1, "@@ -1 +1 @@"), ("small", 2, "-a"), ("small", 3, "+b")]
    table = spark.createDataFrame(rows, "pr_id string, pos int, raw string")
    whole, parts = lines.diff_cursor(table), lines.diff_cursor(table, split=True)
    assert parts.columns == whole.columns
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect())) and whole.count() > 500
    kept = [sorted(map(tuple, lines.kept_sections(table, ["f3"], split=s).collect())) for s in (False, True)]
    assert kept[0] == kept[1]


def test_a_diff_is_sorted_once(spark):
    table = spark.createDataFrame([("p", 1, "diff --git a/x b/x")], "pr_id string, pos int, raw string")
    plan = lines.diff_cursor(table)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window") > 1
    executed = lines.diff_cursor(table)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Sort [") == 1


def test_a_hunk_ends_with_its_file(spark):
    raw = ["@@ -7 +7 @@", " early", "diff --git a/x b/y", " no hunk", "@@ -1,2 +1,9 @@", "-- a", "", "\\ No newline", "+b", "diff --git a/z b/z", "+lost", "@@ -4 +5 @@", "-c", "+d", "+over"]
    table = spark.createDataFrame([("p", n, r) for n, r in enumerate(raw)] + [("q", 0, None), ("q", 1, "+x")], "pr_id string, pos int, raw string")
    want = [(1, None, 1, 7, 7), (5, "y", 1, 1, None), (6, "y", 1, 2, 1), (8, "y", 1, None, 2), (12, "z", 1, 4, None), (13, "z", 1, None, 5)]
    for split in (False, True):
        got = lines.diff_cursor(table, split=split).select("pos", "file", "hunk_id", "old_line", "new_line").collect()
        assert sorted(map(tuple, got)) == want


def test_more_rows_are_dealt_to_more_tasks(spark):
    assert tasks_for(spark.range(2_000_001), 100_000) == 21 and tasks_for(spark.range(0)) == spark.sparkContext.defaultParallelism
