"""Operators on small inputs against plain Python."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumenspan.functions import text as T
from lumenspan.operators import audit, coverage, features, findings, graph, index, joins, lineage, lines, names, pipelines, reports, rules, schema_changes, select, similar, stores, symbols
from lumenspan.plans import changes as queries
from lumenspan.plans import fixtures as X
from lumenspan.sources import landed, sinks
from lumenspan.streaming import events


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("text,want", [("a\nb\n", ["a", "b"]), ("", []), ("\n", [""]), ("a\r\nb\x0bc", ["a", "b", "c"]), (None, [])])
def test_to_lines(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.to_lines(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    "content,name,cap,want",
    [
        ("short", "a.sql", 10, "short"),
        ("select 1;\nselect 2;\nselect", "a.sql", 22, "select 1;\nselect 2;\n"),
        ("select one two", "a.sql", 6, "select"),
        ("a = 1\n\nb = 2\nc = 3\n", "a.py", 15, "a = 1\n\n"),
        ("a = 1\nb = 2\nc = 3\n", "a.py", 9, "a = 1\n"),
        ("one\ntwo\nthree", "a.txt", 9, "one\ntwo\n"),
        ("abcdefgh", "a.txt", 3, "abc"),
    ],
)
def test_truncated(spark, content, name, cap, want):
    got = one(spark, T.truncated(F.col("c"), F.col("n"), F.col("cap")), c=content, n=name, cap=cap)
    assert got == (want if len(content) <= cap else f"{want}\n-- [truncated: {len(content) - len(want)} bytes omitted]\n")


def test_scalars(spark):
    f = lambda column, text: one(spark, column(F.col("t")), t=text)
    assert f(T.slug, "--Hello,  World! Ünit 9--") == "hello-world-nit-9"
    assert f(T.first_sentence, " One. Two! ") == "One."
    assert f(T.first_sentence, "What? Yes") == "What?"
    assert f(T.first_sentence, "x" * 130) == "x" * 120 + "…"
    assert f(T.normalized_comment, "Table PROD.SALES.X and BIG_NAME has 12 rows") == "table and has N rows".lower()
    assert f(T.redacted, "token = 'abcdefgh' ghp_" + "a" * 30) == "token=**** ghp_****"
    assert f(T.masked_key, "abcdefghijkl") == "abcd****ijkl" and f(T.masked_key, "short") == "****"
    assert f(T.stem, "a/b.c/d.e.py") == "d.e" and f(T.extension, "a/B.PY") == "py" and f(T.extension, "a.b/c") == ""
    assert tuple(f(T.name_parts, 'a."b".`c`')) == ("a", "b", "c") and tuple(f(T.name_parts, "t")) == (None, None, "t")
    assert tuple(f(T.repo_slug, "https://host/o/r/pull/12")) == ("o", "r", 12) and tuple(f(T.repo_slug, "o/r")) == ("o", "r", None)
    assert f(T.front_matter, "---\na: 1\nb: x: y\na: 2\n: z\nplain\n---\nbody") == {"b": "x: y", "a": "2"}
    assert f(T.front_matter, "no") == {}
    assert f(features.role, "jobs/load_user_feature.py") == "load" and f(features.role, "x/other.py") == "other"
    assert f(schema_changes.consumer_kind, "assert x") == "test" and f(schema_changes.consumer_kind, "SELECT a") == "query"
    assert f(lambda c: T.matches_glob(c, ["src/*.py", "Dockerfile"]), "src/a/b.py") and f(lambda c: T.matches_glob(c, ["Dockerfile"]), "x/Dockerfile")
    assert not f(lambda c: T.matches_glob(c, ["*.env"]), "env.py")


def test_parsed_date(spark):
    cases = [("1.5", "2024-01-01", 1.5), (None, "2024-01-02 03:04 IST", 1704164640.0), ("x", "2024-01-02", 1704153600.0), (None, "never", 7.0), (None, None, 7.0)]
    rows = spark.createDataFrame(cases, "s string, d string, want double")
    got = rows.select(T.parsed_date(F.col("s"), F.col("d"), F.lit(7.0)).alias("x"), "want").collect()
    assert all(r.x == r.want for r in got)


def budget(sizes, cap, files, file_cap):
    out, total = [], 0
    for n, size in enumerate(sizes):
        if n >= files:
            out.append("file_cap")
        elif size is None:
            out.append("error")
        elif total >= cap:
            out.append("byte_cap")
        else:
            total += min(size, file_cap)
            out.append("truncated" if size > file_cap else "ok")
    return out


@pytest.mark.parametrize("seed", range(4))
def test_budgets(spark, seed):
    rng = random.Random(seed)
    groups = {g: [rng.choice([None, rng.randint(0, 90)]) for _ in range(rng.randint(1, 12))] for g in "abc"}
    df = spark.createDataFrame([(g, n, s) for g, v in groups.items() for n, s in enumerate(v)], "g string, n int, s int")
    got = defaultdict(list)
    for r in select.byte_budget(df, ["g"], ["n"], F.col("s"), 150, 8, 50).orderBy("g", "n").collect():
        got[r.g].append(r.status)
    assert dict(got) == {g: budget(v, 150, 8, 50) for g, v in groups.items()}
    plain = df.where("s is not null")
    kept = defaultdict(list)
    for r in select.within_budget(plain, ["g"], ["n"], F.col("s"), 100).collect():
        kept[r.g].append(r.n)
    for g, v in groups.items():
        want, total = [], 0
        for n, s in enumerate(v):
            if s is None:
                continue
            if total + s > 100:
                break
            total += s
            want.append(n)
        assert sorted(kept[g]) == want


@pytest.mark.parametrize("seed", range(3))
def test_touched_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    ranges = [(rng.choice("xyz"), n, a := rng.randint(0, 50), a + rng.randint(0, 6)) for n in range(60)] + [("q", 99, 1, 9), ("x", 3, 0, 50)]
    points = [(rng.choice("xyz"), rng.randint(0, 56)) for _ in range(30)]
    got = joins.touched(spark.createDataFrame(ranges, "f string, n int, a int, b int"), spark.createDataFrame(points, "f string, p int"), ["f"], "a", "b", "p")
    want = [r for r in ranges if any(f == r[0] and r[2] <= p <= r[3] for f, p in points)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_search_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randint(0, 14)}", f"N{rng.randint(0, 14)}") for _ in range(25)] + [(None, "N1"), ("n2", None)]
    df = spark.createDataFrame(edges, "OBJ string, REFERENCED_OBJECT_NAME string")
    steps = defaultdict(set)
    for a, b in edges:
        if a and b:
            steps[a.upper()].add(b.upper())
    want = set()
    for s in ("N1", "N5"):
        seen, wave = {s}, {s}
        for hop in range(1, 4):
            wave = {y for x in wave for y in steps[x]} - seen
            seen |= wave
            want |= {(s, x, hop) for x in wave}
    got = graph.search(df, spark.createDataFrame([("n1",), ("N5",)], "start string"), 3, "upstream")
    assert {tuple(r) for r in got.collect()} == want
    nodes, ends = graph.provider(df, spark.createDataFrame([("n1",)], "start string"), 2, "upstream")
    assert nodes.where("depth = 0").count() == 1 and ends.count() == nodes.count() - 1


def test_roots_and_paths(spark):
    tree = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "parent string, child string")
    assert [r.node for r in graph.roots(tree).collect()] == ["a"]
    found = {tuple(r.path): r.cycle for r in graph.paths(tree, 4).collect()}
    assert found[("a", "b", "c", "b")] and not found[("a", "b", "c")]
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string")
    assert sorted(r.node for r in graph.roots(ring).collect()) == ["a", "b"]


def test_diff_edges(spark):
    cursor = queries.cursor(spark)
    assert cursor.where("file = 'app/models.py' and change = 'added'").count() == 9
    assert {r.file for r in lines.changed_files(lines.diff_lines(spark.createDataFrame([("p", X.DIFF)], "pr_id string, diff string"))).collect()} >= {"app/models.py", "db/schema.sql"}
    empty = spark.createDataFrame([("p", ""), ("q", None)], "pr_id string, diff string")
    assert lines.diff_cursor(lines.diff_lines(empty)).collect() == []
    kept = lines.kept_sections(lines.diff_lines(spark.createDataFrame([("p", X.DIFF), ("q", "diff --git a/x b/x\n+y")], "pr_id string, diff string")), ["schema"])
    got = {r.pr_id: r.text for r in kept.collect()}
    assert got["p"].startswith("diff --git a/db/schema.sql") and got["q"] == "(no relevant changes)"


def test_rules(spark):
    safe = ["hashlib.md5(x)  # checksum", "cursor.execute(sql, (a,))", "yaml.load(f, Loader=L)", "token == None"]
    bad = {"hashlib.md5(x)": "SEC-040", 'cur.execute(f"SELECT {x}")': "SEC-010", "yaml.load(f)": "SEC-031", "os.system(c)": "SEC-021", "verify=False": "SEC-051", "AKIAABCDEFGHIJKLMN": "SEC-002"}
    rows = spark.createDataFrame([(x,) for x in [*safe, *bad]], "content string")
    got = defaultdict(set)
    for r in rules.scan(rows, rules.SECURITY_RULES, "content").collect():
        got[r.content].add(r.rule_id)
    assert all(rule in got[line] for line, rule in bad.items()), dict(got)
    assert not any(got[line] for line in safe), dict(got)
    paths = spark.createDataFrame([("a/min.js",), ("x.min.js",), ("vendor/a.py",), ("src/a.py",), ("b.PNG",)], "p string")
    assert [r.p for r in paths.where(~rules.skipped(F.col("p"))).collect()] == ["a/min.js", "src/a.py"]


def test_verdicts(spark):
    cases = [("request_changes", 0, 3, "comment"), ("request_changes", 1, 0, "request_changes"), ("approve", 0, 2, "comment"), ("approve", 0, 1, "approve"), ("approve", 1, 0, "comment")]
    rows = spark.createDataFrame(cases, "c string, critical int, high int, want string")
    assert all(r.x == r.want for r in rows.select("want", findings.verdict(F.col("c"), F.col("critical"), F.col("high")).alias("x")).collect())
    risks = spark.createDataFrame([("critical", 1, 0, "high"), ("critical", 0, 1, "medium"), ("critical", 0, 0, "low"), ("low", 5, 5, "low")], "c string, critical int, high int, want string")
    assert all(r.x == r.want for r in risks.select("want", findings.demoted_risk(F.col("c"), F.col("critical"), F.col("high")).alias("x")).collect())


def test_modules(spark):
    paths = ["src/main.py", "src/a/b.py", "src/conf.yml", "lib/x.py", "one/y.py", "tests/t.py", "README.md", "setup.cfg", "node_modules/z.py", "big/1.py", "big/2.py"]
    tree = spark.createDataFrame([("r", n, p, "blob", 1) for n, p in enumerate(paths)] + [("r", 99, "src", "tree", 0)], "repo string, ord int, path string, type string, size int")
    got = {r.name: (r.paths, r.score) for r in select.modules(tree).collect()}
    assert got == {"src": (["src/main.py", "src/conf.yml", "src/a/b.py"], 53.0), "lib": (["lib/x.py"], 51.0), "root": (["setup.cfg"], 11.0), "big": (["big/1.py", "big/2.py"], 2.0)}
    cover = select.audit_coverage(tree, n=3).first()
    assert (cover.tree_files, cover.audit_eligible, cover.audit_scanned) == (11, 9, 3)
    assert [r.path for r in select.audit_files(tree, n=2).collect()] == ["src/main.py", "setup.cfg"]
    assert select.tree_excerpt(tree, 3).first().more == 9
    deep = spark.createDataFrame([("r", 0, "dags/x.py"), ("r", 1, "Dockerfile")], "repo string, ord int, path string")
    assert select.signals(deep).first().signals == ["airflow", "docker"]


def test_lineage(spark):
    got = {(r["table"], r.operation, r.line) for r in lineage.usages(queries.code(spark).where("path like 'etl/%'")).collect()}
    assert {("SALES", "CREATE", 1), ("ORDERS", "READ", 2), ("AUDIT", "WRITE", 3), ("OLD_SALES", "DROP", 4), ("REPORT", "WRITE", 5)} <= got
    assert lineage.name_parts("select") is None and lineage.name_parts("ab") is None and lineage.name_parts("a.b.c.d") is None
    dynamic = list(lineage.usages_of({"path": "x.py", "content": 'spark.sql(f"SELECT * FROM {t} JOIN mart.a ON 1")'}))
    assert {u["raw_ref"] for u in dynamic} == {"DYNAMIC", "mart.a"}


def test_index_kinds():
    got = {(n, k) for n, _, k in index.script_names(dict(X.FILES)["web/index.ts"])}
    assert got == {("React", "js.import"), ("useState", "js.import"), ("App", "js.def"), ("limit", "js.def"), ("Box", "js.def"), ("run", "js.call"), ("draw", "js.call")}
    assert [(n, k) for n, _, k in index.model_yaml_names(dict(X.FILES)["models/schema.yml"])] == [("orders", "dbt.model_def"), ("users", "dbt.source"), ("shop.users", "dbt.source")]
    assert list(index.python_names("def f(:\n")) == []
    assert {k for _, _, k in index.python_names("from a import b\nimport c\nclass D:\n    x = f()\n")} == {"py.import", "py.def", "py.call"}
    assert index.extractor("x/README.md") is None and index.extractor("conf/a.yml") is None


def test_symbols(spark):
    rows = {d["qualified"]: d for d in symbols.definitions({"path": "a.py", "content": X.BASE})}
    assert rows["Store.save"]["signature"]["kind"] == "method" and rows["fetch"]["signature"]["is_async"]
    assert rows["kept"]["signature"]["params"] == ["a", "b=1"] and rows["fetch"]["signature"]["return_type"] == "Optional[str]"
    broken = list(symbols.definitions({"path": "a.py", "content": "def f(:"}))
    assert len(broken) == 1 and broken[0]["parse_error"]
    sides = [symbols.python_symbols(spark.createDataFrame([("r", s, "s.py", t)], "repo string, ref string, path string, content string")) for s, t in (("base", X.BASE), ("head", X.HEAD))]
    found = symbols.symbol_changes(*sides).where("qualified = 'fetch'").select(symbols.risks(F.col("old"), F.col("new")).alias("r")).first().r
    assert len(found) == 4 and "No longer async" in found[0] and "narrowed" in found[1]
    cursor = spark.createDataFrame([("added", "s.py", 5), ("removed", "s.py", 9), ("added", "t.py", 5)], "change string, file string, new_line int")
    assert [r.qualified for r in symbols.touched_symbols(sides[0], cursor).collect()] == ["kept"]


def test_stores(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, version int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 1)], "k int, v string, version int")
    assert {(r.k, r.v) for r in stores.upsert(old, new, ["k"], "version").collect()} == {(1, "c"), (2, "b"), (3, "e")}
    assert {(r.k, r.v) for r in stores.insert_absent(old, new.union(new), ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "e")}
    contexts = spark.createDataFrame([("std", True, "x/y"), ("hit", False, "acme/zeta"), ("no", False, "other/repo2"), ("named", False, "q/w")], "name string, standard boolean, repo string")
    assert {r.name for r in stores.relevant_context(contexts, "uses Zeta tables", ["named"]).collect()} == {"std", "hit", "named"}
    repos = spark.createDataFrame([("a", False, False, ["Data"]), ("b", True, False, ["data"]), ("c", False, False, ["x"])], "name string, fork boolean, archived boolean, topics array<string>")
    assert [r.name for r in stores.repo_names(repos, topic="data").collect()] == ["a"]


def test_similar_ratio():
    texts = [c[6] for c in X.COMMENTS]
    assert similar.leaders(texts[:2]) == [0, 0] and similar.leaders(texts[2:4]) == [0, 0] and similar.leaders(["a b", "zzz qqq"]) == [0, 1]
    assert similar.leaders([]) == [] and similar.leaders(["", ""]) == [0, 0]


def test_reports(spark):
    f = lambda column, text: one(spark, column(F.col("t")), t=text)
    assert f(reports.bullets, "x\n- a\n  - b\n") == ["a", "b"]
    assert tuple(f(reports.code_block, "pre\n```sql\nx\ny\n```\npost")) == ("pre", "x\ny")
    got = f(reports.table, "t\n| a | b |\n|---|---|\n| 1 | 2 |\n")
    assert (got.before, got.headers, got.rows) == ("t", ["a", "b"], [["1", "2"]])
    issue = f(reports.misc_issues, "- **`LOW`** `a.py`:3-4 — text here\nother")
    assert [tuple(i) for i in issue] == [("LOW", "a.py", "3-4", "text here")]
    fix = f(reports.remediation_items, "**`HIGH`** `a.py` (lines 1-2)\nDo it\n```py\nx = 1\n```\n> 💡 tip\n**`LOW`** `b.py`\nOther")
    assert [tuple(i) for i in fix] == [("HIGH", "a.py", "1-2", "Do it", "tip", "x = 1"), ("LOW", "b.py", None, "Other", None, None)]
    told = f(reports.verdict_of, "## Any Code Review 💬\nRisk: `HIGH`")
    assert tuple(told) == ("comment", "HIGH") and tuple(f(reports.verdict_of, "nothing")) == ("unknown", "UNKNOWN")
    made = [("7", 1, "✅ Looks okay", "LOW"), ("7", 3, "❌ Please revisit", "CRITICAL"), ("8", 2, "💬 Needs attention", "HIGH"), ("7", 2, "?", "LOW"), ("7", 4, "✅ Approve", "LOW")]
    files = [(f"s/{pr}-{day}.md", X.REVIEW.format(pr=pr, day=day, verdict=v, risk=r)) for pr, day, v, r in made] + [("s/x.md", "no front matter")]
    rows = reports.reviews(spark.createDataFrame(files, "path string, text string").withColumn("mtime", F.lit("2024-06-01").cast("timestamp")))
    assert reports.filtered(rows, text="change 8").count() == 1 and reports.filtered(rows, verdict="approve").count() == 2
    assert reports.filtered(rows, days=1, now=F.lit(1714816800.0)).count() == 2


def test_pipelines(spark):
    jobs = {r.job_name: r for r in pipelines.jobs(queries.code(spark)).collect()}
    assert [t.task_key for t in jobs["nightly"].tasks] == ["extract", "publish"] and jobs["nightly"].schedule == "0 0 2 * * ?"
    assert jobs["nightly"].tasks[1].depends_on == ["extract"] and jobs["nightly"].tasks[0].fail_on_run_failure is False
    texts = spark.createDataFrame([("p", "models/a.sql", "select {{ ref('x') }}", "select {{ ref('y') }}")], "pr_id string, file string, added string, removed string")
    assert pipelines.model_changes(texts).first().refs_changed == ["x", "y"]
    assert one(spark, features.groups_of(F.col("t")), t='feature_group = "user_stats"\nFeatureGroup("user_stats")') == ["user_stats"]


def test_coverage_helpers(spark):
    assert "tests/test_b.py" in one(spark, coverage.candidates(F.col("t")), t="a/b.py")
    files = queries.code(spark)
    found = coverage.summary(files, "repo").first()
    assert found.has_tests and found.frameworks == ["pytest"]
    names = spark.createDataFrame([("kept",), ("lonely",)], "name string")
    assert [r.name for r in coverage.uncovered(names, files).collect()] == ["lonely"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "edges.json").write_text('[{"obj": "A", "Referenced_Object_Name": "B", "db": null}]')
    assert landed.snapshot(spark, str(tmp_path / "edges.json")).select("OBJ", "REFERENCED_OBJECT_NAME", "SCHEMA").first() == ("A", "B", None)
    (tmp_path / "cols.json").write_text('{"obj": ["A", "C"], "referenced_object_name": ["B", "D"]}')
    assert landed.snapshot_columns(spark, str(tmp_path / "cols.json")).count() == 2
    (tmp_path / "prs.json").write_text('{"number": 1, "title": "t", "state": "closed", "merged_at": "2024-01-01", "body": null}\n{"number": 2, "state": "open"}\nbroken\n')
    pulls = landed.pull_requests(spark, str(tmp_path / "prs.json"))
    assert {(r.pr_number, r.pr_status) for r in pulls.where("pr_number is not null").collect()} == {(1, "merged"), (2, "open")}
    assert landed.merged_pulls(pulls, 5).count() == 1
    assert one(spark, landed.decoded(F.col("t")), t="w7x4") == "üx"
    store = spark.createDataFrame([(1, 2)], "k int, schema_version int")
    sinks.write_store(store, str(tmp_path / "store"))
    assert landed.store(spark, str(tmp_path / "store"), "k int", 2).count() == 1 and landed.store(spark, str(tmp_path / "store"), "k int", 3).count() == 0
    assert one(spark, sinks.front_matter({"a": F.col("t"), "b": F.lit(None)}), t="x") == "---\na: x\n---\n"
    (tmp_path / "reports").mkdir()
    (tmp_path / "reports" / "r.md").write_text(X.REVIEW.format(pr=1, day=1, verdict="✅ okay", risk="LOW"))
    assert reports.reviews(landed.report_files(spark, str(tmp_path / "reports"))).first().verdict == "approve"


def test_event_intake(spark, tmp_path):
    rows = [("pull_request", "opened", ("o/r",), (1, "t")), ("pull_request", "closed", ("o/r",), (2, "t")), ("push", "opened", ("o/r",), (3, "t")), ("pull_request", "reopened", ("o/r",), (4, "t"))]
    from lumenspan.schemas import EVENTS

    spark.createDataFrame(rows, EVENTS).write.json(str(tmp_path / "in"))
    history = spark.createDataFrame([("o/r", 4)], "repo string, pr_number int")
    seen = []
    run = events.intake(events.review_requests(events.event_stream(spark, str(tmp_path / "in"))), str(tmp_path / "cp"), lambda df, n: seen.extend(r.pr_number for r in events.unreviewed(df, history).collect()))
    run.awaitTermination()
    assert seen == [1]


def waits_of(spark, stream, marks):
    got = []
    with events.rocksdb(spark):
        run = stream.writeStream.foreachBatch(lambda batch, n: got.extend(map(tuple, batch.collect()))).option("checkpointLocation", str(marks)).trigger(availableNow=True).start()
        run.awaitTermination()
    return sorted(got), run


def brute_waits(calls, most, window):
    out, passed = [], {}
    for k, now in sorted(calls):
        times = passed.setdefault(k, [])
        wait = max(0.0, times[-most] + window - now) if len(times) >= most else 0.0
        times.append(now + wait)
        out.append((k, now, wait))
    return sorted(out)


def test_call_limit(spark, tmp_path):
    calls = [(1, float(t)) for t in (0, 1, 2, 70)] + [(2, 5.0)]
    spark.createDataFrame([*calls, (None, 3.0), (2, None)], "user_id long, seconds double").coalesce(1).write.json(str(tmp_path / "calls"))
    stream = spark.readStream.schema("user_id long, seconds double").json(str(tmp_path / "calls"))
    got, _ = waits_of(spark, events.limited(stream, most=2, window=60), tmp_path / "marks")
    assert got == [(1, 0.0, 0.0), (1, 1.0, 0.0), (1, 2.0, 58.0), (1, 70.0, 0.0), (2, 5.0, 0.0)]
    assert events._PROVIDER not in spark.conf.getAll or spark.conf.get(events._PROVIDER) != events.ROCKSDB
    with pytest.raises(ValueError, match="stream"):
        events.limited(spark.createDataFrame(calls, "user_id long, seconds double"))


def test_call_limits_of_keys_that_share_a_group(spark, tmp_path):
    rng = random.Random(5)
    calls = [(f"u{rng.randrange(40)}", float(rng.randrange(900))) for _ in range(600)]
    (tmp_path / "calls").mkdir()
    stream = spark.readStream.schema("user_id string, seconds double").json(str(tmp_path / "calls"))
    got = []
    for part in range(3):  # later calls meet what was let through before
        lines = [json.dumps({"user_id": k, "seconds": t}) for k, t in calls if t // 300 == part]
        (tmp_path / "calls" / f"{part}.json").write_text("\n".join(lines))
        more, run = waits_of(spark, events.limited(stream, most=3, window=200, groups=2), tmp_path / "marks")
        got += more
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]) < 40  # not one for each key and call
    assert sorted(got) == brute_waits(calls, 3, 200)


@pytest.mark.parametrize("per_frame", [3, 10_000])
def test_call_limit_is_the_same_however_calls_are_split(spark, tmp_path, per_frame):
    rng = random.Random(7)
    calls = [(k, round(rng.uniform(0, 500), 4)) for k in (1, 1, 1, 2, 3) for _ in range(200)] + [(9, 100.0)] * 7
    rng.shuffle(calls)
    for part in range(4):  # each file is a batch; the calls of a key are in all of them, in no order
        lines = [json.dumps({"user_id": k, "seconds": t}) for k, t in calls[part::4]]
        (tmp_path / "calls").mkdir(exist_ok=True)
        (tmp_path / "calls" / f"{part}.json").write_text("\n".join(lines))
    stream = spark.readStream.schema("user_id long, seconds double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "calls"))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, per_frame)
    try:
        got, run = waits_of(spark, events.limited(stream, most=3, window=60, delay="600 seconds"), tmp_path / "marks")
    finally:
        spark.conf.set(name, before)
    assert len([p for p in run.recentProgress if p["numInputRows"]]) == 4 and got == []  # all within the delay still wait
    # A call much later lets all of them out; one that comes after that is late.
    (tmp_path / "calls" / "later.json").write_text(json.dumps({"user_id": 4, "seconds": 5000.0}))
    got, _ = waits_of(spark, events.limited(stream, most=3, window=60, delay="600 seconds"), tmp_path / "marks")
    assert got == brute_waits(calls, 3, 60)
    (tmp_path / "calls" / "late.json").write_text(json.dumps({"user_id": 1, "seconds": 7.0}))
    (tmp_path / "calls" / "z.json").write_text(json.dumps({"user_id": 1, "seconds": 9000.0}))
    got, run = waits_of(spark, events.limited(stream, most=3, window=60, delay="600 seconds"), tmp_path / "marks")
    dropped = sum(s["numRowsDroppedByWatermark"] for p in run.recentProgress for s in p["stateOperators"])
    assert got == [(4, 5000.0, 0.0)] and dropped == 1


def test_audit_pairs():
    found = lambda path, text: {f["checker"] for f in audit.check_file({"repo": "r", "path": path, "content": text})}
    assert found("a.py", "x.cast('int') # row_id") == {"IntOverflowChecker"} and found("a.py", "xx.cast('int') + zz") == set()
    assert found("a.py", 'f"SELECT {x}"') == {"SqlInjectionChecker"} and found("a.txt", 'f"SELECT {x}"') == set()
    assert found("a.yml", "on_failure:\n - [EMAIL_ADDRESS: a@b.org]") == set()
    assert found("a.py", '.option("mergeSchema", "true")') == {"SchemaDriftChecker"}
    assert found("a.md", "password = 'abcdefgh'") == set() and found("a.py", None) == set()


def test_signatures(spark):
    import hashlib
    import hmac

    for key in ("k", "long" * 40):
        want = "sha256=" + hmac.new(key.encode(), "bödy".encode(), hashlib.sha256).hexdigest()
        rows = spark.createDataFrame([("bödy", want), ("bödy", "sha256=0"), ("bödy", None)], "b string, s string")
        got = [r.x for r in rows.select(T.signed(F.col("b").cast("binary"), F.col("s"), key).alias("x")).collect()]
        assert got == [True, False, False]
    assert one(spark, T.signed(F.col("t").cast("binary"), F.lit("x"), ""), t="b")


def test_names(spark):
    f = lambda column, text: one(spark, column(F.col("t")), t=text)
    assert f(names.downstream_of, "Risk. Downstream: mart.a, mart.b.") == "mart.a, mart.b" and f(names.downstream_of, "downstream: none") == ""
    rows = [("p", "added", "def run(x):"), ("p", "removed", "async def old(x):"), ("p", "added", "def __init__(self):"), ("p", "added", "CREATE OR REPLACE TABLE a.b.c ("), ("p", "added", "DROP TABLE x.tmp"), ("p", "context", "def kept():")]
    cursor = spark.createDataFrame(rows, "pr_id string, change string, text string")
    assert [r.name for r in names.changed_names(cursor).orderBy("name").collect()] == ["A.B.C", "C", "old", "run"]
    layers = spark.createDataFrame([("r", "DB models", "x"), ("r", "API routes", "y"), ("r", "other", "z")], "repo string, name string, description string")
    assert tuple(names.layer_hints(layers, "repo").first()) == ("r", ["DB models: x"], ["API routes: y"])
    table = spark.createDataFrame([([["a|b", None]],)], "rows array<array<string>>")
    assert table.select(names.as_table(["X", "Y"], F.col("rows"))).first()[0] == "| X | Y |\n|---|---|\n| a\\|b |  |"
    assert {r.status: (r.files, r.bytes) for r in names.manifest(spark.createDataFrame([("ok", 2), ("ok", 3), ("error", None)], "status string, size int")).collect()} == {"ok": (2, 5), "error": (1, 0)}
