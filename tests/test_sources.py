import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lumenspan.functions import automaton
from lumenspan.operators import joins, lineage, reports
from lumenspan.sources import landed, scratch, sinks


def put(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_changed_files(spark, tmp_path):
    rows = [{"pr_number": 1, "filename": "a.py", "status": "added", "additions": 3, "deletions": 0, "patch": "@@"}] * 2
    rows += [{"pr_number": 1, "filename": "b.png"}, {"pr_number": 2, "filename": "a.py", "status": "renamed", "previous_filename": "z.py"}, {"pr_number": 2}]
    got = sorted(map(tuple, landed.changed_files(spark, put(tmp_path / "f.json", rows)).collect()), key=str)
    assert got == [(1, "a.py", "added", 3, 0, "@@", None), (1, "b.png", "modified", 0, 0, "", None), (2, "a.py", "renamed", 0, 0, "", "z.py")]


def test_repositories_readmes_and_trees(spark, tmp_path):
    rows = [{"owner": "o", "repo": "r"}, {"owner": "o", "repo": "s", "name": "S", "default_branch": "dev", "topics": ["x"], "stargazers_count": 4, "language": None}]
    repos = landed.repositories(spark, put(tmp_path / "r.json", rows))
    r, s = sorted(repos.collect(), key=lambda x: x.repo)
    assert tuple(r) == ("o", "r", "r", "o/r", "", "", [], "main", 0, "") and (s.name, s.default_branch, s.topics, s.language) == ("S", "dev", ["x"], "")
    readmes = spark.createDataFrame([("o", "s", "hello"), ("o", "s", "hello")], "owner string, repo string, readme string")
    assert {x.repo: x.readme for x in landed.with_readme(repos, readmes).collect()} == {"r": "", "s": "hello"}
    asked = spark.createDataFrame([("o/r", "HEAD"), ("o/s", "topic"), ("o/s", "HEAD"), ("o/none", "x")], "repo string, branch string")
    branches = spark.createDataFrame([("o/r", "main", "1"), ("o/s", "dev", "2"), ("o/s", "topic", "3")], "repo string, branch string, sha string")
    entries = spark.createDataFrame([(sha, 0, f"{sha}.py", "blob", 1) for sha in "123"], "sha string, ord int, path string, type string, size long")
    assert {(t.repo, t.branch): t.path for t in landed.trees(asked, branches, repos, entries).collect()} == {("o/r", "HEAD"): "1.py", ("o/s", "topic"): "3.py", ("o/s", "HEAD"): "2.py"}


def test_open_pulls(spark):
    pulls = spark.createDataFrame([(n, "open" if n % 2 else "closed") for n in range(300)], "pr_number int, pr_status string")
    assert [r.pr_number for r in landed.open_pulls(pulls).collect()] == list(range(299, 99, -2))


def test_snapshots_and_providers(spark, tmp_path):
    edges = spark.createDataFrame([("A", "B")], "OBJ string, REFERENCED_OBJECT_NAME string")
    written = landed.refresh_snapshots({"dependencies": edges, "views": edges}, str(tmp_path), dependencies=True, views=False, procedures=True)
    assert list(written) == ["dependencies"]
    assert landed.edges_from("records", spark, written["dependencies"]).select("OBJ", "REFERENCED_OBJECT_NAME").collect() == [("A", "B")]
    landed.provider("fixed")(lambda spark, path: edges)
    assert landed.edges_from("fixed", spark, "").count() == 1
    for call in (lambda: landed.edges_from("nothing", spark, ""), lambda: landed.refresh_snapshots({"tables": edges}, str(tmp_path))):
        with pytest.raises(ValueError):
            call()


def test_reports_are_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"o/r{k % 3}", k, f"Fix: the {k}th", None if k == 5 else f"body {k}") for k in range(7)] + [(None, 9, "x", "y")], "repo string, pr int, title string, body string")
    stamp = F.timestamp_seconds(F.lit(1_700_000_000))
    text = sinks.review_text({"repo": F.col("repo"), "pr": F.col("pr"), "title": F.col("title"), "url": F.lit(None)}, F.coalesce("body", F.lit("")))
    paths = sinks.write_reports(rows.select("repo", sinks.report_name(F.col("pr"), F.col("title"), stamp).alias("name"), text.alias("text")), str(tmp_path)).collect()
    assert len(paths) == 7
    assert (tmp_path / "o-r1" / "pr-4-fix-the-4th-1700000000.md").read_text() == "---\nrepo: o/r1\npr: 4\ntitle: Fix: the 4th\n---\n\nbody 4"
    back = reports.reviews(landed.report_files(spark, str(tmp_path)))
    assert sorted((r.repo, r.pr_number) for r in back.collect()) == sorted((f"o/r{k % 3}", k) for k in range(7))


def test_evaluation_text(spark):
    row = spark.createDataFrame([("a sum", None)], "x string, y string")
    text = row.select(sinks.evaluation_text({"repo": F.lit("o/r")}, {"Executive summary": F.col("x"), "Modules": F.col("y"), "Plan": F.lit("### 1. [HIGH] t\n")}).alias("t")).first().t
    assert text == "---\nrepo: o/r\n---\n\n## Executive summary\n\na sum\n\n## Plan\n\n### 1. [HIGH] t\n\n"


def test_evaluation_parts(spark):
    text = "intro\n### [HIGH] Key in code\n**Location:** a.py:3\nIt is there.\n\nTwice.\n\n**Fix:** Move it.\n\nafter\n### [LOW] No more\njust text\n### not one\n"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(reports.evaluation_findings(F.col("t")).alias("f")).collect()
    assert [tuple(x) for x in got[0].f][0] == ("HIGH", "Key in code", "a.py:3", "It is there.\n\nTwice.", "Move it.")
    assert [tuple(x) for x in got[0].f][1][:3] == ("LOW", "No more", "") and got[1].f == [] and got[2].f == []
    plan = "### 1. [HIGH] A\n**Files:** a, b\n**Problem:** two\nlines\n**Change plan:** do\n\n### 2. [LOW] B\n**Acceptance check:** runs\n"
    steps = spark.createDataFrame([(plan,)], "t string").select(reports.remediation_plan(F.col("t")).alias("s")).first().s
    assert [tuple(x) for x in steps] == [("1", "HIGH", "A", "a, b", "two\nlines", "do", ""), ("2", "LOW", "B", "", "", "", "runs")]


def test_within_and_merged(spark):
    rows = spark.createDataFrame([(1, "abcab"), (2, None), (3, ""), (4, "b")], "i int, t string")
    words = spark.createDataFrame([("ab", 1), ("b", 2), ("abcabc", 3), ("", 4), (None, 5), ("cab", 6)], "w string, n int")
    got = {(r.i, r.n) for r in joins.within(rows, words, ["i"], F.col("t"), "w").collect()}
    assert got == {(1, 1), (1, 2), (1, 4), (1, 6), (3, 4), (4, 2), (4, 4)}
    assert joins.within(rows, words.limit(0), ["i"], F.col("t"), "w").collect() == []
    use = lambda ref, op, line, up: (ref, op, "f", line, up, [])
    uses = spark.createDataFrame([use("a", "READ", 1, ["x", "y"]), use("A", "DROP", 2, ["y", "z"]), use("A", "CREATE", 3, []), use("b", "READ", 1, [])], "raw_ref string, operation string, file string, line int, upstream array<string>, downstream array<string>")
    assert sorted((r.object, r.operation, r.upstream, r.uses) for r in lineage.merged(uses).collect()) == [("A", "CREATE", ["x", "y", "z"], 3), ("B", "READ", [], 1)]


@pytest.mark.parametrize("shard_chars", [40, 4_000_000])
def test_words_in_texts(spark, shard_chars):
    rng = random.Random(4)
    texts = [(i, None if i == 3 else "".join(rng.choices("abc é漢", k=rng.randint(0, 60))), i % 5) for i in range(200)] + [(7, "aaa", 1)] * 2
    words = [("".join(rng.choices("abc é漢", k=rng.randint(1, 4))),) for _ in range(150)] + [("",), (None,), ("a",), ("aa",), ("aaaa",)]
    rows = spark.createDataFrame(texts, "i int, t string, k int")
    got = automaton.holds(rows, spark.createDataFrame(words * 2, "w string"), ["k", "i"], "t", "w", shard_chars)
    want = [(k, i, w) for i, t, k in texts for w in {w for (w,) in words if w is not None and t is not None and w in t}]
    assert got.columns == ["k", "i", "w"] and sorted(map(tuple, got.collect())) == sorted(want)
    assert automaton.holds(rows.limit(0), spark.createDataFrame(words, "w string"), ["i"], "t", "w").collect() == []


def test_long_texts_and_many_lengths_take_time_by_their_size(spark):
    text = "lorem ipsum dolor sit amet " * 40_000
    words = [(text[i : i + n],) for i in range(20) for n in range(1, 200, 3)]
    began = time.perf_counter()
    got = joins.within(spark.createDataFrame([(1, text)], "i int, t string"), spark.createDataFrame(words, "w string").distinct(), ["i"], F.col("t"), "w")
    assert got.count() == len(set(words)) and time.perf_counter() - began < 60


def test_settled_tables_are_read_back(spark):
    assert scratch.settled(spark.range(5)).count() == 5


def test_flow_files_take_whole_patterns(spark):
    from lumenspan.operators import names

    globs = names.FLOW_GLOBS
    made = [g.replace("**/", "").replace("*", f"x{k}") for g in globs[:3] for k in range(20)]
    rows = [("r", n, p, "spark read", "blob") for n, p in enumerate(dict.fromkeys(made))]
    files = spark.createDataFrame(rows, "repo string, ord int, path string, content string, type string")
    got = {r.path for r in names.flow_files(files, n=25).collect()}
    first, want, n = {}, set(), 0
    from fnmatch import fnmatch
    for i, g in enumerate(globs):
        if n >= 25:
            break
        own = [p for _, _, p, _, _ in rows if p not in want and (fnmatch(p, g) or fnmatch(p.split("/")[-1], g))]
        want.update(own)
        n += len(own)
    assert got == want and len(got) >= 25
