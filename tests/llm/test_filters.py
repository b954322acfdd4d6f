import re
from itertools import permutations

from lumenspan.llm import filters, queries
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


def brute(docs, labels):
    """Every order walked document by document."""
    marked = []
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        own = [x for x in labels if i is not None and x[0] == i]
        marked.append((part or "", {f for f in fails if fails[f]}, any(q == 1 for _, q, _ in own), any(t == 1 for _, _, t in own)))
    rows = []
    for part in {m[0] for m in marked}:
        mine = [m for m in marked if m[0] == part]
        steps = []
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = lambda m: bool(m[1] & set(order[:k]))  # noqa: B023, E731
                here = [m for m in mine if f in m[1] and not gone(m)]
                kept = sum(not gone(m) and f not in m[1] for m in mine)
                steps.append((f, "".join(order), k + 1, kept, len(here), sum(f in m[1] and gone(m) for m in mine), sum(m[1] == {f} for m in mine), sum(m[2] for m in here), sum(m[3] for m in here)))
        shapley = {f: sum(s[4] for s in steps if s[0] == f) for f in "ABCDE"}
        rows += [(part, *s[1:], shapley[s[0]]) for s in steps]
    return sorted(rows)


def test_audit(spark, tmp_path):
    fine = " ".join(f"word{k}" for k in range(250))
    docs = [
        (1, fine, "en"), (2, fine, "en"), (2, fine, "en"), (3, fine, "de"), (None, fine, "en"), (None, fine, None),
        (4, None, "en"), (5, "", "en"), (6, "same " * 300, "en"), (7, "SHOUT " * 300, "de"), (8, "one # two", None), (8, "other of the same id", "en"),
        (9, "very long " * 100_000 + "\x0b\x0c\x1c\x85 x", "de"), (10, " ", "en"), (11, "A&B | C", "en"), (-1, fine, "xx"), (0, "", ""),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (2, 1, 1), (None, 1, 1), (6, 1, 1), (7, 0, 1), (9, None, None), (11, 1, 1), (99, 1, 1)]
    table = spark.createDataFrame([(*d, 5, "x") for d in docs], "doc_id long, text string, lang string, n int, digest string")
    marks = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, salt string")
    got = filters.audit(table, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)
    assert filters.audit(table.limit(0), marks).collect() == []
    assert sorted(map(tuple, filters.audit(table, marks.limit(0)).collect())) == brute(docs, [])
    # The SQL agrees on the same odd rows.
    table.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    assert differences(spark, connect(str(tmp_path)), str(tmp_path), queries.QUERIES["op12_filters"], filters.ORACLE) == []


def test_query_equals_sql(spark):
    assert differences(spark, connect(SF), SF, queries.QUERIES["op12_filters"], filters.ORACLE) == []


def test_lattice(spark):
    rows = spark.createDataFrame([("x", m, True, False, 1) for m in range(32)], "part string, mask int, good boolean, toxic boolean, n long")
    got = filters.edges(rows).collect()
    assert len(got) == 80
    assert all(r.kept + r.removed + r.redundant <= 32 and r.removed == 2 ** (4 - bin(r.applied).count("1")) for r in got)
