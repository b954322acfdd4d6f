import numpy as np

from lumenspan.llm import pq, queries


def brute(rows, threshold=0.95):
    n = len(rows)
    x = []
    for _, v in rows:
        good = v and None not in v and np.isfinite(v).all() and np.any(v)
        x.append(np.array(v, float) / np.linalg.norm(v) if good and len(v) == 8 else None)
    linked = [{j for j in range(n) if j != i and x[i] is not None and x[j] is not None and x[i] @ x[j] >= threshold} for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(linked[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return out


def made():
    rng = np.random.default_rng(3)
    rows = []
    for c in rng.normal(size=(60, 8)):
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows), (c + rng.normal(size=8) * 0.25).astype(np.float32).tolist()))
    hot = rng.normal(size=8)
    rows += [(1000 + i, hot.astype(np.float32).tolist()) for i in range(40)]
    rows += [(1100 + i, (hot + rng.normal(size=8) * 0.1).astype(np.float32).tolist()) for i in range(60)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] + [1.0] * 7), (2004, [None] + [1.0] * 7), (2005, [1.0] * 7), (2006, [1.0] * 7)]
    rows += [(None, rows[3][1]), (5, rows[5][1]), (2007, [-0.0] + [1.0] * 7), (2008, [0.0] + [1.0] * 7), (2009, [float("inf")] * 8), (2010, [1e30] * 8), (2011, [1e-30] * 8)]
    return rows


def key(r):
    return [str(x) for x in r]


def test_near_duplicates_equal_brute_force(spark):
    rows = made()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, n_links int")
    want = sorted(brute(rows), key=key)
    for options in ({}, {"list_rows": 8, "cell_rows": 7, "probes": None}):
        got = pq.near_duplicates(df, **options)
        assert sorted(map(tuple, got.collect()), key=key) == want
    assert pq.near_duplicates(df.limit(0)).collect() == []
    nothing = pq.near_duplicates(df.where("vec_id in (2000, 2002)")).collect()
    assert sorted(map(tuple, nothing)) == [(2000, 0, 2000, True), (2002, 0, 2002, True)]


def test_recall_and_no_false_links(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64))
    x[1500:] = x[rng.integers(0, 60, 1500)] + rng.normal(size=(1500, 64)) * rng.uniform(0.05, 0.32, (1500, 1))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.astype(np.float32).tolist())], "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.95).sum(1) - 1
    got = pq.near_duplicates(df).toPandas().set_index("vec_id").loc[range(3000)]
    assert (got.n_links.to_numpy() <= links).all()
    assert got.n_links.sum() >= 0.99 * links.sum() > 0
    few = pq.near_duplicates(df, probes=2, list_rows=4).toPandas().set_index("vec_id").loc[range(3000)]
    assert (few.n_links.to_numpy() <= links).all() and few.n_links.sum() < links.sum()
    every = pq.near_duplicates(df, probes=None, list_rows=4).toPandas().set_index("vec_id").loc[range(3000)]
    assert (every.n_links.to_numpy() == links).all()


def test_one_of_two_near_vectors_asks_the_others_list():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 24))
    x[2000:] = x[:2000] + rng.normal(size=(2000, 24)) * rng.uniform(0.02, 0.3, (2000, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = pq.Quantiser.fit(x, 600, None, np.sqrt(0.1) / 2)
    home, _, _, asked = book.assign(x)
    near = np.flatnonzero((x[:2000] * x[2000:]).sum(1) >= 0.95)
    assert len(near) > 500 and (home[near] != home[near + 2000]).any()
    for i in near.tolist():
        assert home[i + 2000] in asked[i] or home[i] in asked[i + 2000]


def test_a_dense_cluster_is_joined_by_its_members():
    found = pq._Found()
    a, b = (x.ravel() for x in np.meshgrid(np.arange(300), np.arange(300)))
    keep = a < b
    one = np.ones(keep.sum())
    found.add(a[keep], b[keep], one, one)
    table = found.rows().to_pylist()
    assert {r["a"]: r["n"] for r in table if r["b"] is None} == dict.fromkeys(range(300), 299)
    assert {(r["a"], r["b"]) for r in table if r["b"] is not None} == {(i, 0) for i in range(1, 300)}


def test_lookup_distance_is_within_the_stored_error():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = pq.Quantiser.fit(x, 8, 4, 0.1)
    home, codes, error, asked = book.assign(x)
    for cell in range(8):
        own = home == cell
        near = np.sqrt(book.lookups(x[:50], cell, codes[own]))
        real = np.linalg.norm(x[:50, None] - x[own][None], axis=2)
        assert (np.abs(near - real) <= error[own] + 1e-3).all()
    assert all(h in a for a, h in zip(asked, home, strict=True))


def test_every_width_has_links(spark, tmp_path):
    rows = [(i, v) for i, v in made() if i not in (2003, 2009)]
    rows += [(3000 + i, [1.0, 2.0, 3.0 + i % 2 * 0.01]) for i in range(6)] + [(3100, [1.0] * 5), (3101, [1.0] * 5), (3102, [-1.0] * 9), (3103, [4.0] * 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, queries.QUERIES["op3_pq"](spark, str(tmp_path)).collect()), key=key)
    x = [np.array(v, float) if v and None not in v and np.any(v) else None for _, v in rows]
    x = [None if v is None else v / np.linalg.norm(v) for v in x]
    like = lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b >= 0.95 - 1e-12
    links = [sum(i != j and like(x[i], x[j]) for j in range(len(x))) for i in range(len(x))]
    assert sorted((str(r[0]), r[1]) for r in got) == sorted((str(r[0]), n) for r, n in zip(rows, links, strict=True))
    found = {r[0]: r[1:] for r in got}
    assert found[2005] == (1, 2005, True) and found[2006] == (1, 2005, False)
    assert found[3005] == (5, 3000, False) and found[3101] == (1, 3100, False) and found[3103] == (0, 3103, True)
