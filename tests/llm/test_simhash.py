from itertools import combinations

import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st

from lumenspan.llm import simhash


def brute_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, max_diff):
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if bin(rows[i][1] ^ rows[j][1]).count("1") <= max_diff:
            up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [least.get(root(i)) for i in range(len(rows))]


@given(st.text(alphabet="ab \n\tÉß", max_size=60))
@settings(max_examples=100, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_fingerprint_in_chunks(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(500)) + " tail"
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "CHUNK_BYTES", 16)
    assert simhash.fingerprint(text.encode()) == whole == brute_fingerprint(text)


def test_every_four_positions_hold_a_triple():
    sets = simhash.triples()
    assert len(sets) == len(set(sets)) == 20
    assert all(any(set(t) <= set(q) for t in sets) for q in combinations(range(8), 4))


def test_tally():
    x = np.array([0, 0xFF, 1 << 63, 0x0101010101010101], np.uint64)
    assert simhash.tally(x).tolist() == [8, 7, 7, 0]


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    made = [int(b) for b in base]
    for b in base[:10]:  # chains and clusters around ten of them
        x = int(b)
        for _ in range(60):
            x ^= sum(1 << int(p) for p in rng.choice(64, int(rng.integers(1, 6)), replace=False))
            made.append(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in set(made)]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    for max_diff, list_rows in ((4, simhash.LIST_ROWS), (4, 16), (5, 64), (7, 64)):
        found = {(r.a, r.b) for r in simhash.links(fps, max_diff, list_rows).collect()}
        rows = [(i, v & (2**64 - 1)) for i, v in enumerate(signed)]
        want = brute_components(rows, max_diff)
        place = {v: i for i, v in enumerate(signed)}
        up = {i: i for i in range(len(rows))}

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in found:
            up[root(place[a])] = root(place[b])
        groups = {}
        for i in range(len(rows)):
            groups.setdefault(root(i), []).append(i)
        got = [min(groups[root(i)]) for i in range(len(rows))]
        assert got == want


def test_near_duplicates(spark):
    long = " ".join(f"word{i}" for i in range(400))
    data = [(1, long, "x"), (2, long, "y"), (3, long.upper(), "z"), (4, None, None), (5, "", "x"), (6, " \n", "x"), (7, "a b", "q"), (None, long, "n"), (9, long + " extra", "x"), (9, long + " extra", "x"), (10, "z" * 100_000, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, component_id string")
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    rows = [(d, brute_fingerprint(t)) for d, t, _ in data]
    want = sorted((d or -1, f"{f:016x}", c) for (d, f), c in zip(rows, brute_components(rows, 4), strict=True))
    assert got == want
    assert {g[0]: g[2] for g in got}[6] == 4
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_keep_one(spark):
    long = " ".join(f"word{i}" for i in range(400))
    other = " ".join(f"other{i}" for i in range(300))
    data = [(4, long, "x"), (2, long, "y"), (3, long + " z", "z"), (4, None, None), (5, "", "x"), (9, other, "q"), (9, other, "q"), (9, other, "p"), (None, other, "n"), (None, "lone text here", "n"), (7, "lone two", "n"), (7, "lone three", "n")]
    docs = spark.createDataFrame(data, "doc_id long, text string, times string")
    got = simhash.keep_one(docs)
    assert got.schema == docs.schema
    rows = sorted(got.collect(), key=str)
    want = [(2, long), (4, None), (9, other), (None, "lone text here"), (7, "lone two"), (7, "lone three")]
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(want, key=str)
    assert simhash.keep_one(docs.limit(0)).collect() == []


def brute_sketch(text, k):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    out = []
    for n in range(8):
        mixed = []
        for h in hashes:
            h = h * (0x9E3779B97F4A7C15 * (2 * n + 1)) % 2**64
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
            mixed.append(h ^ h >> 29)
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in mixed) > len(mixed)))
    return out


@given(st.text(alphabet="ab \n\tÉß", max_size=60))
@settings(max_examples=50, deadline=None)
def test_sketch(text):
    fp, sketch = simhash.with_sketch(text.encode(), 3)
    assert fp == brute_fingerprint(text, 3) and sketch.tolist() == brute_sketch(text, 3)


def test_only_pairs_with_enough_shared_bytes_are_verified(monkeypatch):
    rng = np.random.default_rng(8)
    f = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    f = (f & np.uint64(0x000000FFFFFFFFFF)) | np.uint64(0x1234560000000000)  # a list under the first three positions
    f[2000:2100] = f[:100] ^ np.uint64(0b1011)
    x = f[:, None] ^ f[None]
    shared_bytes = sum((((x >> np.uint64(8 * i)) & np.uint64(0xFF)) == 0).astype(int) for i in range(8))
    met = {(i, j) for part in simhash._postings(f, (0, 1, 2)) for i, j in combinations(sorted(part.tolist()), 2)}
    assert met == {(int(i), int(j)) for i, j in np.argwhere(np.triu(shared_bytes >= 4, 1))}
    seen, verify = [], simhash.verify
    monkeypatch.setattr(simhash, "verify", lambda x, d: (seen.append(len(x)), verify(x, d))[1])
    links = simhash.linked(4)(x[..., None])
    assert sum(seen) == (shared_bytes >= 4).sum() < x.size / 10
    assert (links == (np.bitwise_count(x) <= 4)).all() and links.sum() > 3000


def test_join_unique(spark):
    from lumenspan.llm.components import join_unique

    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 500}") for i in range(3000)] + [(-1, None), (-2, "none")]
    table = {}
    for _, k in rows:
        if k not in (None, "none"):
            table[k] = table.get(k, 0) + 1
    got = join_unique(spark.createDataFrame(rows, "i long, k string"), spark.createDataFrame([(k, f"v{k}", n) for k, n in table.items()], "k string, v string, n long"), "k")
    assert sorted((r.i, r.k, r.v) for r in got.collect()) == sorted((i, k, f"v{k}") for i, k in rows if k in table)
    assert got.columns == ["k", "i", "v"]


def made_copies():
    rng = np.random.default_rng(3)
    data, n = [], 0
    for base in range(25):
        words = [f"b{base}w{k}" for k in range(int(rng.integers(60, 200)))]
        for _ in range(14):
            changed = list(words)
            for at in rng.choice(len(words), int(rng.integers(0, 7)), replace=False):
                changed[at] = f"new{n}x{at}"
            data.append((n, " ".join(changed)))
            n += 1
    return data


def test_keep_one_finds_texts_of_a_similarity_of_four_fifths(spark):
    data = made_copies()
    n = len(data)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    prints = [brute_fingerprint(t, 5) for _, t in data]
    sketches = [simhash.with_sketch(t.encode(), 5)[1] for _, t in data]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in data]
    met, every = list(range(n)), list(range(n))

    def root(up, i):
        while up[i] != i:
            i = up[i]
        return i

    def join(up, i, j):
        a, b = root(up, i), root(up, j)
        up[max(a, b)] = min(a, b)

    pairs = list(combinations(range(n), 2))
    blocks = [x.view(np.uint16) for x in sketches]
    near = {p: np.bitwise_count(sketches[p[0]] ^ sketches[p[1]]).sum() <= 128 for p in pairs}
    connected = list(range(n))
    for i, j in pairs:
        if near[i, j] and (blocks[i] == blocks[j]).any():
            join(connected, i, j)
    alike = found = 0
    for i, j in pairs:
        like = len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            join(met, i, j)
            join(every, i, j)
        if like:
            join(every, i, j)
            alike, found = alike + 1, found + (blocks[i] == blocks[j]).any()
            if near[i, j] and root(connected, i) == root(connected, j):
                join(met, i, j)
    want = [i for i in range(n) if root(met, i) == i]
    assert alike > 300 and found >= 0.9 * alike
    for options in ({}, {"group_rows": 6}, {"list_rows": 40}):
        assert sorted(r.doc_id for r in simhash.keep_one(docs, least=0.8, **options).collect()) == want
    assert len(want) - sum(root(every, i) == i for i in range(n)) <= 3
    assert len(want) < simhash.keep_one(docs).count()


def test_keep_one_without_broadcasts_and_with_maps(spark, monkeypatch):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(k, long, [{"a": k}], ({"b": None},)) for k in (3, 3, 5, None)] + [(8, None, None, None), (9, "", [None], (None,)), (1, "lone text", [], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags array<map<string,long>>, more struct<m: map<string,long>>")
    for most in (simhash.BROADCAST_ROWS, 0):
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", most)
        got = simhash.keep_one(docs, least=0.8)
        assert got.schema == docs.schema
        assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "lone text"), (3, long), (8, None)]
