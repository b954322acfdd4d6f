import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lumenspan.llm import queries, tries
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    nodes = defaultdict(list)
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        seqs[c] = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seqs[c]) + 1):
            nodes[seqs[c][:d]].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    out, sums = [], {}
    for p in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        sums[p] = (sum(sums[k][0] for k in children[p]) or 1, (len(nodes[p]) - 1) * words + sum(sums[k][1] for k in children[p]))
        ends = ",".join(map(str, sorted(c for c in nodes[p] if seqs[c] == p)))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(children[p]), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made():
    rng = random.Random(2)
    rows = []
    for c in range(-5, 130):
        if c % 20 == 0 and c > 60:
            continue  # groups without their first conversation
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "system"]), rng.choice(["hello there", "a b c", "other  \n words of it", ""])))
    rows += [(1000 + k, t, "user", f"copy {t} of a third of all") for k in range(90) for t in range(6)]
    rows += [(2000 + k, t, "user", f"copy {t} of a third of all" if t < 4 else f"own {k % 7}") for k in range(30) for t in range(4 + k % 4)]
    rows += [(7, None, None, None), (7, None, "user", "null first"), (7, 0, "user", "hello there"), (7, 0, "user", "hello there"), (None, 1, "user", "nobody's"), (8, 3, "u", None)]
    rows += [(5000, t, "user", "long one") for t in range(700)] + [(5001, t, "user", "long one") for t in range(690)]
    rows += [(6001, 0, "user", "w " * 50_000), (9003, 0, "a:b", "c"), (9003, 1, "a", "b:c")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("local", [1, 40, None])
def test_trie_equals_brute_force(spark, local):
    rows = made()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, bucket string")
    got = tries.trie(table, local_turns=local)
    assert got.columns == NAMES
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_ends_in_chunks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tries, "CHUNK", 7)
    rows = made()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, tries.trie(table, local_turns=1).collect()), key=str) == brute(rows)
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    assert differences(spark, connect(str(tmp_path)), str(tmp_path), queries.QUERIES["op13_trie"], tries.ORACLE) == []


def test_no_turns_and_no_rows(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert tries.trie(spark.createDataFrame([], kind)).collect() == []
    assert tries.trie(spark.createDataFrame([(None, 1, "a", "b")], kind)).collect() == []
    # All are without turns once their first ones are the absent first conversation's.
    rows = [(c, 0, "user", "x") for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    assert sorted(map(tuple, tries.trie(spark.createDataFrame(rows, kind)).collect())) == brute(rows)
    alone = [(40, t, "user", f"turn {t}") for t in range(5)]
    assert sorted(map(tuple, tries.trie(spark.createDataFrame(alone, kind)).collect()), key=str) == brute(alone)


def test_multikey_on_chains_and_prefixes():
    codes = [np.array(x) for x in ([5], [5, 1], [5, 1, 2], [5, 1, 2], [5, 0])]
    nodes = tries.multikey([3, 4, 6, 9, 11], codes, [np.ones(len(c), int) for c in codes], 2, 1)
    got = {(n[0], n[1]): n[2:7] for n in nodes}
    assert got[(3, 2)] == [1, 5, 2, 2, 4 + 2 + 1]
    assert got[(4, 3)] == [3, 3, 1, 1, 3] and got[(6, 4)] == [4, 2, 0, 1, 1] and got[(11, 3)] == [3, 1, 0, 1, 0]


def test_query_equals_sql(spark):
    assert differences(spark, connect(SF), SF, queries.QUERIES["op13_trie"], tries.ORACLE) == []
