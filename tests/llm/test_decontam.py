import re

import numpy as np
from hypothesis import given, settings, strategies as st

from lumenspan.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")


def brute(docs, items, size=13):
    out = []
    for text in docs:
        words, hit, own = WORD.findall(lower(text)), set(), set()
        for i, item in items:
            w = WORD.findall(lower(item))
            for at in range(max(1, len(w) - size + 1)) if w else ():
                window = w[at : at + size]
                for p in range(len(words) - len(window) + 1):
                    if words[p : p + len(window)] == window:
                        hit |= set(range(p, p + len(window)))
                        own.add("" if i is None else str(i))
        out.append((len(words), len(hit), sorted(own), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def brute_longest(docs, items, size=13):
    out = []
    for text in docs:
        words, own = WORD.findall(lower(text)), {}
        for i, item in items:
            w = WORD.findall(lower(item))
            for p in range(len(words)):
                for q in range(len(w)):
                    n = 0
                    while p + n < len(words) and q + n < len(w) and words[p + n] == w[q + n]:
                        n += 1
                    if n >= min(size, len(w)):
                        name = "" if i is None else str(i)
                        own[name] = min(own.get(name, (0, 0, 0)), (-n, p, q))
        out.append({k: (-n, p, q) for k, (n, p, q) in own.items()})
    return out


def matches(docs, items, size=13):
    block = decontam.Block.load(decontam.Block.of([(i, None if t is None else t.encode()) for i, t in items]).dump())
    return decontam.Matches([None if d is None else d.encode() for d in docs], iter([block]), size)


def found(docs, items, size=13):
    m = matches(docs, items, size)
    return [(int(m.n_words[k]), int(m.n_hit[k]), sorted(m.items[k]), bool(m.contaminated[k])) for k in range(len(docs))]


texts = st.lists(st.sampled_from(["a", "b", "A", "c", "é", "\x7f", "D9", "-"]), max_size=14).map(" ".join)


@given(st.lists(texts | st.none(), max_size=5), st.lists(st.tuples(st.integers(0, 12) | st.none(), texts | st.none()), max_size=5), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_matches_equal_brute_force(docs, items, size):
    assert found(docs, items, size) == brute(docs, items, size)
    assert matches(docs, items, size).items == brute_longest(docs, items, size)


@given(st.lists(st.lists(st.integers(0, 2), max_size=12), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_suffix_array_equals_sorting(docs):
    words = np.array([w for d in docs for w in (*d, -1)], np.int32)
    gaps = iter(range(-100, 0))
    told = [w if w >= 0 else next(gaps) for w in words.tolist()]
    assert decontam.suffix_array(words).tolist() == sorted(range(len(told)), key=lambda i: told[i:])


def test_every_test_suffix_has_its_longest_match():
    rng = np.random.default_rng(2)
    docs = [" ".join(rng.choice(list("abcd"), 300)) for _ in range(4)]
    item = " ".join(rng.choice(list("abcde"), 80))
    shard = decontam.Shard([d.encode() for d in docs])
    search = decontam.Search(shard, decontam.Block.of([(1, item.encode())]), 13)
    w, texts = item.split(), [d.split() for d in docs]
    for q in range(80):
        longest = max(n for n in range(81 - q) if any(t[p : p + n] == w[q : q + n] for t in texts for p in range(len(t) - n + 1)))
        assert search.longest[q] == longest
        doc = int(np.searchsorted(shard.begins, search.at[q], "right")) - 1
        at = int(search.at[q] - shard.begins[doc])
        assert longest == 0 or texts[doc][at : at + longest] == w[q : q + longest]


def test_items_side_by_side_are_two_matches():
    a, b = (" ".join(f"{x}{k}" for k in range(13)) for x in "ab")
    m = matches([f"so {a} {b} end"], [(1, a), (2, b)])
    assert m.items == [{"1": (13, 1, 0), "2": (13, 14, 0)}] and m.n_hit[0] == 26


def test_repeated_words_and_few_pairs_at_once(monkeypatch):
    docs, items = ["a " * 400, "b " + "a " * 60 + "c", "x"], [(1, "a " * 90), (2, "a " * 20 + "b"), (3, "c"), (1, "a a c")]
    want = brute_longest(docs, items)
    for most in (1 << 21, 1000, 7):
        monkeypatch.setattr(decontam, "PAIRS", most)
        assert matches(docs, items).items == want and found(docs, items) == brute(docs, items)


def test_words_in_chunks(monkeypatch):
    text = "Über-Öl 12a_b " * 40 + "end"
    whole = [w for run in decontam.words_of(text.encode()) for w in run]
    monkeypatch.setattr(decontam, "CHUNK_BYTES", 7)
    assert [w for run in decontam.words_of(text.encode()) for w in run] == whole == [w.encode() for w in WORD.findall(lower(text))]


def test_spark_results(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(rng.choice(words, 20))) for i in range(30)] + [(30, "w1 w2"), (31, None), (None, "zz " * 15), (3, "w7 w7 w7")]
    docs = [(i, " ".join(rng.choice(words, 60)), "x") for i in range(30)]
    docs += [(100 + i, " ".join(rng.choice(words, 9)) + " " + items[i][1].upper() + " tail", None) for i in range(30)]
    docs += [(200, None, "x"), (201, "", "x"), (202, "zz " * 20, "x"), (None, items[5][1], "x"), (202, "zz " * 20, "x"), (203, "q" * 300_000 + " " + items[2][1], "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(zip([x[0] or -1 for x in docs], brute([x[1] for x in docs], items), strict=True))
    for block_bytes in (decontam.BLOCK_BYTES, 900):
        rows = decontam.contamination(d, b, block_bytes=block_bytes).collect()
        assert sorted((r.doc_id or -1, (r.n_words, r.n_hit, r["items"], r.contaminated)) for r in rows) == want
        longest = {x[0]: y for x, y in zip(docs, brute_longest([x[1] for x in docs], items), strict=True)}
        assert all({m.item: (m.n_words, m.start, m.item_start) for m in r.matches} == longest[r.doc_id] for r in rows)
        assert all(r.longest == max([0, *(m.n_words for m in r.matches)]) for r in rows)
        best = decontam.longest_matches(d, b, block_bytes=block_bytes).collect()
        assert {r["item"]: r.n_words for r in best} == {i: max(y[i][0] for y in longest.values() if i in y) for y in longest.values() for i in y}
    kept = decontam.decontaminate(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i for i, x in want if not x[3])
    assert decontam.contamination(d.limit(0), b).count() == 0
    assert not any(r.n_hit for r in decontam.contamination(d, b.limit(0)).collect())
