import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lumenspan.llm import counts, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = ["<|endoftext|>", "'ll", "'re", "　", "\x85", "\x1c", *"abst'revdlmS  12\n\t\ré漢😀!.,_"]


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    return lambda texts: [len(x.ids) for x in own.encode_batch(texts, add_special_tokens=False)]


def test_equals_library_on_every_character(library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1{chr(c)}! {chr(c)}\n" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    assert counts.load(PATH).count(texts).tolist() == library(texts)


@given(st.lists(st.lists(st.sampled_from(SIGNS), max_size=40).map("".join), max_size=8))
@settings(max_examples=200, deadline=None)
def test_equals_library(texts):
    own = counts.load(PATH)
    assert own.at_once
    want = [len(x.ids) for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)] if texts else []
    assert own.count(texts).tolist() == want


def test_long_sequences_and_pieces(library, monkeypatch):
    rng = random.Random(3)
    texts = ["a" * 5000, "ab" * 3000, "".join(rng.choices("abcdefghij", k=6000)), "漢字" * 2000, " " * 5000 + "x", "ha" * 600 + " it's 'tis   \n" * 900]
    own = counts.Merger(PATH)
    assert own.count(texts).tolist() == library(texts)
    monkeypatch.setattr(counts, "PIECE_CHARS", 50)
    monkeypatch.setattr(counts, "LONG", 8)
    monkeypatch.setattr(counts, "MEMO", 100)
    assert counts.Merger(PATH).count(texts).tolist() == library(texts)


def test_one_place_a_round_gives_the_same(monkeypatch):
    rng = random.Random(5)
    units = ["".join(rng.choices("abcdeest", k=rng.randint(2, 60))).encode() for _ in range(300)]
    own = counts.Merger(PATH)
    want = own.merge(units).tolist()
    own.at_once = False
    assert own.merge(units).tolist() == want
    monkeypatch.setattr(counts, "LONG", 1)
    assert own.merge(units).tolist() == want
    own.at_once = True
    assert own.merge(units).tolist() == want


def test_pairs_in_a_run_are_apart():
    at = np.array([0, 1, 2, 5, 6])
    assert counts._apart(at, at + 1).tolist() == [True, False, True, True, False]


def test_other_tokenizers_are_told():
    with pytest.raises(ValueError, match="byte-level"):
        counts.Merger(public_tokenizers.path("word_bpe_49k.json"))


def test_spark(spark, library, tmp_path):
    long = "Some words, and more. " * 60_000 + "z" * 30_000
    rows = [(1, "it's <|endoftext|> here"), (2, None), (3, ""), (3, ""), (None, "漢字 \n"), (4, long), (5, "one " * 1024), (6, "one" + " one" * 1024)]
    docs = spark.createDataFrame([(*r, -1, "x") for r in rows], "doc_id long, text string, n_tokens int, id string")
    got = counts.count_tokens(docs, PATH)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    n = library([t or "" for _, t in rows])
    want = [(i, len((t or "").encode()), k, k > 1024) for (i, t), k in zip(rows, n, strict=True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert counts.count_tokens(docs.limit(0), PATH).collect() == []
    assert counts.count_tokens(docs.select("doc_id", "text", "id"), PATH, id_col="id").columns[0] == "id"


def test_query_equals_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(texts, library(list(texts.values())), strict=True))
    got = queries.QUERIES["op11_counts"](spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)
    assert all(r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 1024) for r in got)
