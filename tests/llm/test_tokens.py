import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lumenspan.llm import shared, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


class Kept(io.BytesIO):
    def close(self):
        self.kept = self.getvalue()


@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 40), max_size=400), max_size=12), st.integers(1, 3))
@settings(max_examples=60, deadline=None)
def test_file_round_trip(docs, repeat):
    out = Kept()
    writer = tokens.Writer(out)
    arrays = [np.array(d * repeat, np.uint32) for d in docs]
    for k, ids in enumerate(arrays):
        writer.add(None if k == 3 else k - 2, ids)
    writer.close()
    reader = tokens.Reader(out.kept)
    assert reader.doc_ids == [None if k == 3 else k - 2 for k in range(len(docs))]
    assert [x.tolist() for _, x in reader.runs(100)] == [a.tolist() for a in arrays]
    assert [reader.document(k).tolist() for k in range(len(docs))] == [a.tolist() for a in arrays]


@pytest.mark.parametrize("bits", range(33))
def test_each_width(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 3000, dtype=np.uint64).astype(np.uint32)
    blocks = tokens.pack(ids)
    starts = np.cumsum([0, *map(len, blocks)])
    assert (tokens.unpack(memoryview(b"".join(blocks)), starts) == ids).all()


def test_outliers_do_not_widen_a_block():
    ids = np.arange(1024, dtype=np.uint32) % 16
    ids[::50] = 50_000
    assert len(tokens.pack(ids)[0]) < 12 + 128 * 4 + 6 * 21 + 1


@given(st.text(alphabet=st.sampled_from("ab ' \n\t\r\x0b\x1c\x85  é9.,s<|>"), max_size=40) | st.text(max_size=30))
@settings(max_examples=400, deadline=None)
def test_encoder_equals_library(text):
    own = tokens._encoder(PATH)
    assert own.encode(text).tolist() == own.library.encode(text, add_special_tokens=False).ids


def test_special_token_text():
    own = tokens._encoder(PATH)
    for text in ("a <|endoftext|> b", "a b\nc's d", "", " a", "a\n", "a\0b c\nd", "z" * 99 + " a"):
        assert own.encode(text).tolist() == own.library.encode(text, add_special_tokens=False).ids


def test_write_and_read(spark):
    library = Tokenizer.from_file(PATH)
    data = [(5, "Of the\nthing, and.", "x"), (2, None, "y"), (9, "", "z"), (None, "one two", None), (7, "  odd \t spacing\n\n", "q"), (5, "another", "q"), (11, "word " * 30_000 + "end", "q"), (5, "another", "q")]
    docs = spark.createDataFrame(data, "doc_id long, text string, start string")
    manifest = tokens.write_tokens(docs, shared.scratch(spark, "tokens"), PATH)
    rows = tokens.read_tokens(manifest, with_ids=True).collect()
    assert len(rows) == len(data)
    rows = sorted(rows, key=lambda r: r.start)
    keys = [(-1 if r.doc_id is None else r.doc_id) for r in rows]
    assert keys == sorted(keys)
    at = 0
    left = [(d, tuple([*library.encode(t or "", add_special_tokens=False).ids, 2])) for d, t, _ in data]
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        left.remove((r.doc_id, tuple(r.ids)))
        at += r.n_tokens
    empty = tokens.write_tokens(docs.limit(0), shared.scratch(spark, "tokens"), PATH)
    assert tokens.read_tokens(empty).collect() == []


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    import public_tokenizers

    plain = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    texts = ["a b, c", "Hello World again", "", "über, alles x"]
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": plain["pre_tokenizer"] | {"add_prefix_space": True}}, {"pre_tokenizer": {"type": "WhitespaceSplit"}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(plain | change))
        encoder = tokens.ByteLevelEncoder(str(path))
        assert encoder.odd == ""
        for t in texts:
            assert encoder.encode(t).tolist() == encoder.library.encode(t, add_special_tokens=False).ids
    assert tokens.ByteLevelEncoder(public_tokenizers.path("byte_bpe_50k.json")).odd
