import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from lumenspan.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = st.sampled_from("abeinorst thing. \n\tÉßé漢😀 ")


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(PATH)


@pytest.fixture(scope="module")
def library():
    """The same model with its algorithm field turned from merges (2) to the best score (1)."""
    raw = open(PATH, "rb").read()
    at = raw.rindex(b"tok_v0\x18\x02") + 7
    return sentencepiece.SentencePieceProcessor(model_proto=raw[:at] + b"\x01" + raw[at + 1 :])


@given(st.text(ALPHABET, max_size=30))
@settings(max_examples=300, deadline=None)
def test_equals_library(text):
    own, library = pieces.load(PATH), _library()
    assert own.encode(text).tolist() == library.encode(text)
    assert own.decode(own.encode(text)) == text


def _library(kept=[]):  # noqa: B006
    if not kept:
        raw = open(PATH, "rb").read()
        at = raw.rindex(b"tok_v0\x18\x02") + 7
        kept.append(sentencepiece.SentencePieceProcessor(model_proto=raw[:at] + b"\x01" + raw[at + 1 :]))
    return kept[0]


def brute(own, unit):
    """The best score of all segmentations, by recursion over the pieces."""
    table = {own.names[i]: s for _, (_, s, i) in ((k, v) for k, v in own.automaton.items())}
    score = [0.0]
    for end in range(1, len(unit) + 1):
        got = [score[a] + table[unit[a:end]] for a in range(end) if unit[a:end] in table]
        if unit[end - 1] not in table:
            got.append(score[end - 1] + own.alone)
        score.append(max(got))
    return score[-1]


@given(st.text(st.sampled_from("abeinst▁漢"), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_best_score(unit):
    own = pieces.load(PATH)
    scores = {i: s for _, (_, s, i) in own.automaton.items()}
    got = sum(scores.get(i, 0) for i in own.best(unit))
    alone = sum(1 for c in unit if c not in own.automaton)
    assert abs(got + alone * own.alone - brute(own, unit)) < 1e-6


def test_words_give_the_same_as_whole_texts(own):
    text = "The quick brown fox  jumps over\nthe lazy dog. " * 3
    assert own.encode(text).tolist() == own.best(pieces.MARK + text.replace(" ", pieces.MARK))


def test_spark(spark):
    rows = [(1, "of the thing", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "漢字 \x00\n", None), (5, "long words " * 30_000 + "z" * 50_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.decode(pieces.encode(docs, PATH), PATH)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    table = got.collect()
    assert len(table) == len(rows) and all(r.decoded == r.text for r in table)
    assert pieces.encode(docs.limit(0), PATH).collect() == []
    once = pieces.encode(docs, PATH, decoded_col="Text2")
    assert once.columns == ["doc_id", "text", "ids", "Text2"] and all(r.Text2 == r.text for r in once.collect())
