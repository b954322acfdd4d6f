import zlib

import numpy as np
import pytest

from lumenspan.llm import langid


def grams(text):
    folded = "".join(c if langid._LETTER.match(c) else " " for c in text.lower())
    folded = " " + " ".join(folded.split()) + (" " if folded.split() else "")
    return {folded[i : i + n] for n in (1, 2, 3) for i in range(len(folded) - n + 1)} if text else set()


def kernel(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))


def test_kernels_equal_brute_force():
    texts = ["The cat, the hat!", "Über öl und Öfen", "the the", "", "!!", "ÖL 漢字 𐐀𐐨x"]
    model = langid.Model(texts[:3], ["en", "de", "en"])
    marks = [texts[1], texts[0], texts[2]]  # by language
    got = model.kernels(texts)[0]
    assert np.allclose(got, [[kernel(t, m) for m in marks] for t in texts], atol=1e-6)


def test_ridge_and_prediction_equal_brute_force():
    rng = np.random.default_rng(5)
    words = {"a": "lo mi ra tu".split(), "b": "xe qua dor tu".split(), "c": "zin pla mi ost".split()}
    names = [n for n in words for _ in range(12)]
    texts = [" ".join(rng.choice(words[n], 9)) for n in names]
    model = langid.Model(texts, names, landmarks=5)
    marks = [t for n in words for t in [x for x, y in zip(texts, names) if y == n][:5]]
    k = np.array([[kernel(x, y) for y in marks] for x in marks])
    values, vectors = np.linalg.eigh(k)
    whiten = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    map_of = lambda ts: np.array([[kernel(t, m) for m in marks] for t in ts]) @ whiten
    x = np.c_[map_of(texts), np.ones(len(texts))]
    y = np.array([[1.0 if n == m else -1.0 for m in words] for n in names])
    penalty = np.diag([langid.RIDGE * len(texts)] * (x.shape[1] - 1) + [0.0])
    w = np.linalg.solve(x.T @ x + penalty, x.T @ y)
    asked = ["lo ra ra", "qua xe tu", "pla ost zin lo", "mi tu", "42"]
    raw = np.c_[map_of(asked), np.ones(5)] @ w
    got, score = model.predict(asked)
    assert got == [list(words)[i] for i in raw[:4].argmax(1)] + ["und"]
    weight = np.exp(langid.STEEPNESS * (raw - raw.max(1, keepdims=True)))
    assert np.allclose(score[:4], (weight.max(1) / weight.sum(1))[:4], atol=1e-3) and score[4] == 0


def test_all_letters_of_large_scripts_are_told_apart():
    one, two = (" ".join("".join(chr(0x4E00 + shift + (7 * k * k + 13 * j) % 9000) for j in range(30)) for k in range(60)) for shift in (0, 9000))
    model = langid.Model([one, two], ["x", "y"])
    assert {ch for t in (one, two) for ch in t} <= {chr(g) for g in model.spectrum.n_grams.tolist() if g < 0x110000}
    assert model.predict([one[400:], two[400:]])[0] == ["x", "y"]


def test_long_texts_in_pieces(monkeypatch):
    text = "Straße, 12 Katzen -- und  ein Hund " * 9
    whole = langid.n_grams(text)[0]
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(langid, "BATCH_CHARS", size)
        assert (langid.n_grams(text)[0] == whole).all()
    assert len(whole) == len(grams(text))


def test_more_than_400_languages(spark):
    syllables = [a + b for a in "bcdfghjklmnpqrstvwxz" for b in "aeiou"]
    rng = np.random.default_rng(3)
    words = [["".join(syllables[k] for k in rng.integers(0, 100, 3)) for _ in range(12)] for _ in range(430)]
    rows = [(430 * c + n, " ".join(words[n][c:] + words[n][:c]), f"l{n:03d}") for n in range(430) for c in range(6)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    learned = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert set(model.languages) == learned and len(learned) > 420
    pred = model.predict([" ".join(words[n]) for n in range(430)])[0]
    assert np.mean([p == f"l{n:03d}" for n, p in enumerate(pred)]) > 0.95


def test_no_rows_learned():
    assert langid.Model([], []).predict(["text", None]) [0] == ["und", "und"]


def test_identify(spark):
    rows = [(i, w * 20, lang, "s") for i, (w, lang) in enumerate([("the and of with ", "en"), ("der und die mit ", "de")] * 60)]
    rows += [(900, None, "en", "s"), (901, "12 !?", "de", "s"), (902, "", None, "s"), (None, "the and of", None, "s"), (903, "der und die " * 20_000, None, "s"), (903, "der und die " * 20_000, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.train(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1 if r.doc_id is not None else False)
        assert 0 <= r.score <= 1
    pred = {r.doc_id: r.lang_pred for r in got}
    assert [pred[k] for k in (900, 901, 902, None, 903)] == ["und", "und", "und", "en", "de"]
    assert all(pred[i] == lang for i, _, lang, _ in rows[:120])
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns
    back = {r.doc_id: r.lang for r in kept.collect()}
    assert not {900, 901, 902} & set(back) and back[903] == "de" and len(back) == 122
    assert langid.identify(docs.limit(0), langid.train(docs.limit(0))).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.train(docs)).join(docs, "doc_id").where("held_out and lang is not null").toPandas()
    assert len(got) > 200
    assert (got.lang_pred == got.lang).mean() > 0.98
    assert got.score.median() > 0.9


@pytest.mark.parametrize("text", ["²½", "٣", "ª"])
def test_letters(text):
    model = langid.Model(["abc"], ["en"])
    assert model.predict([text])[0] == (["en"] if text == "ª" else ["und"])


def test_draws_are_the_first_by_hash(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"text {i * i} {chr(97 + i % 26)}", "en" if i % 10 else "de") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, per_language=60)
    drawn = docs.where(~langid.held_out(F.col("doc_id"))).withColumn("draw", F.xxhash64(F.col("doc_id").cast("string"), "text")).collect()
    first = [sorted((r.draw, r.text) for r in drawn if r.lang == name)[:60] for name in ("de", "en")]
    want = langid.Model([t for f in first for _, t in f], ["de"] * 60 + ["en"] * 60)
    assert (model.spectrum.n_grams == want.spectrum.n_grams).all() and np.allclose(model.weights, want.weights)


def test_language_with_long_texts_only(spark):
    rows = [(i, w * 20, lang) for i, (w, lang) in enumerate([("the and of with ", "en"), ("der und die mit ", "de")] * 30)]
    rows += [(100 + i, "och att det som ".ljust(16) * 2_000, "sv") for i in range(12)] + [(200, "the and of with " * 9_000, "en"), (201, "och det att som " * 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == ["de", "en", "sv"]
    pred = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert pred[201] == "sv" and all(pred[i] == lang for i, _, lang in rows[:-1])
