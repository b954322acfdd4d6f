"""Language identification with string kernels.

The kernel of two texts is the number of distinct character n-grams, of one to three characters,
that both have (a blended spectrum of presence), scaled by the norms of both, which count all
n-grams of a text. Characters are letters as they are, lower-cased; what is no letter is a space.
Landmark texts give a Nystroem map of the kernel, and one ridge regression a language is solved in
that space, each against the rest. Texts are scored in batches: presence matrix times landmark
matrix gives the kernels, kernels times coefficients the scores.

Fitting takes a bounded sample of labelled rows: of each language the first by a hash, so many that
they are ``FIT_ROWS`` in all (two of each language at least), of at most ``FIT_CHARS`` characters
each; landmarks, ``ALL_LANDMARKS`` in all (one of each language at least), have ``LANDMARK_CHARS``
characters together. All languages and all letters are told apart. Scoring takes whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenspan.llm import shared

#: Texts a language that a model is fitted on, landmarks among them, and characters of such a text.
PER_LANGUAGE, LANDMARKS, FIT_CHARS = 250, 24, 20_000
#: Texts and landmarks in all (or two texts and one landmark of each language), characters of all landmarks.
FIT_ROWS, ALL_LANDMARKS, LANDMARK_CHARS = 4_000, 800, 1 << 20
RIDGE, STEEPNESS = 1e-3, 4.0
#: Characters of text, and rows, that are scored at once; n-grams of one step of a product.
BATCH_CHARS, BATCH_ROWS, STEP_GRAMS = 1 << 20, 256, 8192
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_ALL_LETTERS = regex.compile(r"\p{L}+")
_SPACE = 32


class _Letters:
    """Which code points are letters; made once a process."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, points: np.ndarray) -> np.ndarray:
        if cls.table is None:
            table = np.zeros(0x110000, bool)
            every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
            for m in _ALL_LETTERS.finditer(every):
                a, b = (p if p < 0xD800 else p + 0x800 for p in (m.start(), m.end() - 1))
                table[a : b + 1] = True
            table[0xD800:0xE000] = False
            cls.table = table
        return cls.table[points]


def n_grams(text: str) -> tuple[np.ndarray, bool]:
    """The distinct n-grams of a text, in order, as numbers; whether it has a letter.

    Three code points of 21 bits fill a number; shorter n-grams leave the upper ones zero.
    """
    found, lettered, before = [], False, np.array([_SPACE], np.int64)
    for at in range(0, len(text), BATCH_CHARS):
        last = at + BATCH_CHARS >= len(text)
        points = np.frombuffer(text[at : at + BATCH_CHARS].lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        letter = _Letters.of(points)
        lettered = lettered or bool(letter.any())
        run = np.concatenate([before, np.where(letter, points, _SPACE), np.full(int(last), _SPACE)])
        space = run == _SPACE
        run = run[~(space & np.concatenate([[False], space[:-1]]))]
        two = (run[:-1] << 21) | run[1:]
        three = (two[:-1] << 21) | run[2:]
        found.append(np.unique(np.concatenate([run, two, three])))
        before = run[-2:]
    if not found:
        return np.zeros(0, np.int64), False
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found)), lettered


class Spectrum:
    """The n-grams of some landmark texts, with the landmarks that have each: a sparse matrix by rows."""

    def __init__(self, landmarks: list[str]) -> None:
        own = [n_grams(t)[0] for t in landmarks]
        self.rows = len(own)
        self.norms = np.sqrt(np.array([max(1, len(g)) for g in own], np.float64))
        grams = np.concatenate(own or [np.zeros(0, np.int64)])
        self.n_grams, at = np.unique(grams, return_inverse=True)
        order = np.argsort(at, kind="stable")
        self.landmark = np.repeat(np.arange(self.rows, dtype=np.int32), [len(g) for g in own])[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(self.n_grams)))]).astype(np.int64)

    def _places(self, grams: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.n_grams, grams)
        return at[self.n_grams[np.minimum(at, len(self.n_grams) - 1)] == grams] if len(self.n_grams) else at[:0]

    def kernels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Kernels of texts (rows) and landmarks (columns); whether each text has a letter."""
        norms, lettered, held = np.ones(len(texts)), np.zeros(len(texts), bool), []
        for i, t in enumerate(texts):
            grams, lettered[i] = n_grams(t)
            norms[i] = max(1, len(grams)) ** 0.5
            held.append(self._places(grams))
        out = np.zeros((len(texts), self.rows), np.float32)
        row = np.repeat(np.arange(len(texts)), [len(h) for h in held])
        place = np.concatenate(held or [np.zeros(0, np.int64)])
        used, column = np.unique(place, return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for low in range(0, len(used), STEP_GRAMS):
            part = used[low : low + STEP_GRAMS]
            count = self.begin[part + 1] - self.begin[part]
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            ours = np.zeros((self.rows, len(part)), np.float32)
            ours[self.landmark[np.repeat(self.begin[part], count) + within], np.repeat(np.arange(len(part)), count)] = 1
            a, b = np.searchsorted(column, [low, low + len(part)])
            theirs = np.zeros((len(texts), len(part)), np.float32)
            theirs[row[a:b], column[a:b] - low] = 1
            out += theirs @ ours.T
        return out / norms[:, None] / self.norms, lettered


class Model:
    """One ridge regression a language over kernels with the landmarks."""

    def __init__(self, texts: list[str], languages: list[str], landmarks: int = LANDMARKS) -> None:
        self.languages = sorted(set(languages))
        landmarks = max(1, min(landmarks, ALL_LANDMARKS // max(1, len(self.languages))))
        by_language: dict[str, list[int]] = {}
        for i, name in enumerate(languages):
            by_language.setdefault(name, []).append(i)
        chosen = [i for name in self.languages for i in by_language[name][:landmarks]]
        chars = max(1, LANDMARK_CHARS // max(1, len(chosen)))
        marks = [texts[i][:chars] for i in chosen]
        self.spectrum = Spectrum(marks)
        batched = lambda x: np.concatenate([self.kernels(x[i : i + BATCH_ROWS])[0] for i in range(0, len(x), BATCH_ROWS)] or [np.zeros((0, 0))])
        values, vectors = np.linalg.eigh(batched(marks))
        good = values > 1e-6
        whiten = vectors[:, good] / np.sqrt(values[good])
        features = batched(texts) @ whiten if texts else np.zeros((0, 0))
        features = np.concatenate([features, np.ones((len(features), 1))], 1)
        target = np.where(np.array(languages)[:, None] == np.array(self.languages), 1.0, -1.0) if texts else np.zeros((0, 0))
        ridge = RIDGE * max(1, len(texts)) * np.eye(features.shape[1])
        ridge[-1, -1] = 0
        solved = np.linalg.lstsq(features.T @ features + ridge, features.T @ target, rcond=None)[0] if texts else np.zeros((1, 0))
        self.weights, self.offset = whiten @ solved[:-1], solved[-1]

    def kernels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        kernels, lettered = self.spectrum.kernels(texts)
        return kernels.astype(np.float64), lettered

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; "und" and zero without a letter, or if none was learned."""
        kernels, lettered = self.kernels([t or "" for t in texts])
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        raw = kernels @ self.weights + self.offset
        weight = np.exp(STEEPNESS * (raw - raw.max(1, keepdims=True)))
        best = raw.argmax(1)
        score = np.where(lettered, weight.max(1) / weight.sum(1), 0.0)
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)], score


def held_out(key: Column) -> Column:
    """Whether a row is never learned from: crc32 of its id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on rows that aren't held out and have a text and a language.

    The texts of a language that are drawn are the first by a hash of id and text, so the same rows
    give the same model in any partitioning; repeated rows are drawn once. Texts over ``FIT_CHARS``
    characters are drawn only for a language that has no shorter one, and learned from their first
    ``FIT_CHARS``. Every language is learned. Null ids count as the empty text. Without a labelled
    row the model knows no language and tells "und" for all texts. Other columns aren't read.
    """
    key, text = F.col(id_col), F.col(text_col).cast("string")
    open_rows = docs.where(~held_out(key) & F.col(lang_col).isNotNull() & text.isNotNull())
    labelled = open_rows.select(
        F.col(lang_col).cast("string").alias("lang"),
        F.left(text, F.lit(FIT_CHARS)).alias("text"),
        F.xxhash64(key.cast("string"), text).alias("draw"),
        (F.char_length(text) > FIT_CHARS).alias("long"),
    )
    found = labelled.groupBy("lang").agg(F.count("*").alias("count"), F.count_if(~F.col("long")).alias("short"))
    counts = found.orderBy("lang").collect()  # one row a language
    only_long = [r.lang for r in counts if not r.short]
    rows = labelled.where(~F.col("long") | F.col("lang").isin(only_long)).drop("long")
    each = max(2, min(per_language, FIT_ROWS // max(1, len(counts))))
    # Draws are even over all 64-bit numbers: below these bounds lie some four times as many as are
    # needed, whatever a language's share, so no language is a hot group of the ranking.
    bounds = [F.lit(x) for r in counts for x in (r.lang, min(2**63 - 1, -(2**63) + (2**64) * (4 * each + 40) // (r.short or r["count"])))]
    low = rows.select("lang", "draw").where(F.col("draw") <= F.try_element_at(F.create_map(*bounds), F.col("lang"))) if counts else rows.select("lang", "draw")
    first = Window.partitionBy("lang").orderBy("draw")
    ranked = low.withColumn("n", F.row_number().over(first))
    drawn = ranked.where(F.col("n") <= each).select("lang", "draw").distinct()
    texts = rows.join(F.broadcast(drawn), ["lang", "draw"]).groupBy("lang", "draw").agg(F.min("text").alias("text")).collect()
    texts = sorted((r.lang, r.draw, r.text) for r in texts)
    return Model([t for _, _, t in texts], [name for name, _, _ in texts])


def _scored(model, column: int, tell):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for piece in shared.slices(whole, column, BATCH_CHARS):
                for at in range(0, piece.num_rows, BATCH_ROWS):
                    batch = piece.slice(at, BATCH_ROWS)
                    languages, scores = model.value.predict(batch.column(column).to_pylist())
                    yield tell(batch, languages, scores)

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``held_out``, ``lang_pred``, ``score`` (0 to 1).

    ``lang_pred`` is "und" with score zero where the text is null or has no letter. A null id counts
    as the empty text when folds are dealt. Repeated rows stay repeated; an empty table gives no
    rows. Other columns aren't read.
    """

    def tell(batch: pa.RecordBatch, languages: list[str], scores: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(languages, pa.string()), pa.array(scores)], [id_col, "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held_out"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return shared.arrow(rows, _scored(shipped, 1, tell), f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is told with a score of ``least`` or more.

    A null ``lang_col`` becomes the predicted language. Null and empty texts, and texts without a
    letter, go. Very long texts are scored whole. Repeated rows share their fate; other columns,
    null or not, are kept as they are; an empty table gives no rows.
    """
    text, lang = shared.place(docs, text_col), shared.place(docs, lang_col)

    def tell(batch: pa.RecordBatch, languages: list[str], scores: np.ndarray) -> pa.RecordBatch:
        known = batch.column(lang).to_pylist()
        filled = pa.array([a if a is not None else b for a, b in zip(known, languages, strict=True)], batch.schema.field(lang).type)
        keep = [s >= least and x != UNKNOWN for s, x in zip(scores.tolist(), languages, strict=True)]
        return batch.set_column(lang, batch.schema.field(lang), filled).filter(pa.array(keep, pa.bool_()))

    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return shared.arrow(docs, _scored(shipped, text, tell), docs.schema)
