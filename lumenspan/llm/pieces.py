"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton over all pieces reads a text once. At each position its output links give every piece
that ends there, and each relaxes the best score of that position (Viterbi). A character that no
piece of its own covers may stand alone at a penalty, as its UTF-8 bytes where the model has byte
pieces. If no piece of the model has a space mark after another character, no piece crosses the
beginning of a word; then the words of a text are solved one by one, each at its first sight.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from lumenspan.llm import shared

MARK, PENALTY, MEMO, SLICE_BYTES = "▁", 10.0, 150_000, 1 << 20


class Pieces:
    """The vocabulary of a SentencePiece model, with its scores. Texts are not normalised."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.unknown = model.unk_id()
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.names) if model.is_byte(i)}
        plain = [i for i in range(len(self.names)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.names[i], (len(self.names[i]), model.get_score(i), i))
        self.automaton.make_automaton()
        self.alone = min((model.get_score(i) for i in plain), default=0.0) - PENALTY
        by_word = not any(re.search(f"[^{MARK}]{MARK}", self.names[i]) for i in plain)
        self.units = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if by_word else r"(?s).+").findall
        known = set(plain)
        self.text = [name.replace(MARK, " ") if i in known else " ⁇ " if i == self.unknown else "" for i, name in enumerate(self.names)]
        self.byte_of = np.full(len(self.names), -1, np.int16)
        for b, i in self.bytes.items():
            self.byte_of[i] = b
        self.memo: dict[str, bytes] = {}

    def best(self, unit: str) -> list[int]:
        """The segmentation of the highest score; of equal ones, that with the longer last piece."""
        n = len(unit)
        score, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
        score[0] = 0.0
        at = 0  # all positions up to here are final

        def stand_alone(to: int, single: bool) -> None:
            if not single and score[to - 1] + self.alone > score[to]:
                score[to], back[to] = score[to - 1] + self.alone, (to - 1, -1)

        single = False
        for end, (length, gain, piece) in self.automaton.iter(unit):
            end += 1
            while at < end - 1:
                at += 1
                stand_alone(at, single)
                single = False
            single |= length == 1
            now = score[end - length] + gain
            if now > score[end]:
                score[end], back[end] = now, (end - length, piece)
        while at < n:
            at += 1
            stand_alone(at, single)
            single = False
        ids: list[int] = []
        while n:
            start, piece = back[n]
            if piece >= 0:
                ids.append(piece)
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(unit[start:n].encode())]
            else:
                ids.append(self.unknown)
            n = start
        return ids[::-1]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; a space is put before it, as the model's trainer did."""
        if not text:
            return np.zeros(0, np.int32)
        memo, out = self.memo, []
        for unit in self.units(MARK + text.replace(" ", MARK)):
            ids = memo.get(unit)
            if ids is None:
                ids = np.array(self.best(unit), np.int32).tobytes()
                if len(memo) >= MEMO:
                    memo.clear()
                if len(unit) <= 64:
                    memo[unit] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids, less the space that ``encode`` puts before it."""
        text, own = self.text, self.byte_of[ids]
        if (own < 0).all():
            out = "".join([text[i] for i in ids.tolist()])
        else:
            parts = []
            edges = np.flatnonzero(np.diff(own < 0)) + 1
            for run, values in zip(np.split(ids, edges), np.split(own, edges), strict=True):
                parts.append(values.astype(np.uint8).tobytes().decode("utf-8", "replace") if values[0] >= 0 else "".join([text[i] for i in run.tolist()]))
            out = "".join(parts)
        return out.removeprefix(" ")


@lru_cache(1)
def load(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with an array of piece ids of each whole text in a new column.

    With ``decoded_col``, what the ids decode to is a further column, made in the same pass.
    A null text has null ids, an empty one none. Of equally good segmentations that with the longer
    last piece is taken. Very long texts are encoded whole. Rows, repeated or not, and columns stay as
    they are; columns of the names of new ones are replaced. An empty table gives no rows. The space
    mark U+2581 is a space to the model: it is encoded, but decodes to a space.
    """
    new = [ids_col, *([decoded_col] if decoded_col else [])]
    base = docs.select([c for c in docs.columns if c.lower() not in {n.lower() for n in new}])
    at = shared.place(base, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for whole in batches:
            for batch in shared.slices(whole, at, SLICE_BYTES):
                ids = [None if t is None else pieces.encode(t) for t in batch.column(at).to_pylist()]
                made = [pa.array(ids, pa.list_(pa.int32()))]
                if decoded_col:
                    made.append(pa.array([None if i is None else pieces.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *new])
        pieces.memo.clear()

    full = base.withColumn(ids_col, F.lit(None).cast("array<int>"))
    return shared.arrow(base, run, (full.withColumn(decoded_col, F.lit(None).cast("string")) if decoded_col else full).schema)


def decode(rows: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of an array of piece ids in a new column.

    Null ids have a null text, no ids the empty one; ids that the model doesn't have are an error. Very
    long arrays are decoded whole, repeated rows stay repeated, other columns are kept but for one of
    the new name, and an empty table gives no rows. The space mark U+2581 of a text is a space to the
    model, so a text that holds one comes back with a space in its place.
    """
    base = rows.select([c for c in rows.columns if c.lower() != text_col.lower()])
    at = shared.place(base, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                ids = part.column(at)
                texts = [pieces.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, text_col])

    return shared.arrow(base, run, base.withColumn(text_col, F.lit(None).cast("string")).schema)
