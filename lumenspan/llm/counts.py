"""Token counts of byte-level BPE by rank-synchronous merging of ragged numpy arrays.

Texts are cut into pre-tokens by classes of their characters, for a slice of texts at once. Each
distinct pre-token is merged once: all that are new in a slice are one flat array of symbols, in
which every round finds each sequence's lowest-ranked pair and merges all its places in the
sequence at the same time, until no pair of a sequence has a rank. A count is the number of symbols
that survive.

All places at once is right if no pair that a merge makes ranks below the merge itself. That holds
for a vocabulary that was learned; where it doesn't, only the first place of each sequence is merged
in a round, which is the definition.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from lumenspan.llm import shared

#: Tokens that a text may have.
LIMIT = 1024
#: Bytes of texts taken at once, characters of a long text taken at once, symbols of a sequence that
#: is merged by itself, pre-tokens that a task remembers.
SLICE_BYTES, PIECE_CHARS, LONG, MEMO = 2 << 20, 1 << 20, 1024, 1_000_000
#: Classes of characters; ``END`` stands behind a text and for a special token.
LETTER, NUMBER, SPACE, OTHER, END = range(5)
_TEXT_END, _SPECIAL, _NO_RANK = "\ud800", "\ud801", np.iinfo(np.int32).max
#: Behind a character that isn't white space a pre-token begins with a space or line feed.
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85])[ \n]")


class Merger:
    """Counts of the tokens that the ``tokenizers`` library makes of texts with one byte-level BPE file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        own = json.loads(library.to_str())
        model, cut = own["model"], own["pre_tokenizer"] or {}
        added = own["added_tokens"]
        kind = model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        plain = own["normalizer"] is None and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
        if not (kind and plain) or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"not a byte-level BPE tokenizer that keeps texts as they are: {path}")
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.classes = _classes(library)
        self._ranks(model)
        self.memo: dict[str, int] = {}

    def _ranks(self, model: dict) -> None:
        """Ids of the 256 bytes, and the pairs in order with their rank and what they become."""
        vocab: dict[str, int] = model["vocab"]
        names = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        made = np.array([vocab[a + b] for a, b in names], np.int64)
        pairs = np.array([[vocab[a], vocab[b]] for a, b in names], np.int64).reshape(-1, 2)
        self.size = max(vocab.values()) + 1
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        self.made = made
        self.byte_ids = np.array([vocab[c] for c in _byte_names()], np.int64)
        last = np.full(self.size, -1, np.int64)  # the highest rank that makes a symbol
        np.maximum.at(last, made, np.arange(len(made)))
        self.at_once = bool((np.arange(len(made))[:, None] > last[pairs]).all())

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; ``_NO_RANK`` where there is none."""
        if not len(self.keys):
            return np.full(len(a), _NO_RANK, np.int32)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], _NO_RANK)

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; a null one has none."""
        total = np.zeros(len(texts), np.int64)
        held: list[str] = []
        owner: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            marked = self.special.sub(_SPECIAL, text or "") if self.special else text or ""
            for piece in _pieces(marked):
                held.append(piece)
                owner.append(i)
                size += len(piece)
                if size >= PIECE_CHARS:
                    np.add.at(total, owner, self._count(held))
                    held, owner, size = [], [], 0
        if held:
            np.add.at(total, owner, self._count(held))
        return total

    def _count(self, pieces: list[str]) -> np.ndarray:
        joined = _TEXT_END.join(pieces) + _TEXT_END
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.flatnonzero(self._begins(codes))
        width = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
        offsets = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        data = joined.encode("utf-8", "surrogatepass")
        bounds = offsets[np.append(starts, len(codes))].astype(np.int32)
        units = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        numbered = units.dictionary_encode()
        sizes = self._sizes(numbered.dictionary.to_pylist())[numbered.indices.to_numpy()]
        ends = codes[starts] == ord(_TEXT_END)
        piece = np.cumsum(ends) - ends
        return np.bincount(piece, np.where(ends, 0, sizes), len(pieces)).astype(np.int64)

    def _begins(self, codes: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin.

        A run of letters, of numbers or of other characters is one, with the space in front of it; of
        the white space before it the last character, if no space, is one, and the others are one.
        White space in front of an end is one as a whole. A lone apostrophe behind anything but a
        space takes the letters of a short form.
        """
        kind = self.classes[codes]
        before = np.concatenate([[END], kind[:-1]]).astype(np.int8)
        begins = (kind != before) | (kind == END)
        space = codes == 0x20
        after = np.append(begins[1:], True)  # the next character is of another run
        next_kind = np.append(kind[1:], END)
        # The last white space before a run that isn't an end begins anew, with the run if it is a space.
        last = (kind == SPACE) & after & (next_kind != END)
        begins |= last
        led = np.concatenate([[False], (last & space)[:-1]])
        begins &= ~led
        quote = np.flatnonzero((codes == 0x27) & after & begins)
        if len(quote):
            text = np.append(codes, [0, 0, 0])
            one, two = text[quote + 1], text[quote + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            begins[quote[short | pair] + 1] = False
            for places, n in ((quote[short], 2), (quote[pair], 3)):
                begins[places + n] |= kind[places + n] == LETTER
        return begins

    def _sizes(self, units: list[bytes]) -> np.ndarray:
        """Symbols that survive of each pre-token; a mark of an end or a special token counts one."""
        memo = self.memo
        sizes = list(map(memo.get, units))
        new = [i for i, x in enumerate(sizes) if x is None]
        if new:
            if len(memo) + len(new) > MEMO:
                memo.clear()
            for i, n in zip(new, self.merge([units[i] for i in new]).tolist(), strict=True):
                sizes[i] = n
                if len(units[i]) <= 64:
                    memo[units[i]] = n
        return np.array(sizes, np.int64)

    def merge(self, units: list[bytes]) -> np.ndarray:
        """Symbols that survive of each pre-token."""
        sizes = np.ones(len(units), np.int64)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        marks = {_TEXT_END.encode("utf-8", "surrogatepass"), _SPECIAL.encode("utf-8", "surrogatepass")}
        short = [i for i in np.flatnonzero((lengths > 1) & (lengths <= LONG)).tolist() if units[i] not in marks]
        for at in range(0, len(short), 1 << 17):
            own = np.array(short[at : at + (1 << 17)])
            flat = self.byte_ids[np.frombuffer(b"".join(units[i] for i in own), np.uint8)]
            self._rounds(flat, lengths[own], own, sizes)
        for i in np.flatnonzero(lengths > LONG).tolist():
            sizes[i] = self._long(self.byte_ids[np.frombuffer(units[i], np.uint8)])
        return sizes

    def _rounds(self, flat: np.ndarray, lengths: np.ndarray, names: np.ndarray, sizes: np.ndarray) -> None:
        """Merge sequences that lie one after another; what each has left goes to ``sizes`` by its name."""
        while len(flat):
            starts = np.cumsum(lengths) - lengths
            rank = np.append(self.ranks(flat[:-1], flat[1:]), _NO_RANK)
            rank[starts[1:] - 1] = _NO_RANK  # no pair across two sequences
            least = np.minimum.reduceat(rank, starts)
            active = least != _NO_RANK
            sizes[names[~active]] = lengths[~active]
            at = np.flatnonzero((rank == np.repeat(least, lengths)) & (rank != _NO_RANK))
            sequence = np.searchsorted(starts, at, "right") - 1
            taken = _apart(at, at + 1) if self.at_once else np.concatenate([[True], sequence[1:] != sequence[:-1]])[: len(at)]
            at, sequence = at[taken], sequence[taken]
            flat[at] = self.made[rank[at]]
            stays = np.repeat(active, lengths)
            stays[at + 1] = False
            flat = flat[stays]
            lengths = (lengths - np.bincount(sequence, minlength=len(lengths)))[active]
            names = names[active]

    def _long(self, symbols: np.ndarray) -> int:
        """What is left of one long sequence: places are kept by rank, so a round looks at its own only."""
        n = len(symbols)
        follows, leads = np.arange(1, n + 2), np.arange(-1, n)
        symbols = np.append(symbols, -1)  # an end that no pair holds
        rank = np.append(self._pair_ranks(symbols, np.arange(n), follows, n), _NO_RANK)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            of = rank[places]
            places, of = places[of != _NO_RANK], of[of != _NO_RANK]
            order = np.argsort(of, kind="stable")
            places, of = places[order], of[order]
            cuts = np.flatnonzero(np.diff(of)) + 1
            for group, r in zip(np.split(places, cuts), of[np.append(0, cuts)].tolist() if len(of) else [], strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(group)

        wait(np.arange(n))
        left = n
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            again = at
            at = at[_apart(at, follows[at])] if self.at_once else at[:1]
            gone = follows[at]
            symbols[at] = self.made[r]
            rank[gone] = _NO_RANK
            follows[at] = follows[gone]
            leads[follows[at]] = at
            left -= len(at)
            changed = np.unique(np.concatenate([at, leads[at][leads[at] >= 0]]))
            rank[changed] = self._pair_ranks(symbols, changed, follows, n)
            wait(changed if self.at_once else np.union1d(changed, again[rank[again] == r]))
        return left

    def _pair_ranks(self, symbols: np.ndarray, at: np.ndarray, follows: np.ndarray, n: int) -> np.ndarray:
        right = follows[at]
        return np.where(right < n, self.ranks(symbols[at], symbols[np.minimum(right, n)]), _NO_RANK)


def _apart(at: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of places in order, every second of a run in which each pair's right symbol is the next pair's left one."""
    if not len(at):
        return np.zeros(0, bool)
    begins = np.concatenate([[True], at[1:] != right[:-1]])
    first = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
    return (np.arange(len(at)) - first) % 2 == 0


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of about ``PIECE_CHARS`` that begin where a pre-token does."""
    at = 0
    while len(text) - at > PIECE_CHARS and (found := _CUT.search(text, at + PIECE_CHARS)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def _byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next from 256 on."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    unseen = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + unseen.index(b)) for b in range(256)]


def _classes(library) -> np.ndarray:
    """The class of every code point, as the library has it.

    Its version of Unicode may differ from that of ``regex``: letters and numbers that Python's own
    tables don't have yet are asked for.
    """
    table = np.full(0x110000, OTHER, np.int8)
    table[0xD800:0xE000] = END
    alone = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    everything = "".join(alone)
    for kind, name in ((LETTER, "L"), (NUMBER, "N"), (SPACE, "White_Space")):
        for run in regex.finditer(rf"\p{{{name}}}+", everything):
            a, b = ord(everything[run.start()]), ord(everything[run.end() - 1])
            own = table[a : b + 1]
            own[own == OTHER] = kind
    newer = [c for c in np.flatnonzero((table == LETTER) | (table == NUMBER)).tolist() if unicodedata.category(chr(c)) == "Cn"]
    for kind, lead in ((LETTER, "a"), (NUMBER, "1")):
        asked = [c for c in newer if table[c] == kind]
        begins = {at for _, (at, _) in library.pre_tokenizer.pre_tokenize_str("".join(f"{lead}{chr(c)}\n" for c in asked))}
        for i, c in enumerate(asked):
            if 3 * i + 1 in begins:
                table[c] = OTHER
    return table


_mergers: dict[str, Merger] = {}


def load(path: str) -> Merger:
    if path not in _mergers:
        _mergers.clear()
        _mergers[path] = Merger(path)
    return _mergers[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every row, with the id under its own name.

    Counts are those of the ``tokenizers`` library for the byte-level BPE file at ``tokenizer`` (else
    ``ValueError``), without tokens that it adds around a text; strings of special tokens inside a text
    are those tokens. ``over_limit`` tells more than ``limit`` tokens. A null text is empty and has
    none; null and repeated ids keep their rows; very long texts are counted whole, in pieces that
    begin with a pre-token; further columns aren't read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in shared.slices(whole, 1, SLICE_BYTES):
                texts = batch.column(1)
                counts = pa.array(load(tokenizer).count(texts.to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), counts], names=["id", "n_bytes", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    counted = shared.arrow(rows, run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
