"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is some megabytes of whole documents. Its words become numbers, and a suffix array holds
all its suffixes in order (prefix doubling; only suffixes that still tie are sorted again). Every
suffix of the benchmark is searched in it by binary search, one word deeper at a time, until no
training text goes on with it: that gives its longest verbatim match and where it lies. On the way,
at the depth of a window, the bounds of the search give all places of that window, which mark the
words that are hit. Matches of windows are extended in both directions, so each item has the longest
match with each document, never joined with that of another item.

The benchmark is a stated query set. Executors turn it into blocks of at most about ``BLOCK_BYTES`` of
text, written as arrays to the shared folder, and read them where documents are scanned; the driver
holds the names of the files. Documents are never moved between tasks.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenspan.llm import shared
from lumenspan.llm.tokens import filesystem

#: Text of a shard, and of a benchmark block; text that is split into words at once.
SHARD_BYTES, BLOCK_BYTES, CHUNK_BYTES = 16 << 20, 32 << 20, 4 << 20
#: Pairs of a benchmark place and a training place that are held at once.
PAIRS = 1 << 21
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, A-Z lower-cased: runs of digits, letters a-z and all beyond ASCII."""
    text = text or b""
    if len(text) <= CHUNK_BYTES:
        yield text.translate(_FOLD).split()
        return
    rest = b""
    for at in range(0, len(text), CHUNK_BYTES):
        piece = rest + text[at : at + CHUNK_BYTES].translate(_FOLD)
        found = piece.split()
        rest = found.pop() if found and piece[-1:] != b" " else b""
        yield found
    yield [rest] if rest else []


class _Numbers:
    """Words as numbers, in the order in which they first come."""

    def __init__(self) -> None:
        self.table: defaultdict[bytes, int] = defaultdict()
        self.table.default_factory = self.table.__len__

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All words of some texts, each text with -1 behind it; how many words each has."""
        get, runs, lengths = self.table.__getitem__, [], []
        gap = np.array([-1], np.int32)
        for text in texts:
            n = 0
            for run in words_of(text):
                runs.append(np.fromiter(map(get, run), np.int32, len(run)))
                n += len(run)
            runs.append(gap)
            lengths.append(n)
        return np.concatenate(runs or [gap[:0]]), np.array(lengths, np.int64)


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Begins of all suffixes in order. Gaps (-1) come before words and differ, the first being the least; the last word must be one."""
    n = len(words)
    gaps = np.flatnonzero(words < 0)
    rank = words.astype(np.int64) + len(gaps)
    rank[gaps] = np.arange(len(gaps))
    order, depth = np.arange(n), 1
    slots = np.arange(n)
    while len(slots):
        suffix = order[slots]
        key = (rank[suffix] << 32) | rank[np.minimum(suffix + depth, n - 1)]
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[slots] = suffix
        new = np.concatenate([[True], key[1:] != key[:-1]])
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        rank[suffix] = slots[starts][group]  # from the first round on ranks are places in the order
        tied = np.diff(np.concatenate([starts, [len(slots)]]))[group] > 1
        slots, depth = slots[tied], depth * 2
    return order.astype(np.int32)


class Shard:
    """Some documents with the suffix array of their words."""

    def __init__(self, texts: list[bytes | None]) -> None:
        numbers = _Numbers()
        self.words, self.n_words = numbers.of(texts)
        self.vocabulary = numbers.table
        self.vocabulary.default_factory = None
        self.begins = np.cumsum([0, *(self.n_words[:-1] + 1)])[: len(texts)]
        self.order = suffix_array(self.words)
        counts = np.bincount(self.words[self.words >= 0], minlength=len(self.vocabulary))
        self.first = len(texts) + np.concatenate([[0], np.cumsum(counts)])  # where suffixes with each first word begin

    def narrow(self, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ranges of suffixes that agree in ``depth`` words, the parts that go on with a word."""
        one, many = np.flatnonzero(high - low == 1), np.flatnonzero(high - low > 1)
        low, high = low.copy(), high.copy()
        high[one] -= self.words[self.order[low[one]] + depth] != word[one]
        first = self._bound(low[many], high[many], depth, word[many], np.less)
        high[many] = self._bound(first, high[many], depth, word[many], np.less_equal)
        low[many] = first
        return low, high

    def _bound(self, a: np.ndarray, b: np.ndarray, depth: int, word: np.ndarray, before: np.ufunc) -> np.ndarray:
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            suffix = self.order[np.where(open_, mid, 0)]  # closed ranges look at the first, which is a gap
            later = before(self.words[np.where(open_, suffix + depth, 0)], word) & open_
            a, b = np.where(later, mid + 1, a), np.where(open_ & ~later, mid, b)
        return a


class Block:
    """Benchmark items as numbers of their words."""

    def __init__(self, ids: list[str], words: list[bytes], codes: np.ndarray, item: np.ndarray, lengths: np.ndarray) -> None:
        self.ids, self.words, self.codes, self.item, self.lengths = ids, words, codes, item, lengths
        self.begins = np.cumsum(np.concatenate([[0], lengths[:-1] + 1]))[: len(lengths)]

    @classmethod
    def of(cls, items: list[tuple[object, bytes | None]]) -> Block:
        named = sorted(("" if i is None else str(i), text or b"") for i, text in items)
        ids = sorted({i for i, _ in named})
        place = {i: n for n, i in enumerate(ids)}
        numbers = _Numbers()
        codes, lengths = numbers.of([text for _, text in named])
        return cls(ids, list(numbers.table), codes, np.array([place[i] for i, _ in named], np.int64), lengths)

    def dump(self) -> bytes:
        out = io.BytesIO()
        text = lambda x: np.frombuffer(x, np.uint8)
        np.savez(out, ids=text(json.dumps(self.ids).encode()), words=text(b" ".join(self.words)), codes=self.codes, item=self.item, lengths=self.lengths)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Block:
        with np.load(io.BytesIO(data)) as z:
            words = z["words"].tobytes()
            return cls(json.loads(z["ids"].tobytes()), words.split(b" ") if words else [], z["codes"], z["item"], z["lengths"])


@lru_cache(1)
def _loaded(path: str) -> Block:
    store, place = filesystem(path)
    with store.open_input_stream(place, compression=None) as file:
        return Block.load(file.read())


class Search:
    """All suffixes of a block in a shard: how far each matches, where, and the places of each window."""

    def __init__(self, shard: Shard, block: Block, size: int) -> None:
        self.shard, self.block, self.size = shard, block, size
        get = shard.vocabulary.get
        known = np.array([get(w, -1) for w in block.words] + [-1], np.int32)
        test = self.test = known[block.codes]
        row = np.repeat(np.arange(len(block.lengths)), block.lengths + 1)
        n = np.arange(len(test)) - block.begins[row]
        window = np.minimum(block.lengths[row], size)
        is_window = (n + window <= block.lengths[row]) & (window > 0)
        self.row, self.window = row, np.where(is_window, window, 0)
        #: Words of the longest match of each suffix, and where it is; first and end of the places of each window.
        self.longest, self.at = np.zeros(len(test), np.int64), np.zeros(len(test), np.int64)
        self.low, self.high = np.zeros(len(test), np.int64), np.zeros(len(test), np.int64)
        active = np.flatnonzero(test >= 0)
        low, high = shard.first[test[active]], shard.first[test[active] + 1]
        depth = 1
        while len(active):
            self.longest[active], self.at[active] = depth, shard.order[low]
            full = self.window[active] == depth
            self.low[active[full]], self.high[active[full]] = low[full], high[full]
            word = test[active + depth]
            more = word >= 0
            active, low, high, word = active[more], low[more], high[more], word[more]
            low, high = shard.narrow(low, high, depth, word)
            found = low < high
            active, low, high, depth = active[found], low[found], high[found], depth + 1

    def hit(self) -> np.ndarray:
        """Which words of the shard lie in an occurrence of a window."""
        some = np.flatnonzero(self.high > self.low)
        _, one = np.unique(np.stack([self.low[some], self.window[some]], 1), axis=0, return_index=True)
        some = some[one]
        count = self.high[some] - self.low[some]
        edge = np.zeros(len(self.shard.words) + 1, np.int64)
        at = self.shard.order[_within(self.low[some], count)]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + np.repeat(self.window[some], count), -1)
        return np.cumsum(edge[:-1]) > 0

    def matches(self) -> np.ndarray:
        """(document, item, words, place in the document, place in the row) of the longest match of each document and item."""
        some = np.flatnonzero(self.high > self.low)
        best = np.zeros((0, 5), np.int64)
        ends = np.cumsum(self.high[some] - self.low[some])
        begin = 0
        while begin < len(some):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
            for q, p in self._pairs(some[begin:end]):
                best = self._best(np.concatenate([best, self._extended(q, p)]))
            begin = end
        return best

    def _pairs(self, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of windows in the block and the shard where the words before differ."""
        words, test = self.shard.words, self.test
        count = self.high[part] - self.low[part]
        total = int(count.sum())
        for at in range(0, total, PAIRS):  # more than one step only for a single window with very many places
            a, b = at, min(total, at + PAIRS)
            if total <= PAIRS:
                q, p = np.repeat(part, count), self.shard.order[_within(self.low[part], count)]
            else:
                q, p = np.repeat(part, b - a), self.shard.order[self.low[part[0]] + a : self.low[part[0]] + b]
            p = p.astype(np.int64)
            first = (q == 0) | (p == 0) | (test[q - 1] < 0) | (test[q - 1] != words[p - 1])
            yield q[first], p[first]

    def _extended(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        words, test = self.shard.words, self.test
        length = self.window[q].copy()
        active = np.arange(len(q))
        while len(active):
            w = test[q[active] + length[active]]
            active = active[(w >= 0) & (w == words[p[active] + length[active]])]
            length[active] += 1
        doc = np.searchsorted(self.shard.begins, p, "right") - 1
        row = self.row[q]
        return np.stack([doc, self.block.item[row], length, p - self.shard.begins[doc], q - self.block.begins[row]], 1)

    @staticmethod
    def _best(rows: np.ndarray) -> np.ndarray:
        """The longest of each document and item, of equals the first in the document and then in the item."""
        rows = rows[np.lexsort((rows[:, 4], rows[:, 3], -rows[:, 2], rows[:, 1], rows[:, 0]))]
        return rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])] if len(rows) else rows


def _within(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


class Matches:
    """What all blocks match in some documents."""

    def __init__(self, texts: list[bytes | None], blocks: Iterator[Block], size: int = 13) -> None:
        shard = Shard(texts)
        #: Of each document, by item: (words, place in the document, place in the item) of the longest match.
        self.items: list[dict[str, tuple[int, int, int]]] = [{} for _ in texts]
        hit = np.zeros(len(shard.words), bool)
        for block in blocks:
            search = Search(shard, block, size)
            hit |= search.hit()
            for doc, item, n, at, start in search.matches().tolist():
                self.items[doc][block.ids[item]] = (n, at, start)
        total = np.concatenate([[0], np.cumsum(hit)])
        self.n_words = shard.n_words
        self.n_hit = total[shard.begins + shard.n_words] - total[shard.begins]
        self.contaminated = (self.n_hit > 0) & (20 * self.n_hit >= self.n_words)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[str]:
    """Files of the benchmark's blocks; rows that share an id are in one."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    n = -(-total // block_bytes) or 1
    n = n if n == 1 else 2 * n
    folder = shared.scratch(benchmark.sparkSession, "benchmark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list] = {}
        for batch in batches:
            for part, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.setdefault(part, []).append((i, text))
        for part in sorted(rows):
            path = f"{folder}/{part}-{uuid.uuid4().hex}.npz"
            store, place = filesystem(path)
            store.create_dir(place.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(place, compression=None) as file:
                file.write(Block.of(rows.pop(part)).dump())
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path]})

    dealt = items.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("part"), "id", "text").repartition(n, "part")
    found = shared.cut(shared.arrow(dealt, run, "part int, path string"), "benchmark-blocks").orderBy("part").collect()  # n rows
    return [r.path for r in found]


def _scan(blocks: list[str], column: int, size: int, tell: Callable[[pa.RecordBatch, Matches, int], pa.RecordBatch]):
    """Rows in shards; ``tell`` gets a batch, the matches of its shard and which of them is its first."""

    def matched(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for b in held for t in b.column(column).cast(pa.binary()).to_pylist()]
        found, at = Matches(texts, map(_loaded, blocks), size), 0
        for batch in held:
            yield tell(batch, found, at)
            at += batch.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held = [], 0
        for batch in chain.from_iterable(shared.slices(whole, column, SHARD_BYTES) for whole in batches):
            own = int(batch.column(column).nbytes)
            if held and size_held + own > SHARD_BYTES:
                yield from matched(held)
                held, size_held = [], 0
            held.append(batch)
            size_held += own
        if held:
            yield from matched(held)

    return run


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each row of ``docs``, with what the benchmark matches in it.

    ``n_words``; ``n_hit``, the words within any matched window; ``items``, the ids (as strings,
    sorted) of items with a matched window; ``matches``, of each of these, in the same order, the
    longest verbatim match with the document: its words, and the word at which it begins in the
    document and in the item's text (of equals the first); ``longest``, the words of the longest;
    ``contaminated``: at least one word in twenty is hit.

    A null or empty text has no words. Very long texts are a shard of their own. A benchmark row with
    null or no words matches nothing, one with a null id counts as the item "", rows that share an id
    are one item of several texts. Repeated rows of ``docs`` stay repeated. Empty tables give no rows,
    or rows without hits. Other columns aren't read.
    """
    kinds = pa.list_(pa.struct([("item", pa.string()), ("n_words", pa.int64()), ("start", pa.int64()), ("item_start", pa.int64())]))

    def tell(batch: pa.RecordBatch, m: Matches, at: int) -> pa.RecordBatch:
        part = slice(at, at + batch.num_rows)
        own = [sorted(m.items[i].items()) for i in range(at, at + batch.num_rows)]
        longest = [[{"item": i, "n_words": n, "start": a, "item_start": b} for i, (n, a, b) in x] for x in own]
        columns = [
            batch.column(0),
            pa.array(m.n_words[part]),
            pa.array(m.n_hit[part].astype(np.int64)),
            pa.array([[i for i, _ in x] for x in own], pa.list_(pa.string())),
            pa.array(longest, kinds),
            pa.array([max((y["n_words"] for y in x), default=0) for x in longest], pa.int64()),
            pa.array(m.contaminated[part]),
        ]
        return pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "n_hit", "items", "matches", "longest", "contaminated"])

    kind = docs.schema[id_col].dataType.simpleString()
    return shared.arrow(
        docs.select(id_col, F.col(text_col).cast("string").alias("text")),
        _scan(_blocks(benchmark, item_col, item_text_col, block_bytes), 1, window, tell),
        f"`{id_col}` {kind}, n_words long, n_hit long, items array<string>, "
        "matches array<struct<item: string, n_words: long, start: long, item_start: long>>, longest long, contaminated boolean",
    )


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", **options) -> DataFrame:
    """``(item, n_words, doc, start, item_start)``: of each item with a matched window its longest verbatim match
    in all documents, of equals that of the least document and place. Null ids of documents come first; nulls,
    repeated rows and empty tables are as in ``contamination``.
    """
    found = contamination(docs, benchmark, id_col, item_col=item_col, **options)
    each = found.select(F.col(id_col).alias("doc"), F.explode("matches").alias("m"))
    best = F.min(F.struct((-F.col("m.n_words")).alias("less"), "doc", "m.start", "m.item_start")).alias("best")
    return each.groupBy(F.col("m.item").alias("item")).agg(best).select("item", (-F.col("best.less")).alias("n_words"), "best.doc", "best.start", "best.item_start")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't contaminated (see ``contamination``).

    Null and empty texts stay, and so does every row if the benchmark is empty. Repeated rows share
    their fate. Very long texts are searched whole. An empty table gives no rows.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    tell = lambda batch, m, at: batch.filter(pa.array(~m.contaminated[at : at + batch.num_rows]))
    return shared.arrow(docs, _scan(blocks, shared.place(docs, text_col), window, tell), docs.schema)


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
