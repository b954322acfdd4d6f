"""SimHash near-duplicates through an inverted index on byte positions.

Two 64-bit fingerprints that differ in at most ``max_diff`` bits agree in at least
``8 - max_diff`` of their eight bytes. The index lists fingerprints under positional bytes. A
list for one byte holds 1/256 of all rows, so its pairs grow with the square of the input;
therefore a list is kept for each *triple* of positional bytes instead, from the smallest family
of triples of which every set of four positions contains one (20 triples). Within a list the
remaining positions have postings of their own: long lists are split by them, so only pairs that
share one more byte meet at all. The shared positional bytes of each pair that meets are tallied;
pairs that reach the guaranteed minimum are retained, and only these are verified by their bits.

A distance of 7 guarantees only one byte, whose lists would be too long; there the fingerprint is
cut into nine blocks, of which two agree, and lists are kept for each pair of blocks.

Texts whose shingles have a Jaccard similarity of 0.8 differ in about ten of 64 bits, too many for
such a guarantee. For them ``keep_one`` makes a longer SimHash of the same shingles, a *sketch* of
``SKETCH_BITS`` bits, with a list for each of its 16-bit blocks (two positional bytes). Of such a
pair a block agrees in one case of 14, one of the 32 blocks in nine cases of ten; at a similarity
of 0.85 it is 97 of 100. Pairs that meet and differ in at most ``SKETCH_DIFF`` of the bits are
verified by the similarity itself.

Only distinct fingerprints enter the index. Lists over ``LIST_ROWS`` are split into cells of two
blocks each, and a task gives back the spanning edges of what it has linked, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lumenspan.llm import shared
from lumenspan.llm.components import components, join_unique

#: Distinct fingerprints of one list that a task compares at most; longer lists are dealt in cells.
LIST_ROWS = 65_536
#: Text that is split into words at once.
CHUNK_BYTES = 4 << 20
#: Cells of a distance table that are held at once.
TABLE_CELLS = 1 << 20
#: Fingerprints of one group that a task verifies by their shingles at most; larger groups are dealt in cells.
GROUP_ROWS = 2_048
#: Bits of a sketch, bits of its blocks, and the share of bits that texts compared by their shingles may differ in.
SKETCH_BITS, SKETCH_BLOCK, SKETCH_DIFF = 512, 16, 0.25
#: Rows of ids and hashes that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_ROWS = 500_000
_MIX = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF for k in range(SKETCH_BITS // 64)], np.uint64)
_LOW7, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """The 64-bit fingerprint of a UTF-8 text over shingles of so many words; 0 without a word.

    A text of fewer words is one shingle. Long texts are taken in chunks that overlap by
    ``words - 1`` words, so memory does not grow with the text.
    """
    counts, total = np.zeros(64, np.int64), 0
    for digests in _digests(text, words):
        bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64)
        counts += bits.sum(0, dtype=np.int64)
        total += len(bits)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def _ones(h: np.ndarray) -> np.ndarray:
    """How many rows have each bit of 64-bit numbers."""
    bits = np.unpackbits(h.view(np.uint8)).reshape(len(h), -1)
    n = len(bits) // 255 * 255
    return bits[n:].sum(0, dtype=np.int64) + bits[:n].reshape(-1, 255, bits.shape[1]).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)


def with_sketch(text: bytes | None, words: int) -> tuple[int, np.ndarray]:
    """Fingerprint and sketch of a text: the sketch takes more hash bits of each shingle; zeros without a word."""
    counts, total = np.zeros(64 + SKETCH_BITS, np.int64), 0
    for digests in _digests(text, words):
        own = np.frombuffer(digests, ">u8").astype(np.uint64)[:, None]
        h = own * _MIX
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        counts += _ones(np.concatenate([own, h], 1).astype(">u8"))
        total += len(own)
    bits = np.packbits(2 * counts > total).view(">u8").astype(np.uint64)
    return int(bits[0]), bits[1:]


def shingles(text: bytes | None, words: int = 4) -> np.ndarray:
    """The distinct hashes of the shingles that ``fingerprint`` counts, in order."""
    parts = [np.unique(np.frombuffer(d, np.uint64)) for d in _digests(text, words)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; 0 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _digests(text: bytes | None, words: int) -> Iterator[bytes]:
    """Hashes of all shingles, 8 bytes each, by chunks of the text."""
    kept, began = [], False
    for chunk in _chunks(text or b""):
        run = kept + chunk
        if len(run) < words:
            kept = run
            continue
        began = True
        yield _hashes(run, words)
        kept = run[len(run) - words + 1 :]
    if not began and kept:
        yield _hashes(kept, len(kept))


def _chunks(text: bytes) -> Iterator[list[bytes]]:
    if len(text) <= CHUNK_BYTES:
        yield text.lower().split()
        return
    at, rest = 0, b""
    while at < len(text):
        piece = rest + text[at : at + CHUNK_BYTES].lower()
        at += CHUNK_BYTES
        found = piece.split()
        rest = b""
        if at < len(text) and found and not piece[-1:].isspace():
            rest = found.pop()
        yield found
    if rest:
        yield [rest]


def _hashes(words: list[bytes], k: int) -> bytes:
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths) + np.arange(len(words))
    begins = (ends - lengths)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], 42) for a, b in zip(begins, ends[k - 1 :].tolist(), strict=True)])


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 4, sketch: bool = False) -> DataFrame:
    """``docs`` with the column ``text_col`` replaced by ``fp long``, and ``sketch`` where asked for.

    A null text has no words. Very long texts are read in pieces; all other columns are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            columns, names = batch.columns[:-1], batch.schema.names[:-1]
            if sketch:
                both = [with_sketch(t, words) for t in texts]
                own, sketches = [f for f, _ in both], [x.view(np.int64) for _, x in both]
                columns, names = [*columns, pa.array(sketches, pa.list_(pa.int64()))], [*names, "sketch"]
            else:
                own = [fingerprint(t, words) for t in texts]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(own, np.uint64).view(np.int64))], [*names, "fp"])

    others = [c for c in docs.columns if c != text_col]
    more = [F.array(F.lit(0).cast("long")).alias("sketch")] if sketch else []
    schema = docs.select(*others, *more, F.lit(0).cast("long").alias("fp")).schema
    return shared.arrow(docs.select(*others, F.col(text_col).cast("string")), run, schema)


def triples(positions: int = 8) -> list[tuple[int, ...]]:
    """The fewest triples of positions such that any four positions contain one."""
    cuts = [range(i * positions // 3, (i + 1) * positions // 3) for i in range(3)]
    within = [t for g in cuts for t in combinations(g, 3)]
    across = [(*two, one) for i, g in enumerate(cuts) for two in combinations(g, 2) for one in cuts[(i + 1) % 3]]
    return sorted(tuple(sorted(t)) for t in within + across)


def families(max_diff: int) -> list[tuple[int, ...]]:
    """Sets of places in ``blocks``; two fingerprints within ``max_diff`` bits agree on one of them."""
    sure = 8 - max_diff
    if not 1 <= sure <= 8:
        raise ValueError("max_diff must be from 0 to 7")
    if sure == 1:
        return list(combinations(range(9), 2))
    return triples() if sure >= 4 else list(combinations(range(8), sure))


def blocks(max_diff: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each block: the eight bytes, or nine blocks where a byte is all that is sure."""
    return [(7 * i, 7) for i in range(8)] + [(56, 8)] if max_diff == 7 else [(56 - 8 * i, 8) for i in range(8)]


def tally(x: np.ndarray) -> np.ndarray:
    """Of exclusive-ors of fingerprints: in how many bytes the two agree."""
    return 8 - np.bitwise_count((((x & _LOW7) + _LOW7) | x) & _HIGH)


def verify(x: np.ndarray, max_diff: int) -> np.ndarray:
    return np.bitwise_count(x) <= max_diff


def linked(max_diff: int) -> Callable[[np.ndarray], np.ndarray]:
    """Of exclusive-ors (..., 1): which are links. Pairs whose tally is below the guaranteed minimum aren't looked at."""

    def tell(x: np.ndarray) -> np.ndarray:
        x = x[..., 0]
        retained = tally(x) >= 8 - max_diff
        out = retained.copy()
        out[retained] = verify(x[retained], max_diff)
        return out

    return tell


def _postings(own: np.ndarray, places: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Rows of a list that agree in ``places`` by each byte at each other position: those that share one more."""
    for i in range(8):
        if i not in places:
            byte = (own >> np.uint64(56 - 8 * i)) & np.uint64(0xFF)
            order = np.argsort(byte, kind="stable")
            yield from (p for p in np.split(order, np.flatnonzero(np.diff(byte[order])) + 1) if len(p) > 1)


def _spanning(f: np.ndarray, v: np.ndarray, tell: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Star edges of the components of one list: what is reached is not compared again."""
    left, seen = np.arange(1, len(f)), 0
    while seen >= 0:
        wave = np.array([seen])
        while len(wave) and len(left):
            step = max(1, TABLE_CELLS // (len(left) * v.shape[1]))
            part, wave = wave[:step], wave[step:]
            hit = tell(v[part][:, None] ^ v[left][None]).any(0)
            if hit.any():
                new, left = left[hit], left[~hit]
                wave = np.concatenate([wave, new])
                yield np.full(len(new), f[seen], f.dtype), f[new]
        seen, left = (int(left[0]), left[1:]) if len(left) else (-1, left)


def _short(run: np.ndarray, f: np.ndarray, v: np.ndarray, tell: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of all short lists at once: at a distance of 1, 2, ... in the order of lists."""
    at, lag = np.arange(len(f)), 1
    while True:
        at = at[at + lag < len(f)]
        at = at[run[at] == run[at + lag]]
        if not len(at):
            return
        for begin in range(0, len(at), TABLE_CELLS // v.shape[1]):
            part = at[begin : begin + TABLE_CELLS // v.shape[1]]
            ok = part[tell(v[part] ^ v[part + lag])]
            if len(ok):
                yield f[ok], f[ok + lag]
        lag += 1


class _Forest:
    """Spanning edges of what a task has linked so far."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)

    def edges(self) -> pa.RecordBatch:
        nodes = [x for x, y in self.up.items() if x != y]
        ends = np.array([[x, self.root(x)] for x in nodes], np.uint64).reshape(-1, 2).view(np.int64)
        self.up = {}
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])


def links(fps: DataFrame, max_diff: int = 4, list_rows: int = LIST_ROWS) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly what is linked among the distinct ``fp`` of ``fps``."""
    sets = families(max_diff)
    cuts = blocks(max_diff)
    block = lambda i: F.shiftrightunsigned("fp", cuts[i][0]).bitwiseAND(F.lit((1 << cuts[i][1]) - 1))

    def key(n: int, places: tuple[int, ...]):
        packed = F.lit(n).cast("long")
        for i in places:
            packed = F.shiftleft(packed, 8).bitwiseOR(block(i))
        return packed

    index = fps.select("fp", F.explode(F.array(*[key(n, p) for n, p in enumerate(sets)])).alias("key"))
    dealt = _dealt(index, list_rows).select("key", "fp", "cell")

    split = (lambda key, f: _postings(f, sets[key >> 24])) if 8 - max_diff == 4 else None
    run = _over_lists(linked(max_diff), split)
    sorted_lists = dealt.select("key", "cell", "fp", "fp").repartition("key", "cell").sortWithinPartitions("key", "cell")
    return shared.arrow(sorted_lists.toDF("key", "cell", "fp", "v"), run, "a long, b long")


def sketch_links(rows: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """Edges ``(a, b)`` among ``(fp, sketch)`` rows that connect those whose sketches agree in a block and differ little.

    Of a pair that shares a block, three other words of the sketches are compared.
    """
    each, count = 64 // SKETCH_BLOCK, SKETCH_BITS // 64

    def entry(i: int):
        word = i // each
        value = F.shiftrightunsigned(F.col("sketch")[word], SKETCH_BLOCK * (i % each)).bitwiseAND(F.lit((1 << SKETCH_BLOCK) - 1))
        others = [F.col("sketch")[(word + k) % count].alias(f"v{k}") for k in (1, 2, 3)]
        return F.struct(value.bitwiseOR(F.lit(i << SKETCH_BLOCK)).alias("key"), *others)

    index = rows.select("fp", F.explode(F.array(*[entry(i) for i in range(each * count)])).alias("e")).select("fp", "e.*")
    dealt = _dealt(index, list_rows).select("key", "cell", "fp", "v1", "v2", "v3").repartition("key", "cell").sortWithinPartitions("key", "cell")
    most = int(SKETCH_DIFF * 3 * 64)
    return shared.arrow(dealt, _over_lists(lambda x: np.bitwise_count(x).sum(-1, dtype=np.uint16) <= most, None), "a long, b long")


def _over_lists(tell, split):
    """A task over ``(key, cell, fp, values)`` rows in the order of lists: spanning edges of what is linked in each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, rest = _Forest(), None
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            rows = rows if rest is None else np.concatenate([rest, rows])
            if not len(rows):
                continue
            same = (rows[:, :2] == rows[-1, :2]).all(1)
            last = int(len(rows) - np.argmin(same[::-1])) if not same.all() else 0
            rest = rows[last:]
            _lists(rows[:last], tell, split, forest)
            if len(forest.up) > 1_000_000:
                yield forest.edges()
        if rest is not None:
            _lists(rest, tell, split, forest)
        yield forest.edges()

    return run


def _lists(rows: np.ndarray, tell, split, forest: _Forest) -> None:
    if len(rows) < 2:
        return
    change = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1
    begins = np.concatenate([[0], change])
    sizes = np.diff(np.concatenate([begins, [len(rows)]]))
    f, v = np.ascontiguousarray(rows[:, 2]).view(np.uint64), np.ascontiguousarray(rows[:, 3:]).view(np.uint64)
    run = np.repeat(np.arange(len(sizes)), sizes)
    small = np.repeat((sizes > 1) & (sizes <= 32), sizes)
    for a, b in _short(run[small], f[small], v[small], tell):
        forest.add(a, b)
    for i in np.flatnonzero(sizes > 32):
        own = slice(begins[i], begins[i] + sizes[i])
        for part in split(int(rows[begins[i], 0]), f[own]) if split else [np.arange(sizes[i])]:
            for a, b in _spanning(f[own][part], v[own][part], tell):
                forest.add(a, b)


def _dealt(index: DataFrame, most: int) -> DataFrame:
    """``index`` with a ``cell``: -1, or each cell of two blocks that a row of a list over ``most`` rows is in."""
    long = index.groupBy("key").count().where(F.col("count") > most)
    parts = F.ceil(F.col("count") / F.lit(most // 2)).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda j: F.shiftleft(F.least(own, j).cast("long"), 31).bitwiseOR(F.greatest(own, j).cast("long")),
    )
    cell = F.explode(F.when(F.col("count").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(cells)).alias("cell")
    return index.join(long, "key", "left").select(*index.columns, cell)


def _verified(rooted: DataFrame, rows: DataFrame, words: int, least: float, list_rows: int, group_rows: int) -> DataFrame:
    """Edges ``(a, b)`` between roots of ``(fp, sketch, first, root)`` rows some of whose members are alike.

    Alike are texts that ``sketch_links`` connects and whose shingles have a Jaccard similarity of
    ``least`` or more. The text of a row is that of its ``first`` among ``(id, key, text)`` rows;
    texts are read only of rows that a sketch links to another root.
    """
    wide = components(sketch_links(rooted.select("fp", "sketch"), list_rows)).toDF("fp", "key")
    grouped = rooted.join(wide, "fp")
    mixed = grouped.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    named = grouped.join(mixed, "key", "left_semi").select(
        F.col("key").alias("group"), "fp", "root", "sketch", F.col("first.id").alias("first"), F.col("first.key").alias("first_key")
    )
    suspects = shared.cut(named, "suspects")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words).tobytes() for t in batch.column(4).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.binary())], ["key", "fp", "root", "sketch", "shingles"])

    theirs = rows.join(_small(suspects), F.col("id").eqNullSafe(F.col("first")) & (F.col("key") == F.col("first_key")))
    # Rows that are equal in all give the same shingles; they are one row of the group only.
    sets = shared.arrow(
        theirs.select(F.col("group").alias("key"), "fp", "root", "sketch", F.col("text").cast("string")), hashed, "key long, fp long, root long, sketch array<long>, shingles binary"
    )
    dealt = _dealt(shared.cut(sets, "shingles"), group_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, now, group = _Forest(), None, []
        for batch in batches:
            for key, cell, fp, root, sketch, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, cell) != now:
                    _alike(group, least, forest)
                    now, group = (key, cell), []
                group.append((fp, root, sketch, np.frombuffer(own, np.uint64)))
        _alike(group, least, forest)
        yield forest.edges()

    ordered = dealt.select("key", "cell", "fp", "root", "sketch", "shingles").repartition("key", "cell").sortWithinPartitions("key", "cell")
    return shared.arrow(ordered, run, "a long, b long")


def _small(rows: DataFrame) -> DataFrame:
    """A written table of ids and hashes, to be broadcast if it has few rows."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _alike(group: list[tuple[int, int, list[int], np.ndarray]], least: float, forest: _Forest) -> None:
    """Link the roots of a group by their members; members of roots already linked aren't compared."""
    group = list({x[0]: x for x in group}.values())
    sketches = np.array([x[2] for x in group], np.int64).view(np.uint64).reshape(len(group), SKETCH_BITS // 64)
    unsigned = np.array([x[1] for x in group], np.int64).view(np.uint64)
    label = unsigned.copy()
    for i in range(len(group)):
        other = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        near = other[np.bitwise_count(sketches[other] ^ sketches[i]).sum(1, dtype=np.int64) <= SKETCH_DIFF * SKETCH_BITS]
        for j in near.tolist():
            if label[i] != label[j] and jaccard(group[i][3], group[j][3]) >= least:
                forest.add(unsigned[i : i + 1], unsigned[j : j + 1])
                label[label == label[j]] = label[i]


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_diff: int = 4, list_rows: int = LIST_ROWS
) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``fingerprint`` and ``component_id``.

    Rows whose fingerprints differ in at most ``max_diff`` bits are linked; ``component_id`` is
    the smallest id that links lead to, the row's own included. Null and empty texts, and texts
    of white space, have fingerprint zero and are linked like any other. A row with a null id
    keeps its row; it takes part in links but never names a component, so ``component_id`` is
    null where no row of the component has an id. Repeated rows stay repeated. An empty table
    gives an empty result. Other columns of ``docs`` are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    table = shared.cut(fingerprints(rows, "text", words), "fingerprints")
    by_fp = _named(table, max_diff, list_rows)
    return join_unique(table, by_fp, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _named(table: DataFrame, max_diff: int, list_rows: int) -> DataFrame:
    """``(fp, component_id, n)`` of the distinct fingerprints of ``(id, fp)`` rows; ``n`` is the number of rows."""
    least = table.groupBy("fp").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"))
    found = components(links(least.select("fp"), max_diff, list_rows))
    rooted = least.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least_id", "copies", F.coalesce("root", "fp").alias("root"))
    rooted = shared.cut(rooted, "roots")
    named = shared.cut(rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n")), "component-names")
    return shared.cut(join_unique(rooted, named, "root").select("fp", "component_id", F.col("copies").alias("n")), "named-fingerprints")


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    max_diff: int = 4,
    list_rows: int = LIST_ROWS,
    least: float | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """The rows of ``docs``, all columns, that stay if one of each group of near-duplicates does.

    Groups are those of ``near_duplicates``; the row with the smallest id stays (null ids come
    last, of equal ids the least hash of the whole row), and one of rows that are equal in all.
    With ``least``, texts that ``sketch_links`` connects link as well if the Jaccard similarity of
    their shingles is ``least`` or more. Null and empty texts are alike, very long ones are taken
    whole, columns may be of any type, and an empty table gives no rows. Texts aren't shuffled
    unless over ``BROADCAST_ROWS`` rows go.
    """
    key, near = shared.fresh(docs.columns, "row_key"), shared.fresh(docs.columns, "row_id")
    keyed = docs.withColumn(key, F.xxhash64(*[F.to_json(F.struct(F.col(c).alias("c"))) if _mapped(docs, c) else F.col(c) for c in docs.columns]))
    rows = keyed.select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.col(text_col).alias("text"))
    table = shared.cut(fingerprints(rows, "text", words, sketch=least is not None), "fingerprints")
    each = ["fp", *["sketch"] * (least is not None)]
    prints = table.groupBy(*each).agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("first"))
    found = components(links(prints.select("fp").distinct(), max_diff, list_rows))
    rooted = prints.join(found, F.col("fp") == F.col("node"), "left").select(*each, "first", F.coalesce("root", "fp").alias("root"))
    if least is not None:
        # Texts of one fingerprint may still have different sketches, so what is compared further are pairs of both.
        rooted = shared.cut(rooted.withColumn("fp", F.xxhash64("fp", "sketch")), "roots")
        more = components(_verified(rooted, rows, words, least, list_rows, group_rows)).toDF("node", "top")
        rooted = rooted.join(more, F.col("root") == F.col("node"), "left").select("first", F.coalesce("top", "root").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.id", "first.key", F.lit(True).alias("stays"))
    times = table.groupBy("id", "key").agg(F.count("*").alias("times"))
    told = times.join(first.toDF("first_id", "first_key", "stays"), F.col("id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")), "left")
    # What goes, and what stays but is there more than once: the only rows whose texts have to be told apart.
    marked = shared.cut(told.where(F.col("stays").isNull() | (F.col("times") > 1)).select("id", "key", "stays"), "near-copies")
    marks = _small(marked.toDF(near, f"{key}_of", f"{key}_stays"))
    same = F.col(id_col).eqNullSafe(F.col(near)) & (F.col(key) == F.col(f"{key}_of"))
    out = keyed.join(marks, same, "left_anti").select(docs.columns)
    repeated = marked.where("stays")
    if not repeated.isEmpty():
        again = _small(repeated.toDF(near, f"{key}_of", f"{key}_stays"))
        out = out.union(keyed.join(again, same, "left_semi").dropDuplicates([id_col, key]).select(docs.columns))
    return out


def _mapped(docs: DataFrame, column: str) -> bool:
    """Whether a column holds a map at any depth, which has no hash of its own."""
    return "map<" in docs.schema[column].dataType.simpleString()
