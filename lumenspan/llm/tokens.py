"""Token ids in files of patched frame-of-reference blocks.

File layout, little-endian:

    magic 8 bytes
    blocks, each: least id u32, ids u16, exceptions u16, width u8, 3 bytes of padding,
        32 * width words u32 (ids less the least, their low ``width`` bits, in 32 lanes),
        exception places u16 each, exception high parts u32 each
    block starts u64 each (one more than blocks), document ids i64 each,
    first id of each document u64 each (one more than documents), null flags u8 each
    blocks u64, documents u64, ids u64, magic 8 bytes

A block holds 1,024 ids. Its width is the bits that ``PERCENTILE`` of its ids need after the least
id is subtracted; the others keep their high part in the exception lists. A reader finds any
document by the block starts without touching other blocks.
"""

from __future__ import annotations

import io
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lumenspan.llm import shared

MAGIC = b"PFORTOK1"
BLOCK, LANES, PERCENTILE = 1024, 32, 90
HEAD = np.dtype([("least", "<u4"), ("n", "<u2"), ("exceptions", "<u2"), ("width", "u1"), ("pad", "u1", 3)])
#: Blocks that a writer holds before it packs them, text taken at once, units a memo holds.
HELD_BLOCKS, SLICE_BYTES, MEMO = 256, 8 << 20, 1_000_000
#: A letter or digit and the punctuation behind it; no token of byte-level BPE has the two in this order.
WORD_END = r"([A-Za-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-/:-@\[-`{-~])"
#: White space other than space and line feed, and the mark that cuts units: a text with one is odd.
ODD = r"\x00-\x09\x0b-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray) -> list[bytes]:
    """Each block of ``ids`` (unsigned 32-bit), the last one possibly short, as bytes."""
    if not len(ids):
        return []
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.empty(n_blocks * BLOCK, np.uint32)
    padded[: len(ids)], padded[len(ids) :] = ids, ids[-1]
    table = padded.reshape(n_blocks, BLOCK)
    least = table.min(1)
    table = table - least[:, None]
    lengths = _bit_lengths(table)
    at = -(-BLOCK * PERCENTILE // 100) - 1
    width = np.partition(lengths, at, axis=1)[:, at]
    words: list[np.ndarray | None] = [None] * n_blocks
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        low = (table[own] & np.uint32((1 << w) - 1)).reshape(len(own), BLOCK // LANES, LANES)
        out = np.zeros((len(own), w, LANES), np.uint32)
        for i in range(BLOCK // LANES):
            word, shift = divmod(i * w, 32)
            if w:
                out[:, word] |= low[:, i] << np.uint32(shift)
            if shift + w > 32:
                out[:, word + 1] |= low[:, i] >> np.uint32(32 - shift)
        for k, x in zip(own.tolist(), out, strict=True):
            words[k] = x
    odd_block, odd_place = np.nonzero(lengths > width[:, None])
    high = (table[odd_block, odd_place].astype(np.uint64) >> width[odd_block].astype(np.uint64)).astype("<u4")
    cut = np.searchsorted(odd_block, np.arange(n_blocks + 1))
    head = np.zeros(n_blocks, HEAD)
    head["least"], head["n"], head["exceptions"], head["width"] = least, BLOCK, np.diff(cut), width
    head["n"][-1] = len(ids) - (n_blocks - 1) * BLOCK
    places = odd_place.astype("<u2")
    return [
        b"".join((head[k].tobytes(), words[k].astype("<u4").tobytes(), places[cut[k] : cut[k + 1]].tobytes(), high[cut[k] : cut[k + 1]].tobytes()))
        for k in range(n_blocks)
    ]


def unpack(data: memoryview, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` (the last entry is the end) in ``data``."""
    n_blocks = len(starts) - 1
    if n_blocks < 1:
        return np.zeros(0, np.uint32)
    head = np.concatenate([np.frombuffer(data, HEAD, 1, int(s)) for s in starts[:-1]])
    table = np.empty((n_blocks, BLOCK), np.uint32)
    width = head["width"].astype(np.int64)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        words = np.stack([np.frombuffer(data, "<u4", w * LANES, int(starts[k]) + HEAD.itemsize) for k in own]).reshape(len(own), w, LANES)
        out = np.zeros((len(own), BLOCK // LANES, LANES), np.uint32)
        mask = np.uint32((1 << w) - 1)
        for i in range(BLOCK // LANES if w else 0):
            word, shift = divmod(i * w, 32)
            value = words[:, word] >> np.uint32(shift)
            if shift + w > 32:
                value = value | words[:, word + 1] << np.uint32(32 - shift)
            out[:, i] = value & mask
        table[own] = out.reshape(len(own), BLOCK)
    for k in np.flatnonzero(head["exceptions"]).tolist():
        n, at = int(head["exceptions"][k]), int(starts[k]) + HEAD.itemsize + 4 * LANES * int(width[k])
        places = np.frombuffer(data, "<u2", n, at)
        table[k, places] |= np.frombuffer(data, "<u4", n, at + 2 * n) << np.uint32(width[k])
    table += head["least"][:, None]
    return table.ravel()[: (n_blocks - 1) * BLOCK + int(head["n"][-1])]


class Writer:
    """Writes one file; documents come one after another, in order."""

    def __init__(self, out: io.RawIOBase) -> None:
        self.out, self.at, self.starts = out, len(MAGIC), [len(MAGIC)]
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.doc_ids: list[int | None] = []
        self.begins = [0]
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        self.begins.append(self.n_ids)
        if self.n_held >= HELD_BLOCKS * BLOCK:
            self._put(self.n_held // BLOCK * BLOCK)

    def _put(self, n: int) -> None:
        ids = np.concatenate([np.zeros(0, np.uint32), *self.held])
        for block in pack(ids[:n]):
            self.out.write(block)
            self.at += len(block)
            self.starts.append(self.at)
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._put(self.n_held)
        null = np.array([d is None for d in self.doc_ids], "u1")
        self.out.write(np.array(self.starts, "<u8").tobytes())
        self.out.write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        self.out.write(np.array(self.begins, "<u8").tobytes() + null.tobytes())
        self.out.write(np.array([len(self.starts) - 1, len(null), self.n_ids], "<u8").tobytes() + MAGIC)
        self.out.close()


class Reader:
    """Reads one file, in whole or document by document."""

    def __init__(self, data: bytes) -> None:
        self.data = memoryview(data)
        tail = len(data) - len(MAGIC)
        if data[: len(MAGIC)] != MAGIC or data[tail:] != MAGIC:
            raise ValueError("not a token file")
        n_blocks, n_docs, self.n_ids = np.frombuffer(data, "<u8", 3, tail - 24).tolist()
        at = tail - 24 - n_docs - 8 * (2 * n_docs + 1) - 8 * (n_blocks + 1)
        self.starts = np.frombuffer(data, "<u8", n_blocks + 1, at)
        at += 8 * (n_blocks + 1)
        ids = np.frombuffer(data, "<i8", n_docs, at).tolist()
        self.begins = np.frombuffer(data, "<u8", n_docs + 1, at + 8 * n_docs).astype(np.int64)
        null = np.frombuffer(data, "u1", n_docs, tail - 24 - n_docs)
        self.doc_ids = [None if x else d for d, x in zip(ids, null.tolist(), strict=True)]

    def ids(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """Ids from ``first`` up to ``end``; only the blocks that hold them are unpacked."""
        end = self.n_ids if end is None else end
        if end <= first:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, -(-end // BLOCK)
        return unpack(self.data, self.starts[a : b + 1])[first - a * BLOCK : end - a * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.begins[k]), int(self.begins[k + 1]))

    def runs(self, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """All documents in order, unpacking about ``size`` ids at once."""
        k, n = 0, len(self.doc_ids)
        while k < n:
            to = max(k + 1, int(np.searchsorted(self.begins, self.begins[k] + size, "right")) - 1)
            base = int(self.begins[k])
            ids = self.ids(base, int(self.begins[to]))
            for d in range(k, to):
                yield d, ids[int(self.begins[d]) - base : int(self.begins[d + 1]) - base]
            k = to


class ByteLevelEncoder:
    """A byte-level BPE tokenizer of the ``tokenizers`` library that meets each unit once.

    Such a tokenizer never joins a word to what stands before the space or line feed in front of
    it, nor to the punctuation behind it. So a text whose white space is single spaces and line
    feeds between words is units such as " word", "," and line feed. The units of a slice of texts are numbered, its new ones encoded by the
    library in batches, and the ids put together by number. Any other text, and one that may hold
    a special token, is encoded by the library as a whole.
    """

    def __init__(self, path: str) -> None:
        # Tasks run one to a core already; the library's own threads would only wait for each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        special = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        odd = "|".join([r"^[ \n]", r"[ \n]\z", r"[ \n][ \n]", f"[{ODD}]", *special])
        #: What a text is encoded as a whole for; any text with a tokenizer of another kind.
        self.odd = odd if self._by_units() else ""

    def _by_units(self) -> bool:
        """Whether words are told apart as units are: no normaliser, byte level with its own pattern and without a space put before."""
        own = json.loads(self.library.to_str())
        model, cut = own["model"], own["pre_tokenizer"] or {}
        plain = own["normalizer"] is None and not own.get("truncation") and not own.get("padding")
        byte_level = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        return plain and byte_level and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")

    def _ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units one after another, and how many each has."""
        memo, library = self.memo, self.library
        parts = list(map(memo.get, units))
        new = [i for i, x in enumerate(parts) if x is None]
        if len(memo) + len(new) > MEMO:
            memo.clear()
        for at in range(0, len(new), 4096):
            places = new[at : at + 4096]
            for i, got in zip(places, library.encode_batch_fast([units[i] for i in places], add_special_tokens=False), strict=True):
                parts[i] = array("I", got.ids).tobytes()
                if len(units[i]) <= 64:
                    memo[units[i]] = parts[i]
        return np.frombuffer(b"".join(parts), np.uint32), np.fromiter(map(len, parts), np.int32, len(parts)) // 4

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many(pa.array([text], pa.string()))[0]

    def encode_many(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; none is null."""
        odd = pc.match_substring_regex(texts, self.odd)
        marked = pc.replace_substring(pc.replace_substring(texts, "\n", "\x01\n\x01"), " ", "\x01 ")
        marked = pc.replace_substring_regex(pc.if_else(odd, "", marked), WORD_END, r"\1" "\x01" r"\2")
        units = pc.split_pattern(marked, "\x01")
        numbered = units.flatten().dictionary_encode()
        ids, lengths = self._ids(numbered.dictionary.to_pylist())
        begins = np.cumsum(lengths, dtype=np.int32) - lengths
        number = numbered.indices.to_numpy()
        size = lengths[number]
        ends = np.cumsum(size, dtype=np.int32)
        place = np.repeat(begins[number] - ends + size, size)
        place += np.arange(len(place), dtype=np.int32)
        out = ids[place]
        bounds = np.concatenate([[0], ends])[units.offsets.to_numpy() - units.offsets[0].as_py()]
        found = [out[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            found[i] = np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return found


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store that a path of Spark's names, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` and write token files to ``folder`` in ascending ``id_col`` order.

    Gives the manifest, one row a file: ``part``, ``path``, ``n_docs``, ``n_ids``; files follow
    each other by ``part``. ``end_id`` ends each document; a null text is empty; null ids come
    first and keep their rows; ids are whole numbers. Rows of one id are ordered by a hash of their
    text. A task that is run again writes a file of another name, and only files in the manifest
    count.
    """
    ship = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = ship.withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, end = None, None, np.array([end_id], np.uint32)
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.pfor"
        for whole in _gathered(batches):
            for batch in shared.slices(whole, 1, SLICE_BYTES):
                if writer is None and batch.num_rows:
                    store, place = filesystem(path)
                    encoder, writer = _encoder(tokenizer), Writer(store.open_output_stream(place))
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_many(batch.column(1)), strict=True):
                    writer.add(doc_id, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.n_ids]})

    store, place = filesystem(folder)
    store.create_dir(place, recursive=True)
    return shared.cut(shared.arrow(ordered, run, "part long, path string, n_docs long, n_ids long"), "token-manifest")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together to about ``SLICE_BYTES``: the more text at once, the fewer units are new in it."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > SLICE_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


_encoders: dict[str, ByteLevelEncoder] = {}


def _encoder(path: str) -> ByteLevelEncoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = ByteLevelEncoder(path)
    return _encoders[path]


def read_tokens(manifest: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Documents of the files of a manifest: ``id_col``, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids_crc32`` (of the ids as little-endian u32), and ``ids`` where asked for.

    Documents come as they were written: null ids are null, an empty or null text has its end id only,
    repeated rows are repeated, a very long one is one row. An empty manifest gives no rows.
    """
    files = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = filesystem(path)
                with store.open_input_stream(place) as file:
                    reader = Reader(file.read())
                rows: dict[str, list] = {"id": [], "start": [], "n": [], "crc": [], "ids": []}
                size = 0
                for k, ids in reader.runs():
                    rows["id"].append(reader.doc_ids[k])
                    rows["start"].append(start + int(reader.begins[k]))
                    rows["n"].append(len(ids))
                    rows["crc"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                    if with_ids:
                        rows["ids"].append(ids.astype(np.int32))
                        size += len(ids)
                        if size > 1 << 20:
                            yield _rows(rows, with_ids, id_col)
                            rows, size = {c: [] for c in rows}, 0
                yield _rows(rows, with_ids, id_col)

    n = max(1, manifest.count())
    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return shared.arrow(files.select("path", "start").repartition(n, "path"), run, schema)


def _rows(rows: dict[str, list], with_ids: bool, id_col: str) -> pa.RecordBatch:
    columns = [pa.array(rows[c], pa.int64()) for c in ("id", "start", "n", "crc")]
    if with_ids:
        columns.append(pa.array(rows["ids"], pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(columns, [id_col, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])
