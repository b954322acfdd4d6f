"""Near-duplicate vectors by product quantisation over coarse inverted lists.

Vectors are scaled to length one. k-means on a bounded sample gives coarse centres; every vector
goes to the list of its nearest centre with codes of its residual in subspaces, and also asks the
lists it may have partners in: those whose border (the plane between two centres) is nearest to it,
up to ``probes``. In a list, table lookups give the distance of each asking vector to each
quantised one. The distance to the real vector differs from it by at most the error that was stored
with the codes, so a pair is given up only if that bound rules it out; the cosine of the rest is
computed in double precision. So only probing can miss a link.

How many lists are enough is known: of two vectors in different cells the distances to the border
add up to their distance at most, so one of the two lies within *half* the linking distance of the
border and asks the other's list. Lists beyond that half are never asked. ``probes=None`` asks all
lists within it and misses nothing, whatever the vectors are like.

Equal vectors are one entry of the index. A list with many rows is dealt in cells of one block of
entries by one block of askers. Tasks give back counts and spanning edges, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenspan.llm import shared
from lumenspan.llm.components import components, join_unique

#: Rows that centres and codebooks are fitted on, and bytes of them and of the centres, at most (twice so, at worst).
SAMPLE_ROWS, SAMPLE_BYTES, CENTRE_BYTES = 16_384, 64 << 20, 16 << 20
#: Index entries that a list should have, and lists at most.
LIST_ROWS, MOST_LISTS = 128, 4096
#: Entries or askers of a cell, and pairs whose distances are held at once.
CELL_ROWS, TABLE_CELLS = 8192, 1 << 19
SUBSPACES, CODES = 8, 256
#: Lists that a vector asks at most, its own among them.
PROBES = 16


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        order = np.argsort(own, kind="stable")
        used, begins = np.unique(own[order], return_index=True)
        centres[used] = np.add.reduceat(x[order], begins, axis=0) / np.diff([*begins, len(x)])[:, None]
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 22) // max(1, len(centres)))
    return np.concatenate([_squares(x[i : i + step], centres).argmin(1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


@dataclass
class Quantiser:
    """Coarse centres (lists, width) and codebooks (subspaces, codes, width of a subspace)."""

    centres: np.ndarray
    books: list[np.ndarray]
    probes: int | None
    margin: float

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, probes: int | None, margin: float) -> Quantiser:
        """From a sample of unit vectors, one row at least."""
        centres = _kmeans(sample, min(lists, len(sample)), 10, 1)
        left = sample - centres[_nearest(sample, centres)]
        books = [_kmeans(np.ascontiguousarray(part), min(CODES, len(part)), 6, 2) for part in np.array_split(left, min(SUBSPACES, sample.shape[1]), axis=1)]
        return cls(centres, books, probes, margin)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of unit vectors: list, codes, quantisation error, lists to ask (the own one among them)."""
        square = _squares(x, self.centres)
        home = square.argmin(1)
        apart = np.sqrt(np.maximum(_squares(self.centres[home], self.centres), 1e-30))
        border = (square - square[np.arange(len(x)), home][:, None]) / (2 * apart)
        border[np.arange(len(x)), home] = -1.0
        if self.probes is None or self.probes >= border.shape[1]:
            asked = [np.flatnonzero(row <= self.margin) for row in border]
        else:
            first = np.argpartition(border, self.probes - 1, axis=1)[:, : self.probes]
            asked = [np.sort(o[b]) for o, b in zip(first, np.take_along_axis(border, first, 1) <= self.margin, strict=True)]
        left = x - self.centres[home]
        codes, error, at = [], np.zeros(len(x)), 0
        for book in self.books:
            part = left[:, at : at + book.shape[1]]
            at += book.shape[1]
            square = _squares(part, book)
            codes.append(square.argmin(1))
            error += ((part - book[codes[-1]]) ** 2).sum(1)
        return home, np.stack(codes, 1).astype(np.uint8), np.sqrt(error), asked

    def lookups(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of vectors to the quantised entries of a list."""
        left, at, out = x - self.centres[cell], 0, np.zeros((len(x), len(codes)), np.float32)
        for m, book in enumerate(self.books):
            table = _squares(left[:, at : at + book.shape[1]], book).astype(np.float32)
            at += book.shape[1]
            out += table[:, codes[:, m]]
        return out


def _unit(raw: pa.Array, width: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw.to_pylist()), "<f8").reshape(-1, width)
    scaled = x / np.abs(x).max(1, keepdims=True)  # else squares of extreme numbers leave the range
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vec)``: components as little-endian doubles; null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = None if not v or None in v else np.array(v, "<f8") + 0.0
                out.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "vec"])

    kind = rows.schema[id_col].dataType.simpleString()
    return shared.arrow(rows.select(id_col, F.col(vector_col).cast("array<double>").alias("v")), run, f"id {kind}, vec binary")


class _Found:
    """Links of a task: counts by vector, and a forest of edges."""

    def __init__(self) -> None:
        self.counts: dict[int, int] = {}
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def add(self, a: np.ndarray, b: np.ndarray, more_a: np.ndarray, more_b: np.ndarray) -> None:
        """Pairs of vectors, and how many rows each stands for."""
        for ids, more in ((a, more_b), (b, more_a)):
            who, at = np.unique(ids, return_inverse=True)
            for x, n in zip(who.tolist(), np.bincount(at, more).tolist(), strict=True):
                self.counts[x] = self.counts.get(x, 0) + int(n)
        at, step = 0, 256
        while at < len(a):  # what earlier pairs have joined is told by roots, so a dense cluster costs its members, not its pairs
            ends = np.stack([a[at : at + step], b[at : at + step]], 1)
            who, place = np.unique(ends, return_inverse=True)
            roots = np.array([self.root(x) for x in who.tolist()], np.int64)[place.reshape(-1, 2)]
            for x, y in np.unique(roots[roots[:, 0] != roots[:, 1]], axis=0).tolist():
                p, q = self.root(x), self.root(y)
                if p != q:
                    self.up[max(p, q)] = min(p, q)
            at, step = at + step, 2 * step

    def rows(self) -> pa.RecordBatch:
        edges = [(x, self.root(x)) for x, y in self.up.items() if x != y]
        a, b = [*self.counts, *(x for x, _ in edges)], [*[None] * len(self.counts), *(y for _, y in edges)]
        n = [*self.counts.values(), *[0] * len(edges)]
        self.counts, self.up = {}, {}
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, n)], ["a", "b", "n"])


def _search(book: Quantiser, width: int, threshold: float, rows: pa.Table, found: _Found) -> None:
    """All links between askers and entries of one cell, each pair of vectors in one cell only."""
    cell = rows.column("list")[0].as_py()
    vid, home = rows.column("vid").to_numpy(), rows.column("home").to_numpy()
    copies = rows.column("copies").to_numpy()
    asks, entry = rows.column("asks").to_numpy(), rows.column("entry").to_numpy()
    x = _unit(rows.column("vec"), width)
    mine = np.flatnonzero(entry)
    if not len(mine):
        return
    codes = np.frombuffer(b"".join(rows.column("codes").take(pa.array(mine)).to_pylist()), np.uint8).reshape(len(mine), -1)
    reach = (np.sqrt(max(0.0, 2 - 2 * threshold)) + rows.column("error").to_numpy()[mine] + 1e-3) ** 2
    asked = {int(i): set(rows.column("asked")[int(i)].as_py()) for i in mine} if (home[asks] > cell).any() else {}
    askers = np.flatnonzero(asks)
    step = max(1, TABLE_CELLS // len(mine))
    for at in range(0, len(askers), step):
        part = askers[at : at + step]
        q, e = np.nonzero(book.lookups(x[part], cell, codes) <= reach)
        q, e = part[q], mine[e]
        once = (home[q] != cell) | (vid[q] < vid[e])
        q, e = q[once], e[once]
        for cut in range(0, len(q), 1 << 16):
            a, b = q[cut : cut + (1 << 16)], e[cut : cut + (1 << 16)]
            ok = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            a, b = a[ok], b[ok]
            later = home[a] > cell  # found from there too, where the entry asks that list
            if later.any():
                own = np.array([not (k and int(home[i]) in asked[int(j)]) for i, j, k in zip(a, b, later, strict=True)])
                a, b = a[own], b[own]
            found.add(vid[a], vid[b], copies[a], copies[b])


def near_duplicates(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    probes: int | None = PROBES,
    sample_rows: int = SAMPLE_ROWS,
    list_rows: int = LIST_ROWS,
    cell_rows: int = CELL_ROWS,
    all_widths: bool = False,
) -> DataFrame:
    """One row for each row: ``id_col``, ``n_links`` (other rows linked directly), ``component_id``
    (the smallest id that links lead to, the row's own included) and ``kept`` (it names its component).

    Links have a cosine of ``threshold`` or more in double precision; none below is given. Centres
    and codebooks are fitted on at most ``2 * sample_rows`` vectors; all are indexed and all ask.
    ``probes=None`` is exact: every list that can hold a partner is asked.

    Vectors that are null, empty or zero, or that hold null or non-finite components, link with
    nothing; so do vectors of another width than most have, unless ``all_widths`` gives each width
    an index of its own. A row with a null id keeps its row and
    counts as a link, but never names a component and is never kept. Repeated rows link with each
    other. An empty table gives no rows. Other columns aren't read.
    """
    spark = rows.sparkSession
    table = shared.cut(vectors(rows, id_col, vector_col), "vectors")
    widths = table.where("vec is not null").groupBy(F.length("vec").alias("w")).count().orderBy(F.desc("count"), "w")
    widths = [r.w for r in (widths if all_widths else widths.limit(1)).collect()]
    good = table.where(F.length("vec").isin(widths)) if widths else table.limit(0)
    distinct = good.groupBy("vec").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"))
    distinct = shared.cut(distinct.withColumn("vid", F.monotonically_increasing_id()), "distinct-vectors")
    numbers = {r.w: r["count"] for r in distinct.groupBy(F.length("vec").alias("w")).count().collect()}
    links = None
    for i, width in enumerate(widths):
        if i and numbers[width] < 2:
            continue
        own = distinct.where(F.length("vec") == width)
        new = _links(own, numbers[width], width // 8, threshold, probes, sample_rows, list_rows, cell_rows)
        links = links.union(new) if links else new
    if links is None:
        return table.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    found = components(links.where("b is not null"))
    counts = links.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    rooted = (
        distinct.join(found, F.col("vid") == F.col("node"), "left")
        .join(counts, F.col("vid") == F.col("a"), "left")
        .select("vec", "least_id", "copies", F.coalesce("root", "vid").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    rooted = shared.cut(rooted, "vector-roots")
    named = shared.cut(rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n")), "vector-components")
    by_vec = shared.cut(join_unique(rooted, named, "root").select("vec", "n_links", "component_id", F.col("copies").alias("n")), "vectors-by-component")
    indexed = F.col("vec").isNotNull() & F.length("vec").isin(widths)
    alone = table.where(~F.coalesce(indexed, F.lit(False))).select("vec", "id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast(table.schema["id"].dataType).alias("component_id"))
    linked = join_unique(table.where(indexed), by_vec, "vec").select("vec", "id", "n_links", "component_id").union(alone).withColumn("linked", F.col("n_links").isNotNull())
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id"))
    return linked.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _links(distinct, n, width, threshold, probes, sample_rows, list_rows, cell_rows) -> DataFrame:
    spark = distinct.sparkSession
    sample_rows = max(256, min(sample_rows, SAMPLE_BYTES // (8 * width)))
    every = -(-n // sample_rows)
    sample = distinct.where(F.pmod(F.xxhash64("vec"), F.lit(every)) == 0) if every > 1 else distinct
    drawn = [bytes(r.vec) for r in sample.select("vec").limit(2 * sample_rows).collect()] or [bytes(distinct.first().vec)]
    lists = int(min(MOST_LISTS, max(1, n // list_rows), max(16, CENTRE_BYTES // (8 * width))))
    margin = np.sqrt(max(0.0, 2 - 2 * threshold)) / 2 + 1e-6
    fitted = Quantiser.fit(_unit(pa.array(sorted(drawn), pa.binary()), width), lists, probes, margin)
    book = spark.sparkContext.broadcast(fitted)

    step = max(1, (1 << 20) // len(fitted.centres))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                home, codes, error, asked = book.value.assign(_unit(part.column("vec"), width))
                columns = [
                    part.column("vid"),
                    part.column("vec"),
                    part.column("copies"),
                    pa.array(home.astype(np.int32)),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(error),
                    pa.array([a.astype(np.int32) for a in asked], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vid", "vec", "copies", "home", "codes", "error", "asked"])

    schema = "vid long, vec binary, copies long, home int, codes binary, error double, asked array<int>"
    placed = shared.cut(shared.arrow(distinct.select("vid", "vec", "copies"), place, schema), "placed-vectors")
    entries = placed.groupBy(F.col("home").alias("list")).agg(F.count("*").alias("entries"))
    askers = placed.select(F.explode("asked").alias("list")).groupBy("list").agg(F.count("*").alias("askers"))
    blocks = askers.join(entries, "list").select(  # one row a list, MOST_LISTS at most
        "list", F.ceil(F.col("entries") / cell_rows).cast("int").alias("rows"), F.ceil(F.col("askers") / cell_rows).cast("int").alias("columns")
    )
    asking = placed.withColumn("list", F.explode("asked")).join(F.broadcast(blocks), "list")
    row, column = F.pmod(F.xxhash64("vid"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("vid", F.lit(1)), F.col("columns")).cast("int")
    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    in_row, in_column = lambda c: (c.i == F.col("row")) & (F.col("home") == F.col("list")), lambda c: c.j == F.col("column")
    dealt = (
        asking.withColumn("row", row)
        .withColumn("column", column)
        .withColumn("cell", F.explode(F.filter(cells, lambda c: in_row(c) | in_column(c))))
        .select(
            "list",
            F.col("cell.i").alias("i"),
            F.col("cell.j").alias("j"),
            "vid",
            "vec",
            "copies",
            "home",
            F.when(F.col("home") == F.col("list"), F.col("codes")).alias("codes"),
            "error",
            F.when(F.col("home") == F.col("list"), F.col("asked")).alias("asked"),
            (F.col("cell.j") == F.col("column")).alias("asks"),
            ((F.col("cell.i") == F.col("row")) & (F.col("home") == F.col("list"))).alias("entry"),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = _Found(), []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("list", "i", "j")], 1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and tuple(held[0].slice(0, 1).to_pylist()[0][c] for c in ("list", "i", "j")) != tuple(keys[a].tolist()):
                    _search(book.value, width, threshold, pa.Table.from_batches(held).combine_chunks(), found)
                    held = []
                held.append(batch.slice(a, b - a))
            if len(found.counts) > 1_000_000:
                yield found.rows()
        if held:
            _search(book.value, width, threshold, pa.Table.from_batches(held).combine_chunks(), found)
        yield found.rows()

    grouped = dealt.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")
    return shared.cut(shared.arrow(grouped, run, "a long, b long, n long"), "vector-links")
