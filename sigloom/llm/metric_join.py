"""Exact near-duplicates among embeddings: a range join in the metric of chords between unit vectors.

A cosine of ``least`` or more is a chord of ``reach`` = sqrt(2 - 2 least) or less. Pivots, a bounded sample of the vectors, cut space into
cells: a vector is at home with its nearest pivot. By the triangle inequality a vector within reach of one that is at home in cell j lies
at most ``reach`` beyond the cell's radius from pivot j, and at most 2 ``reach`` further from it than from its own pivot; where both
hold the vector is copied to the cell (of two cells one copies to the other, so a pair meets once). Cells then join independently.

The inequality also decides pairs that are never compared: all vectors within half the reach of a pivot, a cell's core, are linked
with each other, so a large group of near copies costs a count and not its square. A core is not copied: what is linked with it lies within
1.5 ``reach`` of its pivot and comes to it. Equal vectors are one row with a multiplicity from the start.
What is left of a cell is cut into tiles of at most about ``HELD`` components that others pass by in batches; a task holds one
slice and one batch, whatever the cell's size. Within a tile a float32 product finds candidates with a margin and each is verified in double precision.

No pair leaves a task: a tile gives each vector's number of links, and a forest that spans its links, for the components.

Where vectors are spread evenly over many dimensions no pivot tells them apart: each cell is near all others and the join compares
all pairs, as any exact method does there; it then still is a join in blocks, with a copy of each vector for every second cell.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link with nothing.
Vectors of different length are compared as if filled up with zeros. Every row is a vector, also where rows share
an id: repeated rows link with each other. A row without links is its own component; one without an id has none and is kept.
Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, simhash

LEAST = 0.95
#: Distinct vectors of a cell on average, until there are PIVOTS cells; vectors of a sample that pivots are taken from.
CELL, PIVOTS, SAMPLE = 4_096, 256, 4_096
#: Components of the vectors that a task holds of a cell; vectors that pass one slice in one task; and of those, vectors of a batch.
HELD, PASSING, BATCH = 1 << 20, 131_072, 1_024
#: Slack of bounds on distances, and of the float32 product.
SLACK, MARGIN = 1e-6, 1e-4


def matrix(vectors: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Arrow lists of numbers as unit vectors in double precision, filled up with zeros to ``width`` at least."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False).astype(float), vectors.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(starts, sizes)] = flat
    out /= np.abs(out).max(axis=1, keepdims=True, initial=1e-320)  # so that squares neither overflow nor vanish
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def widen(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.hstack([m, np.zeros((len(m), width - m.shape[1]))])


@dataclass
class Space:
    """The pivots, and what is known of their cells."""

    pivots: np.ndarray
    reach: float
    radius: np.ndarray | None = None
    #: Slices of each cell's core and of its other vectors, and parts of those that pass.
    cores: np.ndarray | None = None
    slices: np.ndarray | None = None
    parts: np.ndarray | None = None
    #: Vectors of a slice.
    held: int = 1

    def distances(self, vectors: pa.Array) -> np.ndarray:
        m = matrix(vectors, self.pivots.shape[1])
        return np.sqrt(np.maximum(0.0, 2 - 2 * m @ widen(self.pivots, m.shape[1]).T))

    def home(self, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(vectors)
        near = d.argmin(axis=1)
        return near.astype(np.int32), d[np.arange(len(d)), near]

    def visits(self, vectors: pa.Array, homes: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, cell, whether to its core, whether to its other vectors) for each cell that a vector is sent to; its own is one if it isn't of the core."""
        d = self.distances(vectors)
        home, core, cells = homes[:, None], core[:, None], np.arange(d.shape[1])
        one_way, at_home = (home < cells) == ((home + cells) % 2 == 0), home == cells
        own = d[np.arange(len(d)), homes][:, None]
        to_core = (d <= 1.5 * self.reach + SLACK) & (self.cores > 0) & (~core | (one_way & ~at_home))
        to_rest = ~core & (at_home | (one_way & (d <= own + 2 * self.reach + SLACK) & (d <= self.radius + self.reach + SLACK)))
        rows, cells = np.nonzero(to_core | to_rest)
        return rows, cells, to_core[rows, cells], to_rest[rows, cells]


def choose_pivots(reps: DataFrame, reach: float, most: int) -> np.ndarray:
    """Up to ``most`` pivots, from a sample of SAMPLE vectors by a hash; none within half the reach of another, so a group of near copies takes one."""
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vec").toArrow()
    m = matrix(sample["vec"])
    chosen: list[int] = []
    for k in range(len(m)):
        if len(chosen) == most:
            break
        if not chosen or (2 - 2 * m[chosen] @ m[k] > (reach / 2) ** 2).all():
            chosen.append(k)
    return m[chosen]


class Forest:
    """Which of a slice's vectors are linked with each other."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite the ends of edges. Each round hooks every root on the smallest root that it meets, and halves paths until they are flat."""
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root != (up := self.root[self.root])).any():
                self.root = up


@dataclass
class Slice:
    """The vectors of one tile that others pass by, and what was found of them; ``own`` tells whether links between themselves count here."""

    rep: np.ndarray
    n: np.ndarray
    m: np.ndarray
    own: bool
    least: float

    def __post_init__(self):
        self.single, self.links, self.forest = self.m.astype(np.float32), np.zeros(len(self.rep), np.int64), Forest(len(self.rep))
        if self.own:
            for k in range(0, len(self.rep), BATCH):
                i, j = self.near(self.m[k : k + BATCH], k)
                self.count(i + k, self.n[j])
                self.count(j, self.n[i + k])
                self.forest.join(i + k, j)

    def near(self, m: np.ndarray, after: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of the pairs with a cosine of ``least`` or more; with ``after``, the rows are vectors of the slice from there on and only later places count."""
        first = max(0, after)
        m, of = widen(m, self.m.shape[1]), widen(self.m, m.shape[1])
        i, j = np.nonzero(m.astype(np.float32) @ widen(self.single, m.shape[1])[first:].T >= self.least - MARGIN)
        j += first
        if after >= 0:
            later = j > i + first
            i, j = i[later], j[later]
        right = np.zeros(len(i), bool)
        for k in range(0, len(i), 16 * BATCH):
            part = slice(k, k + 16 * BATCH)
            right[part] = np.einsum("ij,ij->i", m[i[part]], of[j[part]]) >= self.least
        return i[right], j[right]

    def count(self, places: np.ndarray, n: np.ndarray) -> None:
        np.add.at(self.links, places, n)

    def passing(self, rep: np.ndarray, n: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
        """(rep, links, other) of those vectors of a batch that have links with the slice."""
        i, j = self.near(m)
        self.count(j, n[i])
        links = np.bincount(i, self.n[j], minlength=len(rep)).astype(np.int64)
        met, first = np.unique(i, return_index=True)
        self.forest.join(j, j[first][np.searchsorted(met, i)])
        return [rep[met], links[met], self.rep[j[first]]]

    def found(self) -> list[np.ndarray]:
        some = self.links > 0
        return [self.rep[some], self.links[some], self.rep[self.forest.root[some]]]


def joined(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(rep, links, other) per tile, from rows (cell, slice, part, role, core, rep, n, vec) in their order: a tile's slice (role 0) comes before those that pass."""
    held: list[pa.RecordBatch] = []
    tile, of = None, None

    def sent(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rep", "links", "other"])

    def built() -> Slice:
        t = pa.Table.from_batches(held)
        # A core's own links are known, and those of a slice that is in several tiles count in the first.
        return Slice(t["rep"].to_numpy(), t["n"].to_numpy(), matrix(t["vec"]), not t["core"][0].as_py() and t["part"][0].as_py() == 0, least)

    for b in batches:
        key = np.stack([b[c].to_numpy() for c in ("cell", "slice", "part", "role")], axis=1)
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(key)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo == hi:
                continue
            now, rows = tuple(key[lo][:3]), b.slice(lo, hi - lo)
            if now != tile:
                if held:
                    of = built()
                if of:
                    yield sent(of.found())
                tile, of, held = now, None, []
            if key[lo][3] == 0:
                held.append(rows)
                continue
            if held:
                of, held = built(), []
            if of:
                for k in range(0, rows.num_rows, BATCH):
                    r = rows.slice(k, BATCH)
                    yield sent(of.passing(r["rep"].to_numpy(), r["n"].to_numpy(), matrix(r["vec"])))
    if held:
        of = built()
    if of:
        yield sent(of.found())


def met(reps: DataFrame, least: float = LEAST, cell: int = CELL, held: int = HELD, passing: int = PASSING) -> DataFrame:
    """(rep, links, other): links of the distinct vectors ``reps`` (rep, n, vec) by the tile that found them, weighted by ``n``; ``other`` is linked with rep, directly or by links of the tile."""
    spark, reach = reps.sparkSession, float(np.sqrt(max(0.0, 2 - 2 * least)))
    space = Space(choose_pivots(reps, reach, min(PIVOTS, -(-reps.count() // cell))), reach)
    if not len(space.pivots):
        return spark.createDataFrame([], "rep long, links long, other long")
    space.held = max(1, held // max(1, space.pivots.shape[1]))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, d = space.home(b["vec"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(d), pa.array(d <= reach / 2 - SLACK)], names=[*b.schema.names, "cell", "d", "core"])

    kind = reps.schema["vec"].dataType.simpleString()
    at = common.materialise(reps.select("rep", "n", "vec").mapInArrow(homes, f"rep long, n long, vec {kind}, cell int, d double, core boolean"), "homes")
    # One row per pivot and kind.
    k, cells = len(space.pivots), at.groupBy("cell", "core").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.min("rep").alias("first"), F.max("d").alias("radius"))
    known = cells.collect()
    space.radius, space.cores, space.slices = np.full(k, -np.inf), np.zeros(k, np.int64), np.zeros(k, np.int64)
    for r in known:
        if not r.core:
            space.radius[r.cell] = r.radius
        (space.cores if r.core else space.slices)[r.cell] = -(-r.rows // space.held)

    def visitors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k, np.int64)
        for b in batches:
            total += np.bincount(space.visits(b["vec"], b["cell"].to_numpy(), b["core"].to_numpy(zero_copy_only=False))[1], minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(total)], names=["cell", "n"])

    loads = {r[0]: r[1] for r in at.select("vec", "cell", "core").mapInArrow(visitors, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect()}
    space.parts = np.array([max(1, -(-loads.get(c, 0) // passing)) for c in range(k)])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A vector is in one slice of its cell, the core's first, for each part. It passes the slices of the cells that it is sent to, at home those after its own."""
        for b in batches:
            home, core, rep = (b[c].to_numpy(zero_copy_only=False) for c in ("cell", "core", "rep"))
            spread = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            some = np.where(core, space.cores[home], space.slices[home]).astype(np.uint64)
            own = np.where(core, 0, space.cores[home]) + (spread % np.maximum(some, 1)).astype(np.int64)
            times = space.parts[home]
            rows = np.repeat(np.arange(len(rep)), times)
            made = [(rows, home[rows], own[rows], np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times), np.zeros(len(rows)))]
            rows, cells, to_core, to_rest = space.visits(b["vec"], home, core)
            part = (spread[rows] // np.uint64(space.held) % space.parts[cells].astype(np.uint64)).astype(np.int64)
            for s in range(int((space.cores + space.slices).max())):
                to = np.where(s < space.cores[cells], to_core, to_rest & (s < space.cores[cells] + space.slices[cells]) & ((cells != home[rows]) | (own[rows] < s)))
                made.append((rows[to], cells[to], np.full(to.sum(), s), part[to], np.ones(to.sum())))
            rows, *key = (np.concatenate(x) for x in zip(*made, strict=True))
            for lo in range(0, len(rows), 8 * BATCH):
                r = slice(lo, lo + 8 * BATCH)
                taken = b.take(pa.array(rows[r]))
                yield pa.RecordBatch.from_arrays([*[pa.array(c[r].astype(np.int32)) for c in key], *[taken[c] for c in ("core", "rep", "n", "vec")]], names=["cell", "slice", "part", "role", "core", "rep", "n", "vec"])

    dealt = at.mapInArrow(places, f"cell int, slice int, part int, role int, core boolean, rep long, n long, vec {kind}")
    tiles = dealt.repartition("cell", "slice", "part").sortWithinPartitions("cell", "slice", "part", "role")
    found = common.materialise(tiles.mapInArrow(lambda batches: joined(batches, least), "rep long, links long, other long"), "links")
    cores = spark.createDataFrame([(r.cell, r.n, r["first"]) for r in known if r.core], "cell int, all long, first long")
    inner = at.where("core").join(F.broadcast(cores), "cell").select("rep", (F.col("all") - F.col("n")).alias("links"), F.col("first").alias("other"))
    return found.unionByName(inner)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", least: float = LEAST, cell: int = CELL, held: int = HELD, passing: int = PASSING) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    v = F.col(vector)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    whole = v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda c: c != 0) & F.col(id_col).isNotNull()
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(whole, v).alias("vec"))
    reps = common.materialise(rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "distinct-vectors")
    # Different vectors may share an id.
    reps = common.materialise(reps.withColumn("id", F.col("rep")).withColumn("rep", F.monotonically_increasing_id()), "numbered-vectors")
    found = common.materialise(met(reps, least, cell, held, passing), "met")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = simhash.components(found.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    each = reps.join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    smallest = each.groupBy("root").agg(F.min("id").alias("component_id"))
    each = common.materialise(each.join(smallest, "root").select("vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", "n"), "vector-results")
    out = common.join_unique(rows, each.drop("n"), "vec", each.select("vec", "n"), rows.count())
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
