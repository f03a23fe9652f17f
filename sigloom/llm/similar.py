"""Links between documents whose sets of word shingles have a Jaccard similarity of ``LEAST`` or more: an exact join for components.

Prefix filtering: of n shingles in any fixed order of all shingles, the first n - ceil(LEAST n) + 1 hold one that any set as similar has among
its own first. The order is rarest first, by a sketch of fixed size that counts all shingles of all texts, so what many documents share is
last and seldom among the first. Sets meet at their first shingles (keys); a meeting counts only if sizes and places in
the order still allow the similarity, and only at the pair's first common key where that can be told, and counts of shingles by bucket allow it. Pairs
are then verified on the sets: each set with its likeliest partner, then those pairs that are not in one component yet.

A key with more than ``GROUP`` sets doesn't look at its pairs. Its sets are first compared with those nearest to the text that
all of them vary, and components are found. Keys whose sets are then all in one component are done. The sets of the others are compared exactly:
they form blocks (sets joined by such keys), a block is cut by size and then into tiles of bounded size, and a tile compares sets of different
components, with a bound from counts of shingles by bucket before the sets themselves. A tile returns a forest of its links.

Nothing but counters of fixed size and counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

#: Words of a shingle, and the similarity from which two sets are linked.
WIDTH, LEAST = 5, 0.8
#: Sets of a key whose pairs are looked at one by one; and those that the sets of a larger key are compared with first.
GROUP, CENTRES = 128, 16
#: Counters of the sketch of shingles, and bits of the filter of sets that meet others.
SKETCH_BITS, FILTER_BITS = 21, 22
#: Keys whose counter is above 2^HOT are dealt to many tasks; they are counted as frequent without being counted.
HOT, SALTS = 20, 64
#: Sets of a tile, shingles of a tile, and buckets of the bound.
TILE_SETS, TILE_SHINGLES, BUCKETS = 512, 2_000_000, 64


def counters(df: DataFrame, slots: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """How many of the slots (below 2^bits) that ``slots`` gives for the rows fall on each: every task adds up its own, and the tasks' are added up in parts."""
    import zlib

    size, part = 1 << bits, 1 << min(bits, 16)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            np.add.at(total, slots(b), 1)
        for k in range(0, size, part):
            if total[k : k + part].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([zlib.compress(total[k : k + part].tobytes(), 1)])], names=["part", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, counts in zip(b["part"].to_pylist(), b["counts"].to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(zlib.decompress(counts), np.int64)
        for k, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([zlib.compress(counts.tobytes(), 1)])], names=["part", "counts"])

    schema, out = "part long, counts binary", np.zeros(size, np.int64)
    # A few rows of fixed size, in one job.
    for r in df.mapInArrow(own, schema).repartition("part").mapInArrow(added, schema).collect():
        out[r.part : r.part + part] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64)
    return out


def levels(df: DataFrame, text: str, hashes: Callable[[str | None], np.ndarray]) -> np.ndarray:
    """How frequent a shingle is, by its hash's first bits: the binary digits of what its counter has beyond the usual one and thrice its deviation."""

    def slots(b: pa.RecordBatch) -> np.ndarray:
        found = [hashes(t) >> np.uint64(64 - SKETCH_BITS) for t in b.column(0).to_pylist()]
        return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)

    counts = counters(common.in_small_batches(df.select(F.col(text).cast("string"))), slots, SKETCH_BITS)
    usual = np.median(counts)
    return np.ceil(np.log2(np.maximum(0, counts - usual - 3 * np.sqrt(usual)) + 1)).astype(np.uint8)


def first_shingles(found: np.ndarray, rare: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, int]:
    """The keys of a set of distinct hashes, rarest first, and how many of them aren't hot."""
    n = len(found)
    p = n - int(np.ceil(least * n - 1e-9)) + 1
    level = rare[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.lexsort((found, level))[:p]
    return found[order].view(np.int64), int((level[order] <= HOT).sum())


def possible(n: Column | np.ndarray, m: Column | np.ndarray, at: Column | np.ndarray, to: Column | np.ndarray, least: float, low: Callable, high: Callable):
    """Whether sets of n and m shingles that meet at places ``at`` and ``to`` of their orders, and not before, can be as similar."""
    return (low(n, m) >= least * high(n, m) - 1e-9) & (low(n - at, m - to) >= least / (1 + least) * (n + m) - 1e-6)


def meetings(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """From rows (key, row, n, at, before, hot) sorted by key: pairs (x, y) of sets that meet at keys of up to GROUP sets, and the rows of larger or hot keys (as x, with their key)."""
    names = ["x", "y", "key", "n", "at", "before"]
    held: list[np.ndarray] | None = None
    frequent: int | None = None  # the held key, once known to be frequent

    def sent(x, y, rows) -> pa.RecordBatch:
        columns = [x, y] if rows is None else [rows[1], np.full(len(rows[1]), -1, np.int64), rows[0], rows[2], rows[3], rows[4]]
        if rows is None:
            columns += [np.zeros(len(x), np.int64)] + [np.zeros(len(x), np.int32)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def pairs(c: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        ok = possible(c[2][i], c[2][j], c[3][i], c[3][j], least, np.minimum, np.maximum) & (c[1][i] != c[1][j])
        ok &= (c[4][i] != c[4][j]) | (c[3][i] == 0) | (c[3][j] == 0)
        if ok.any():
            x, y = c[1][i[ok]], c[1][j[ok]]
            yield sent(np.minimum(x, y), np.maximum(x, y), None)

    def done(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Whole groups."""
        edges = np.flatnonzero(np.r_[True, c[0][1:] != c[0][:-1], True])
        lo, size = edges[:-1], np.diff(edges)
        many = np.repeat((size > GROUP) | (c[5][lo] > 0) | (c[0][lo] == (frequent if frequent is not None else 0)) & (frequent is not None), size)
        if many.any():
            yield sent(None, None, [v[many] for v in c])
        few = ~many[lo]
        for k in range(2, 9):  # small groups of one size together
            of = lo[few & (size == k)]
            if len(of):
                for a, b in combinations(range(k), 2):
                    yield from pairs(c, of + a, of + b)
        for at, k in zip(*(v[few & (size > 8)].tolist() for v in (lo, size)), strict=True):
            a, b = np.triu_indices(k, 1)
            yield from pairs(c, at + a, at + b)

    for b in batches:
        if not b.num_rows:
            continue
        c = [b.column(k).to_numpy() for k in range(6)]
        if held is not None:
            c = [np.concatenate(v) for v in zip(held, c, strict=True)]
        last = int(np.searchsorted(c[0], c[0][-1]))
        yield from done([v[:last] for v in c]) if last else ()
        tail = [v[last:] for v in c]
        if len(tail[0]) > GROUP or (frequent is not None and tail[0][0] == frequent):
            frequent = int(tail[0][0])
            yield sent(None, None, tail)
            tail = [v[:0] for v in tail]
        held = tail
    if held is not None and len(held[0]):
        yield from done(held)


def verified(met: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (x, y) of ``met`` whose ``sets`` (row, hashes) are similar. Sets that are in no pair are left where they are, but for the few that a filter of fixed size takes for others."""
    mask = (1 << FILTER_BITS) - 1
    slots = lambda v: (v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FILTER_BITS)).astype(np.int64) & mask
    in_some = counters(met, lambda b: np.concatenate([slots(b[c].to_numpy()) for c in ("x", "y")]), FILTER_BITS) > 0
    packed = np.packbits(in_some)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.unpackbits(packed).astype(bool)
        for b in batches:
            yield b.filter(pa.array(there[slots(b["row"].to_numpy())]))

    needed = common.in_small_batches(sets.select("row", "hashes")).mapInArrow(keep, sets.select("row", "hashes").schema)
    for end in "xy":
        met = met.join(needed.select(F.col("row").alias(end), F.col("hashes").alias(f"hashes_{end}")), end)
    both = F.size(F.array_intersect("hashes_x", "hashes_y"))
    return met.where(both >= least * (F.size("hashes_x") + F.size("hashes_y") - both) - 1e-9).select("x", "y")


def bucket_counts(sets: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.bincount(s.view(np.uint32) & np.uint32(BUCKETS - 1), minlength=BUCKETS) for s in sets]).astype(np.int32)


def tile_links(rows: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], own: np.ndarray, other: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links between sets of different components that together connect what all such links do; pairs are of one set in ``own`` and one in ``other`` (places)."""
    n, counts = np.array([len(s) for s in sets]), bucket_counts(sets)
    parent: dict[int, int] = {}

    def find(r: int) -> int:
        while parent.get(r, r) != r:
            r = parent[r]
        return r

    out, known = [], {}
    for i in own:
        js = other[(roots[other] != roots[i]) & (rows[other] != rows[i])]
        js = js[(np.minimum(n[js], n[i]) >= least * np.maximum(n[js], n[i]) - 1e-9)]
        for lo in range(0, len(js), 4096):
            part = js[lo : lo + 4096]
            most = np.minimum(counts[part], counts[i]).sum(axis=1)
            for j in part[most >= least / (1 + least) * (n[part] + n[i]) - 1e-6].tolist():
                a, b = find(int(roots[i])), find(int(roots[j]))
                if a == b:
                    continue
                for k in (int(i), j):
                    if k not in known:
                        known[k] = frozenset(sets[k].tolist()) if len(sets[k]) < 50_000 else None
                x, y = known[int(i)], known[j]
                both = len(x & y) if x is not None and y is not None else len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= least * (n[i] + n[j] - both) - 1e-9:
                    parent[max(a, b)] = min(a, b)
                    out.append((int(rows[i]), int(rows[j])))
    return out


def rest(frequent: DataFrame, sets: DataFrame, roots: DataFrame, least: float, components: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (x, y) between sets that meet at ``frequent`` keys (key, row) and are in different components so far; ``roots`` has (row, root) of all ``sets`` (row, n, hashes)."""
    at = frequent.select("key", "row").join(roots, "row")
    apart = at.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("row").alias("first")).where("lo <> hi")
    tied = common.materialise(at.join(apart.select("key", "first"), "key").select("row", "first").distinct(), "open-keys")
    blocks = components(tied.select(F.col("row").alias("a"), F.col("first").alias("b")))
    members = tied.select("row").distinct().join(blocks.withColumnRenamed("node", "row"), "row", "left").select("row", F.coalesce(F.col("root"), F.col("row")).alias("block"))
    members = members.join(roots, "row").join(sets.select("row", "n"), "row")
    # Similar sizes are of one class or of neighbours; a tile of class c has those of c and c + 1.
    kind = F.floor(F.log(1 / least, "n") + 1e-9)
    members = members.withColumn("kind", F.explode(F.array(kind, kind - 1))).withColumn("upper", (kind != F.col("kind")).cast("int"))
    members = common.materialise(members, "blocks")
    loads = members.groupBy("block", "kind").agg(F.count("*").alias("rows"), F.sum("n").alias("all")).where("rows > 1")
    slices = F.greatest(F.ceil(F.col("rows") / TILE_SETS), F.ceil(F.col("all") / TILE_SHINGLES)).cast("long")
    dealt = members.join(loads.select("block", "kind", slices.alias("slices")), ["block", "kind"]).withColumn("own", F.pmod(F.xxhash64("row"), F.col("slices")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})
    dealt = dealt.select("block", "kind", "p", "q", "own", "upper", "row", "root").join(sets.select("row", "hashes"), "row")

    def compared(t: pa.Table) -> pa.Table:
        rows, roots_, own, upper = (t[c].to_numpy() for c in ("row", "root", "own", "upper"))
        held, p, q = [np.array(s.as_py(), np.int32) for s in t["hashes"]], t["p"][0].as_py(), t["q"][0].as_py()
        found: list[tuple[int, int]] = []
        # Pairs of the upper class alone are those of the next tile.
        for a, b in ((0, 0), (0, 1)) if p == q else ((0, 0), (0, 1), (1, 0)):
            one, two = np.flatnonzero((own == p) & (upper == a)), np.flatnonzero((own == q) & (upper == b))
            if len(one) and len(two):
                found += tile_links(rows, roots_, held, one, two, least)
        return pa.table({"x": pa.array([x for x, _ in found], pa.int64()), "y": pa.array([y for _, y in found], pa.int64())})

    return dealt.groupBy("block", "kind", "p", "q").applyInArrow(compared, "x long, y long")


def links(rows: DataFrame, firsts: DataFrame, base: DataFrame, least: float, components: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (a, b) of ids: ``base``, and enough links between similar sets to connect what all of them do.

    ``rows`` has (row, doc_id, n, first, cool, buckets, hashes) of documents, ``firsts`` (row, doc_id) one of each set.
    """
    one = rows.join(firsts.select("row"), "row", "left_semi")
    whole = F.size("first")
    each = one.select("row", "n", "first", "cool", F.explode(F.sequence(F.lit(0), whole - 1)).alias("at"))
    before = F.when(F.col("at") > 0, F.shiftright(F.get("first", F.col("at") - 1), 32)).otherwise(0).cast("int")
    keys = each.select(F.get("first", F.col("at")).alias("key"), "row", "n", "at", before.alias("before"), (F.col("at") >= F.col("cool")).cast("int").alias("hot"))
    salt = F.when(F.col("hot") > 0, F.pmod(F.xxhash64("row"), F.lit(SALTS))).otherwise(0)
    dealt = keys.repartition("key", salt).sortWithinPartitions("key")
    meet = common.materialise(dealt.mapInArrow(lambda b: meetings(b, least), "x long, y long, key long, n int, at int, before int"), "meetings")
    pairs = meet.where("y >= 0").select("x", "y")
    frequent = meet.where("y < 0").select("key", F.col("x").alias("row"), "n", "at", "before")
    # The sets with most frequent keys among their first are nearest to the text that all vary.
    p = F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1
    score = frequent.groupBy("row").agg((F.count("*") / F.first(p)).alias("score"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.xxhash64("row"), "row")
    centres = frequent.join(score, "row").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= CENTRES)
    centres = centres.groupBy("key").agg(F.collect_list(F.struct("row", "n", "at", "before")).alias("centres"))
    counts = common.materialise(frequent.groupBy("key").agg(F.count("*").alias("n")), "frequent-keys")
    total = counts.agg(F.sum("n")).first()[0] or 0
    if total:
        def meet_first(c: Column) -> Column:
            ok = possible(F.col("n"), c["n"], F.col("at"), c["at"], least, lambda a, b: F.least(a, b), lambda a, b: F.greatest(a, b)) & (F.col("row") != c["row"])
            return ok & ((F.col("before") != c["before"]) | (F.col("at") == 0) | (c["at"] == 0))

        # Most centres of a key were met at an earlier key, or can't be similar; those go before rows are made.
        tried = common.join_unique(frequent, centres, "key", counts, total).withColumn("c", F.explode(F.filter("centres", meet_first)))
        pairs = pairs.unionByName(tried.select(F.least("row", "c.row").alias("x"), F.greatest("row", "c.row").alias("y")))
    met = pairs.distinct()
    for end in "xy":
        met = met.join(one.select(F.col("row").alias(end), F.col("n").alias(f"n_{end}"), F.col("buckets").alias(f"buckets_{end}")), end)
    most = F.aggregate(F.zip_with("buckets_x", "buckets_y", lambda a, b: F.least(a, b)), F.lit(0), lambda a, v: a + v)
    met = met.select("x", "y", (most / (F.col("n_x") + F.col("n_y"))).alias("share")).where(F.col("share") >= least / (1 + least) - 1e-9)
    met = common.materialise(met, "met")
    ids = firsts.select("row", "doc_id")

    def with_ids(found: DataFrame) -> DataFrame:
        return found.join(ids.select(F.col("row").alias("x"), F.col("doc_id").alias("a")), "x").join(ids.select(F.col("row").alias("y"), F.col("doc_id").alias("b")), "y").select("a", "b")

    def roots_of(edges: DataFrame) -> DataFrame:
        known = components(edges)
        return common.materialise(ids.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("row", F.coalesce("root", "doc_id").alias("root")), "roots")

    # Each set with the likeliest of its partners first: most pairs are then within a component and need no comparison.
    star = met.groupBy("y").agg(F.max_by("x", F.struct("share", "x")).alias("x")).select("x", "y")
    edges = common.materialise(base.unionByName(with_ids(verified(star, one, least))), "links")
    roots = roots_of(edges)
    left = met.join(roots.select(F.col("row").alias("x"), F.col("root").alias("root_x")), "x").join(roots.select(F.col("row").alias("y"), F.col("root").alias("root_y")), "y")
    left = common.materialise(left.where("root_x <> root_y").select("x", "y"), "pairs-left")
    edges = common.materialise(edges.unionByName(with_ids(verified(left, one, least))), "links")
    if not total:
        return edges
    return edges.unionByName(with_ids(common.materialise(rest(frequent, one, roots_of(edges), least, components), "more-links")))
