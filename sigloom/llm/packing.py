"""Best-fit packing of documents into sequences by bin completion.

How lengths pack depends only on how many pieces have each length, and there are fewer lengths than
tokens in a sequence. So the whole table is reduced to that histogram (at most ``capacity`` rows,
whatever the number of documents), patterns of lengths are chosen on it, and the pieces are dealt
to the patterns' places by their rank within their length, in parallel.

The patterns come from bin completion branch-and-bound: around the largest length left, the
undominated fillings of what remains are enumerated one after another, the least waste first. A filling is dominated if
one piece left out could stand for some of its pieces that are together no longer (several pieces of just its length
included), or for none, and still fit. A branch whose waste exceeds what the incumbent
allows is pruned; best-fit-decreasing gives the first incumbent and each better packing replaces it.
A pattern is laid as often as the counts allow and, as another branch, once. The search ends at the lower bound, when no branch is left,
or after ``NODES`` steps or ``TESTS`` fillings, with the incumbent; nothing depends on the clock.

Null and empty texts are one piece: the end id. Only longer documents are cut. Null ids sort first, and
rows with the same id and text are told apart by nothing and packed each. An empty table gives an
empty result. Other columns are dropped.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common, tokens

CAPACITY = 2048
#: Pattern steps of the search, and fillings tested for dominance in it.
NODES, TESTS = 6_000, 50_000

Filling = tuple[tuple[int, int], ...]  # (length, copies), longest first
Pattern = tuple[Filling, int]  # and times


def dominated(filling: Filling, sizes: list[int], counts: dict[int, int], room: int) -> bool:
    """Whether a piece that is left out can stand for some of the filling's: longer than these together, or as long and they are several."""
    used = dict(filling)
    slack = room - sum(s * c for s, c in filling)
    some, several = 1, 0  # sums of any of the pieces, and of two or more of them, as bits
    for s, c in filling:
        for _ in range(c):
            several |= several << s | (some & ~1) << s
            some |= some << s
    for x in sizes:
        if counts[x] > used.get(x, 0) and (several >> x & 1 or some >> max(0, x - slack) & (1 << min(slack, x)) - 1):
            return True
    return False


def fillings(sizes: list[int], counts: dict[int, int], room: int, most_waste: int | None = None, tests: Iterator[int] | None = None) -> Iterator[Filling]:
    """All undominated fillings of ``room`` from the sizes (ascending) with their counts, lazily: the least waste first, then the longest pieces.

    Each filling that is tested takes one of ``tests``; when there are none left the enumeration ends.
    """
    sizes = [s for s in sizes if s <= room and counts[s]]
    full = (1 << (room + 1)) - 1
    reach = [1]  # sums that the first k sizes can make, as bits
    for s in sizes:
        bits, left, step = reach[-1], min(counts[s], room // s), 1
        while left > 0:  # copies by doubling
            take = min(step, left)
            bits |= bits << (s * take) & full
            left -= take
            step *= 2
        reach.append(bits)

    def rest(k: int, left: int, slack: int, out: int) -> Iterator[Filling]:
        """Ways to make ``left`` of the first k sizes. The longest one used is chosen in turn; ``reach`` leaves no dead end.

        ``out`` is the shortest piece left out so far: what is shorter by no more than the slack would be dominated by it.
        """
        if not left:
            yield ()
            return
        fit = min(k, bisect_right(sizes, left))
        k, out = fit, sizes[fit] if fit < k else out
        while True:
            while k and sizes[k - 1] >= out - slack:
                k -= 1
                out = sizes[k]
            if not k or not reach[k] >> left & 1:
                return
            s = sizes[k - 1]
            for c in range(min(counts[s], left // s), 0, -1):
                if reach[k - 1] >> (left - c * s) & 1:
                    for more in rest(k - 1, left - c * s, slack, s if c < counts[s] else out):
                        yield ((s, c), *more)
            k, out = k - 1, s

    least = 0 if most_waste is None else max(0, room - most_waste)
    for total in range(reach[-1].bit_length() - 1, least - 1, -1):
        if reach[-1] >> total & 1:
            for found in rest(len(sizes), total, room - total, 2 * room + 1):
                if tests is not None and next(tests, None) is None:
                    return
                if not dominated(found, sizes, counts, room):
                    yield found


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences needed at least: the Martello-Toth bound over all thresholds up to half the capacity."""
    total = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        total[s] = n
    number, mass = np.cumsum(total), np.cumsum(total * np.arange(capacity + 1))
    best = -(-int(mass[-1]) // capacity)
    for k in range(1, capacity // 2 + 1):
        above = int(number[capacity] - number[capacity - k])  # longer than capacity - k: alone
        middle_n, middle_m = int(number[capacity - k] - number[capacity // 2]), int(mass[capacity - k] - mass[capacity // 2])
        small = int(mass[capacity // 2] - mass[k - 1])
        best = max(best, above + middle_n + max(0, -(-(small - (middle_n * capacity - middle_m)) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit-decreasing over lengths and counts; bins with equal contents are one pattern."""
    open_: dict[int, list[list]] = {}  # room -> [[pattern dict, times]]
    rooms: list[int] = []
    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            room = next((r for r in sorted(rooms) if r >= s), 0)
            if not room:
                each = capacity // s
                for copies, times in ((each, left // each), (left % each, 1)):
                    if copies and times:
                        open_.setdefault(capacity - copies * s, []).append([{s: copies}, times])
                left = 0
            else:
                made, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                fit = min(room // s, left)
                use = min(times, left // fit)
                if use < times:
                    open_.setdefault(room, []).append([made, times - use])
                open_.setdefault(room - fit * s, []).append([made | {s: made.get(s, 0) + fit}, use])
                left -= fit * use
            rooms = [r for r in open_ if r]
    return [(tuple(sorted(m.items(), reverse=True)), t) for group in open_.values() for m, t in group]


def choose_patterns(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, tests: int = TESTS) -> list[Pattern]:
    """Patterns that hold each length as often as it counts, in as few sequences as the search finds."""
    best, bound = best_fit(counts, capacity), lower_bound(counts, capacity)
    fewest, mass = sum(t for _, t in best), sum(s * n for s, n in counts.items())
    left, made, waste, steps = {s: n for s, n in counts.items() if n}, [], 0, 0
    untested = iter(range(tests))
    turns = [0]  # at each node of the branch, how many of its choices were tried

    def choice(turn: int) -> Pattern | None:
        """The node's choices: each filling laid as often as it can be, then (if that is more) once."""
        top = max(left)
        usable = {**left, top: left[top] - 1}
        allowed = (fewest - 1) * capacity - mass - waste
        if allowed < 0:
            return None
        filling = next(islice(fillings(sorted(left), usable, capacity - top, allowed, untested), turn // 2, None), None)
        if filling is None:
            return None
        held = dict(filling)
        held[top] = held.get(top, 0) + 1
        pattern = tuple(sorted(held.items(), reverse=True))
        return pattern, 1 if turn % 2 else min(left[s] // c for s, c in pattern)

    def lay(pattern: Filling, times: int) -> None:
        for s, c in pattern:
            left[s] = left.get(s, 0) - times * c
            if not left[s]:
                del left[s]

    while turns and fewest > bound and steps < nodes:
        found = choice(turns[-1]) if left else None
        if not left and sum(t for _, t in made) < fewest:
            best, fewest = list(made), sum(t for _, t in made)
        if found is None:  # back to the node before
            turns.pop()
            if made:
                pattern, times = made.pop()
                lay(pattern, -times)
                waste -= times * (capacity - sum(s * c for s, c in pattern))
            continue
        pattern, times = found
        turns[-1] += 1 if times > 1 else 2 - turns[-1] % 2
        steps += 1
        lost = times * (capacity - sum(s * c for s, c in pattern))
        if waste + lost <= (fewest - 1) * capacity - mass:
            lay(pattern, times)
            made.append(found)
            waste += lost
            turns.append(0)
    return best


def places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, first sequence, copies, offset) in ascending rank. A pattern takes ``times`` x ``copies`` ranks."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for s, copies in pattern:
            out.setdefault(s, []).append((taken.get(s, 0), sequence, copies, offset))
            taken[s] = taken.get(s, 0) + times * copies
            offset += s * copies
        sequence += times
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


def cut(df: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text: str, buckets: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each document, and a bucket: pieces are dealt to the buckets in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, at = tokens.encoder(tokenizer), TaskContext.get().partitionId()
        for b in batches:
            ids, ends = enc.encode(b.column(1), end_id)
            pieces = -(-np.diff(ends) // capacity)  # each text has an end id, so a piece at least
            of = np.repeat(np.arange(len(pieces)), pieces)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(np.diff(ends)[of] - start, capacity)
            first, flat = ends[of] + start, memoryview(ids).cast("B")
            sums = [zlib.crc32(flat[4 * x : 4 * y]) for x, y in zip(first.tolist(), (first + length).tolist(), strict=True)]
            bucket = (at + np.arange(len(of))) % buckets
            at += len(of)
            columns = [b.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(bucket, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "bucket"])

    return common.in_small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int")


def pack(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = common.materialise(cut(df, tokenizer, capacity, end_id, id_col, text, buckets), "pieces")
    # Ranks within a length: a length's pieces are spread over buckets, ranked there, and raised by the counts of the buckets before.
    sizes = common.materialise(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {int(r[0]): int(r[1]) for r in sizes.groupBy("length").agg(F.sum("n")).collect()}
    plan = spark.sparkContext.broadcast(places(choose_patterns(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("at", F.row_number().over(within) - 1).join(sizes, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("at")).alias("rank"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for s in np.unique(length):
                mine = np.flatnonzero(length == s)
                rows = plan.value[int(s)]
                of = rows[np.searchsorted(rows[:, 0], rank[mine], side="right") - 1]
                turn = rank[mine] - of[:, 0]
                sequence[mine] = of[:, 1] + turn // of[:, 2]
                offset[mine] = of[:, 3] + turn % of[:, 2] * s
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
