"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

The items are the indexed side; every passage of every training text is a query. The index's terms
are pairs of adjacent words, so chance hits are rare. A posting's weight is its BM25 weight divided by
the sum of its item's weights, so an item's score against its own text is 1 and one threshold suits
items of every length. Items are searched by length class, a class's lengths going up to a power of two (``span``). Its passages are windows
of twice the span, and the next one starts half a window on, so any stretch as long as an item lies whole in some passage, and
no item's passages depend on what other items there are.

The search: a passage whose terms' list maxima sum to less than the threshold can hold no item above
it and is passed over (for all passages of a batch at once); the others go through block-max WAND,
which finds every item that reaches the threshold. A retrieved item is a leak where the passage also
holds at least ``OVERLAP`` of the word triples of the item's question and of its answer (its last
quarter, ``ANSWER_SHARE``; with a separate answer column, that column).

Item statistics cover all items. The index is cut into shards of at most ``SHARD_WORDS`` words, by item
length. SHARDS_A_SCAN of them are broadcast together and searched in one pass over the texts, so the broadcast is bounded whatever the
number of items; how items are dealt to shards and scans changes no result.

Null, empty and punctuation-only texts match nothing, and neither do such items or those of one word.
Null ids are carried. Items with equal words all match. Repeated documents are each reported; rows equal
in id and text are reported once. Other columns are ignored. No items or no documents: no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

K1, B = 1.2, 0.75
THRESHOLD = 0.35
OVERLAP = 0.6
ANSWER_SHARE = 0.25
BLOCK = 32
SHARD_WORDS = 400_000
SHARDS_A_SCAN = 4
_LEAKS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def words(text: str | None) -> list[str]:
    return common.PLAIN_WORD.findall(text.lower()) if text else []


def pairs_of(ws: list[str]) -> list[tuple[str, str]]:
    return list(zip(ws, ws[1:], strict=False))


def triples_of(ws: list[str]) -> set[tuple[str, ...]]:
    """Word triples; of two words, the pair."""
    return {tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))} if ws else set()


def span_of(length: int) -> int:
    """The upper end of the length's class: the least power of two that isn't below it."""
    return 1 << max(0, length - 1).bit_length()


def numbered(items: list[tuple]) -> dict[str, int]:
    return {w: i for i, w in enumerate(sorted({w for _, q, a in items for w in q + a}))}


class Index:
    """Posting lists of a length class's items, in item order, in blocks with their largest weight.

    ``items``: (item_id, question words, answer words); ``df`` and the mean length are those of all items. ``numbers`` are word numbers, if they are given.
    """

    def __init__(self, items: list[tuple], df: dict[tuple[str, str], int], n_items: int, mean_length: float, numbers: dict[str, int] | None = None):
        self.ids = [i for i, _, _ in items]
        self.parts = [(triples_of(q), triples_of(a)) for _, q, a in items]
        self.span = max((span_of(len(q) + len(a)) for _, q, a in items), default=1)
        self.words = numbered(items) if numbers is None else numbers
        postings: dict[int, list[tuple[int, float]]] = {}
        for at, (_, q, a) in enumerate(items):
            tf = Counter(pairs_of(q + a))
            length = sum(tf.values())
            weight = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * length / mean_length)) for t, c in tf.items()}
            total = sum(weight.values())
            for t, w in weight.items():
                postings.setdefault(self.words[t[0]] * len(self.words) + self.words[t[1]], []).append((at, w / total))
        self.keys = np.array(sorted(postings), np.int64)
        self.items = [np.array([i for i, _ in postings[k]], np.int64) for k in self.keys.tolist()]
        self.weights = [np.array([w for _, w in postings[k]]) for k in self.keys.tolist()]
        self.block_max = [np.maximum.reduceat(w, np.arange(0, len(w), BLOCK)) for w in self.weights]
        self.list_max = np.array([w.max() for w in self.weights])

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: every item whose weights over the (distinct) terms sum to the threshold or more."""
        least = threshold - 1e-9
        lists = [[t, 0] for t in terms]  # term and place in its list
        found = []
        while lists:
            lists.sort(key=lambda x: self.items[x[0]][x[1]])
            bound, pivot = 0.0, -1
            for k, (t, _) in enumerate(lists):
                bound += self.list_max[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = self.items[lists[pivot][0]][lists[pivot][1]]
            while pivot + 1 < len(lists) and self.items[lists[pivot + 1][0]][lists[pivot + 1][1]] == item:
                pivot += 1
            # The blocks in which the lists up to the pivot would hold the item, and the first item after any of these blocks.
            bound, beyond = 0.0, len(self.ids)
            for t, at in lists[: pivot + 1]:
                block = int(np.searchsorted(self.items[t][at:], item) + at) // BLOCK
                if block < len(self.block_max[t]):
                    bound += self.block_max[t][block]
                    after = (block + 1) * BLOCK
                    beyond = min(beyond, self.items[t][after] if after < len(self.items[t]) else len(self.ids))
            if pivot + 1 < len(lists):
                beyond = min(beyond, self.items[lists[pivot + 1][0]][lists[pivot + 1][1]])
            if bound >= least:
                score = 0.0
                for x in lists[: pivot + 1]:
                    x[1] += int(np.searchsorted(self.items[x[0]][x[1] :], item))
                    if x[1] < len(self.items[x[0]]) and self.items[x[0]][x[1]] == item:
                        score += self.weights[x[0]][x[1]]
                        x[1] += 1
                if score >= least:
                    found.append((int(item), float(score)))
            else:  # no item before the end of these blocks can reach it
                to = max(int(beyond), int(item) + 1)
                for x in lists[: pivot + 1]:
                    x[1] += int(np.searchsorted(self.items[x[0]][x[1] :], to))
            lists = [x for x in lists if x[1] < len(self.items[x[0]])]
        return found

    def passages(self, hits: np.ndarray, terms: np.ndarray, n_words: int, threshold: float) -> Iterator[tuple[int, int, list[int]]]:
        """(first word, end, distinct terms) of a text's passages whose list maxima sum to the threshold or more; ``terms`` are at the places ``hits``."""
        if not len(hits):
            return
        step, size = self.span, 2 * self.span
        sums = np.r_[0.0, np.cumsum(self.list_max[terms])]
        starts = np.arange(0, max(1, n_words - step), step)
        # A term is a pair, so a passage's last one starts a word before its end.
        lo, hi = np.searchsorted(hits, starts), np.searchsorted(hits, starts + size - 1)
        for k in np.flatnonzero(sums[hi] - sums[lo] >= threshold - 1e-9):
            yield int(starts[k]), int(min(n_words, starts[k] + size)), np.unique(terms[lo[k] : hi[k]]).tolist()

    def leaks(self, ws: list[str], hits: np.ndarray, terms: np.ndarray, threshold: float, overlap: float) -> list[tuple]:
        """(item_id, score, question overlap, answer overlap), the best passage of each leaked item."""
        best: dict[int, tuple] = {}
        for start, end, distinct in self.passages(hits, terms, len(ws), threshold):
            if not (found := self.search(distinct, threshold)):
                continue
            there = triples_of(ws[start:end]) | set(pairs_of(ws[start:end])) | {(w,) for w in ws[start:end]}
            for item, score in found:
                q, a = (len(p & there) / len(p) if p else 1.0 for p in self.parts[item])
                if q >= overlap and a >= overlap:
                    best[item] = max(best.get(item, (0.0, 0.0, 0.0)), (score, q, a))
        return [(self.ids[i], *x) for i, x in sorted(best.items())]


class Shard:
    """The indexes of some items by length class, over one vocabulary, so that a text is looked up once for all of them."""

    def __init__(self, items: list[tuple], df: dict[tuple[str, str], int], n_items: int, mean_length: float):
        self.words = numbered(items)
        classes: dict[int, list[tuple]] = {}
        for i, q, a in items:
            classes.setdefault(span_of(len(q) + len(a)), []).append((i, q, a))
        self.indexes = [Index(classes[c], df, n_items, mean_length, self.words) for c in sorted(classes)]
        self.keys = np.unique(np.concatenate([x.keys for x in self.indexes])) if self.indexes else np.zeros(0, np.int64)
        self.local = []  # of each index: its number of each key, or -1
        for x in self.indexes:
            self.local.append(np.full(len(self.keys), -1, np.int32))
            self.local[-1][np.searchsorted(self.keys, x.keys)] = np.arange(len(x.keys))

    def leaks(self, text: str | None, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple]:
        ws = words(text)
        ids = np.fromiter(map(self.words.get, ws, (-1 for _ in ws)), np.int64, len(ws))
        a, b = ids[:-1], ids[1:]
        known = np.flatnonzero((a >= 0) & (b >= 0))
        if not len(self.keys) or not len(known):
            return []
        key = a[known] * len(self.words) + b[known]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        hits, terms = known[hit], at[hit]
        out = []
        for index, local in zip(self.indexes, self.local, strict=True):
            mine = local[terms]
            there = mine >= 0
            out += index.leaks(ws, hits[there], mine[there], threshold, overlap)
        return out


def parts(text: str | None, answer: str | None = None) -> tuple[list[str], list[str]]:
    """Question and answer words of an item: of one text, the answer is the last quarter of it."""
    ws = words(text)
    if answer is not None:
        return ws, words(answer)
    cut = len(ws) - max(1, round(ANSWER_SHARE * len(ws))) if ws else 0
    return ws[:cut], ws[cut:]


def shards(items: DataFrame, id_col: str, text: str, answer: str | None) -> Iterator[Shard]:
    """Shards of all items, each of a bounded number of words, the shortest items first."""
    schema = "item_id long, length long, question array<string>, answer array<string>"

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *parts(t, a)) for i, t, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            rows = [(i, len(q) + len(a), q, a) for i, q, a in rows if len(q) + len(a) > 1]
            types = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["item_id", "length", "question", "answer"])

    answers = F.col(answer).cast("string") if answer else F.lit(None).cast("string")
    table = common.materialise(items.select(F.col(id_col).cast("long"), F.col(text).cast("string"), answers).mapInArrow(tokenise, schema), "items")
    n, mean, total = table.agg(F.count("*"), F.avg(F.col("length") - 1), F.sum("length")).first()
    if not n:
        return
    full = F.concat("question", "answer")
    pair = F.explode(F.array_distinct(F.arrays_zip(F.slice(full, 1, F.size(full) - 1).alias("a"), F.slice(full, 2, F.size(full)).alias("b"))))
    df = common.materialise(table.select(pair.alias("p")).groupBy("p.a", "p.b").count(), "item-terms")
    lengths = [int(r[0]) for r in table.groupBy("length").count().orderBy("length").select("length").collect()]
    done = 0
    for length, group in _groups(table, lengths, int(total)):
        rows = [(r["item_id"], list(r["question"]), list(r["answer"])) for r in group]
        own = table.sparkSession.createDataFrame(sorted({p for _, q, a in rows for p in pairs_of(q + a)}), "a string, b string")
        counts = {(r["a"], r["b"]): r["count"] for r in df.join(F.broadcast(own), ["a", "b"]).collect()}
        done += len(rows)
        yield Shard(rows, counts, int(n), float(mean))


def _groups(table: DataFrame, lengths: list[int], total: int) -> Iterator[tuple[int, list]]:
    """The items in order of length, at most SHARD_WORDS words (or one item) at a time."""
    group, size = [], 0
    for r in table.orderBy("length", "item_id").toLocalIterator() if total > SHARD_WORDS else sorted(table.collect(), key=lambda r: (r["length"], r["item_id"] is not None, r["item_id"] or 0)):
        if group and size + r["length"] > SHARD_WORDS:
            yield size, group
            group, size = [], 0
        group.append(r)
        size += r["length"]
    if group:
        yield size, group


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) per document and test item that it holds."""
    rows = common.in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    spark = docs.sparkSession
    found = []
    for some in batched(shards(items, item_id, item_text, answer), SHARDS_A_SCAN):
        shared = spark.sparkContext.broadcast(some)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[list] = [[], [], [], [], []]
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for shard in shared.value:
                        for leak in shard.leaks(t, threshold):
                            for c, v in zip(out, (d, *leak), strict=True):
                                c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found.append(rows.mapInArrow(search, _LEAKS))
    if not found:
        return spark.createDataFrame([], _LEAKS)
    return reduce(DataFrame.unionAll, found).distinct()


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no test item, with their own columns. Nothing is shuffled."""
    for some in batched(shards(items, item_id, item_text, answer), SHARDS_A_SCAN):
        shared = docs.sparkSession.sparkContext.broadcast(some)
        docs = common.keep_rows(docs, text, lambda texts, shared=shared: [not any(x.leaks(t, threshold) for x in shared.value) for t in texts])
    return docs
