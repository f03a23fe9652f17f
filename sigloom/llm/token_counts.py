"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the corpus's frequent pre-tokens and their numbers of tokens; tier
two is a bounded cache in each Python worker, filled by encoding what tier one misses. Texts and
pre-tokens are never shuffled: the frequent ones come from mergeable heavy-hitter sketches of
bounded size, one per partition over all its texts, merged in a tree. The table affects speed
alone; every count is exact.

Nulls and empty texts count 0 tokens and 0 bytes. A text of any length is scanned whole. Repeated
rows and ids are counted row by row; an empty table gives an empty result. Other columns pass
through, except those named like a result column, which are replaced.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, tokens

#: Entries of the broadcast table, and of each partition's sketch.
FREQUENT = 16_384
#: Entries of a worker's table before it starts anew from the broadcast one.
CACHED = 300_000
#: A partition's counter is cut back to FREQUENT entries when it has grown to this many.
TRACKED = 262_144


def prune(counts: Counter, keep: int) -> Counter:
    """Misra-Gries cut: the ``keep`` largest counts less the next largest, so that sketches merge with a bounded error."""
    if len(counts) <= keep:
        return counts
    top = counts.most_common(keep + 1)
    least = top[-1][1]
    return Counter({k: n - least for k, n in top[:-1] if n > least})


def frequent_pretokens(df: DataFrame, text: str, pattern: str, keep: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens of all texts, at most ``keep``."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, counts = regex.compile(pattern).findall, Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    counts.update(find(t))
                    if len(counts) > TRACKED:
                        counts = prune(counts, keep)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(dict(prune(counts, keep)))], pa.binary())], names=["sketch"])

    def merge(a: bytes, b: bytes) -> bytes:
        both = Counter(pickle.loads(a))
        both.update(pickle.loads(b))
        return pickle.dumps(dict(prune(both, keep)))

    rdd = common.in_small_batches(df).select(F.col(text).cast("string")).mapInArrow(sketch, "sketch binary").rdd.map(lambda r: bytes(r[0]))
    parts = rdd.getNumPartitions()
    if not parts:
        return []
    merged = Counter(pickle.loads(rdd.treeReduce(merge, depth=max(2, math.ceil(math.log(parts + 1, 16))))))
    return [k for k, _ in sorted(merged.items(), key=lambda x: (-x[1], x[0]))[:keep]]


def count_tokens(df: DataFrame, path: str, pattern: str, limit: int, text: str = "text", keep: int = FREQUENT) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of ``text`` under a byte-level BPE file.

    ``pattern`` is the file's pre-token pattern. Special strings inside texts count as the library
    takes them by default: one token each.
    """
    spark = df.sparkSession
    lib = tokens.library(path)
    special = [t.content for t in lib.get_added_tokens_decoder().values()]
    frequent = frequent_pretokens(df, text, pattern, keep)
    sizes = [len(e.ids) for e in lib.encode_batch(frequent, add_special_tokens=False)]
    table = spark.sparkContext.broadcast(dict(zip(frequent, sizes, strict=True)))

    class Lengths(dict):
        def __missing__(self, pretoken: str) -> int:
            n = len(tokens.library(path).encode(pretoken, add_special_tokens=False).ids)
            if len(self) >= CACHED:
                self.clear()
                self.update(table.value)
            self[pretoken] = n
            return n

    state: dict = {}

    def count(texts: list) -> list:
        import regex

        if not state:
            state.update(find=regex.compile(pattern).findall, cut=regex.compile("|".join(map(regex.escape, special))) if special else None, sizes=Lengths(table.value))
        find, cut, size = state["find"], state["cut"], state["sizes"].__getitem__
        n_bytes, n_tokens = [], []
        for t in texts:
            t = t or ""
            n_bytes.append(len(t.encode()))
            pieces = cut.split(t) if cut and any(s in t for s in special) else [t]
            n_tokens.append(len(pieces) - 1 + sum(sum(map(size, find(p))) for p in pieces))
        return [n_bytes, n_tokens, [n > limit for n in n_tokens]]

    return common.append_columns(df.withColumn(text, F.col(text).cast("string")), [text], "n_bytes long, n_tokens long, over_limit boolean", count)
