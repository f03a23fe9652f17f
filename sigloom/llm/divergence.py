"""How sources differ in their use of words, within a language: term-block dense matrices.

Texts are counted in tasks (a dictionary per group, written out whenever it is full), so a term of a group is a row per task before any shuffle.
The terms of a language are dealt into blocks of about ``TILE_TERMS``; a block with up to ``TILE_GROUPS`` groups, or two such sets of
groups, is one tile: a dense int64 matrix of groups by terms whose pairs of groups are compared by broadcasting. A tile gives the sum of
each pair over its terms and the ``RANKS`` best terms of each group (a heap); Spark adds the sums and merges the heaps.
Nothing but the plan passes through the driver, and a tile's size is bounded whatever the vocabulary or the number of sources.

All arithmetic is exact: shares are integers of 1/UNIT, divided digit by digit so that no product leaves 64 bits.

Defined cases: null texts, languages and sources are ''. Every row is a document, also repeated ones. A group without terms has
the same share of every term; a language without kept terms has pairs of value 0 and no terms. Ties rank by the item's UTF-8
bytes. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common

#: Fixed values of the contract: documents that a kept term has, the unit of shares, and ranks of the term part.
LEAST_DOCS, UNIT, RANKS = 3, 1_000_000_000, 200
#: A tile's terms and groups, on average: 2048 x 128 int64 are 2 MB.
TILE_TERMS, TILE_GROUPS = 2048, 128
#: Terms of all groups that a task holds before it writes them out, and rows of a batch.
HELD, BATCH = 400_000, 65_536
#: Bytes of a term, in lower case, all others being white space: letters A-Z and a-z and everything beyond ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, as UTF-8: only A-Z are lowered."""
    return (text or "").encode().translate(_FOLD).split()


def counted(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents per group and term, several rows of a term where tasks share it."""

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (of, by), (n, docs) in held.items():
            found = list(n)
            for k in range(0, len(found), BATCH):
                part = found[k : k + BATCH]
                columns = [pa.array([of] * len(part)), pa.array([by] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for b in batches:
            for of, by, t in zip(*[c.to_pylist() for c in b.columns], strict=True):
                n, docs = held.setdefault((of, by), (Counter(), Counter()))
                found, before = terms(t), len(n)
                n.update(found)
                docs.update(set(found))
                size += len(n) - before
                if size >= HELD:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    texts = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    return common.in_small_batches(texts).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * counts / totals), three decimal digits at a time: exact for totals below 9 * 10^15."""
    whole, rest = np.divmod(counts, totals)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, totals)
        whole = whole * 1000 + digits
    return whole + 1


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q), as int64."""
    d = p - q
    return d * d // q


def tile(groups: pa.Table, cells: pa.Table, ranks: int = RANKS) -> dict[str, list]:
    """The pairs' sums and the groups' best terms of one tile: ``groups`` (source, own, n_group, n_terms, n_lang, here, a, b), ``cells`` (source, term, n, total).

    Of the ``here`` terms of the block those that no group of the tile has are not among the cells; they have one share per group.
    """
    names, own = groups["source"].to_pylist(), groups["own"].to_numpy()
    n_terms, n_lang, a, b = (groups[c][0].as_py() for c in ("n_terms", "n_lang", "a", "b"))
    found = cells["term"].combine_chunks().dictionary_encode() if cells.num_rows else pa.array([], pa.string()).dictionary_encode()
    words, place = found.dictionary.to_pylist(), found.indices.to_numpy()
    row_of = {s: k for k, s in enumerate(names)}
    counts, total = np.zeros((len(names), len(words)), np.int64), np.zeros(len(words), np.int64)
    counts[[row_of[s] for s in cells["source"].to_pylist()], place] = cells["n"].to_numpy()
    total[place] = cells["total"].to_numpy()
    p = shares(counts + 1, groups["n_group"].to_numpy()[:, None] + n_terms)
    out = {"source": [], "part": [], "item": [], "value": []}

    def put(source: str, part: str, items: list[str], values: list[int]) -> None:
        for c, v in (("source", [source] * len(items)), ("part", [part] * len(items)), ("item", items), ("value", values)):
            out[c].extend(v)

    q, none = shares(total + 1, np.int64(n_lang + n_terms)), shares(np.int64(1), groups["n_group"].to_numpy() + n_terms) if n_terms else None
    absent = groups["here"][0].as_py() - len(words)
    for k, name in enumerate(names):
        others = np.flatnonzero(own != own[k]) if a != b else np.delete(np.arange(len(names)), k)
        value = excess(p[k], p[others]).sum(axis=1)
        if absent:
            value += absent * excess(none[k], none[others])
        put(name, "pair", [names[j] for j in others], value.tolist())
        if a == b:
            mine = np.flatnonzero((counts[k] > 0) & (p[k] > q))
            best = heapq.nsmallest(ranks, zip((-excess(p[k, mine], q[mine])).tolist(), (words[j].encode() for j in mine), strict=True))
            put(name, "term", [w.decode() for _, w in best], [-v for v, _ in best])
    return out


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, ranks: int = RANKS, tile_terms: int = TILE_TERMS, tile_groups: int = TILE_GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank): the divergence of each source from every other one of its language, and the terms that it uses more than the language does."""
    by_task = counted(df, text, lang, source)
    by_group = common.materialise(by_task.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "group-terms")
    kept = by_group.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= least_docs).drop("docs")
    cells = common.materialise(by_group.drop("docs").join(kept, ["lang", "term"]), "kept-terms")
    # One row per group, also for those without terms.
    names = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]).distinct()
    whole = cells.groupBy("lang", "term").agg(F.first("total").alias("total"))
    of_lang = whole.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("total").alias("n_lang"))
    of_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = common.materialise(names.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0), "groups")
    blocks = groups.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.first("n_terms") / tile_terms)).alias("blocks"), F.ceil(F.count("*") / tile_groups).alias("sets"))

    def dealt(rows: DataFrame, block) -> DataFrame:
        """Rows of a set of groups meet every set, their own too; ``block`` is one block of terms or all."""
        own = F.pmod(F.xxhash64("source"), F.col("sets")).cast("long")
        rows = rows.join(blocks, "lang").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sets") - 1)))
        return rows.withColumns({"block": block, "a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("blocks", "sets", "other")

    of_tiles = dealt(groups, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("long")
    in_tiles = dealt(cells, block).drop("own")
    here = whole.join(blocks, "lang").groupBy("lang", block.alias("block")).agg(F.count("*").alias("here"))
    of_tiles = of_tiles.join(here, ["lang", "block"], "left").na.fill(0)
    key = ["lang", "block", "a", "b"]

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # never: each tile has its groups
            return schema.empty_table()
        made = tile(left, right, ranks)
        return pa.table({"lang": [left["lang"][0].as_py()] * len(made["item"]), **made}, schema=schema)

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    made = of_tiles.groupBy(*key).cogroup(in_tiles.groupBy(*key)).applyInArrow(compared, "lang string, source string, part string, item string, value long")
    made = common.materialise(made, "tiles")
    summed = made.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    return summed.select("*", rank).unionByName(made.where("part = 'term'").select("*", rank).where(F.col("rank") <= ranks))
