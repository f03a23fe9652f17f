"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Each distinct fingerprint emits every variant within half the (even) radius: for radius 2 itself and its
64 one-bit flips. Two fingerprints within the radius share a variant, and all that share one are
within the radius of each other, so a star from the smallest document of each variant's group keeps
every link with no pairs enumerated; a group has at most as many fingerprints as a fingerprint has variants, whatever the number of
copies. Components come from alternating large-star and small-star steps over written edge tables.

The pipeline's stage also links documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by the exact
join of ``similar``.

Defined cases: null or empty texts and texts of white space have fingerprint zero, linked like any
other. Fewer than ``width`` words make one shingle of them all. A null id takes part in no link:
its row is returned, with the component of its fingerprint if other documents have it, else null.
Rows with the same id and the same text repeat in the result. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from . import common, similar

SEED = 42
RADIUS = 2
#: Hashes summed at once; bounds the memory for very long texts.
_BLOCK = 65_536


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash: a bit is set if set in over half the XXH64 values of the word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    return _majority(_hashes(words, width))


def _hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The XXH64 values of the word shingles, in blocks."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False)) if len(words) >= width else iter([b" ".join(words)])
    while len(block := np.fromiter((hashed(s, SEED) for s in islice(shingles, _BLOCK)), "<u8")):
        yield block


def _majority(blocks: Iterable[np.ndarray]) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for block in blocks:
        n += len(block)
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode().lower().split()
    return np.unique(np.concatenate(list(_hashes(words, width)))) if words else np.zeros(0, np.uint64)


def profile(text: str | None, rare: np.ndarray, width: int = similar.WIDTH, least: float = similar.LEAST) -> tuple:
    """Of the set of the text's shingles: a digest (none without words), its size, its first hashes, how many of those aren't hot, its hashes by bucket, and its distinct 32-bit hashes in order."""
    import xxhash

    found = shingle_hashes(text, width)
    if not len(found):
        return None, 0, [], 0, [], []
    first, cool = similar.first_shingles(found, rare, least)
    digest = int(np.array(xxhash.xxh64_intdigest(found.tobytes(), SEED), np.uint64).view(np.int64))
    short = np.unique(found.astype(np.uint32)).view(np.int32)
    return digest, len(found), first, cool, similar.bucket_counts([short])[0], short


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, same, fp): fp is the fingerprint's 64 bits as a signed long, same a hash of the text that tells rows with one id apart."""

    def made(texts: list) -> list:
        return [np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)]

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return common.append_columns(rows.withColumn("same", F.xxhash64("text")), ["text"], "fp long", made).drop("text")


def profiles(df: DataFrame, id_col: str, text: str, width: int, shingle: int, least: float) -> DataFrame:
    """``fingerprints`` with each text's ``profile``: (set, n, first, cool, buckets, hashes)."""
    rare = similar.levels(df, text, lambda t: shingle_hashes(t, shingle))

    def made(texts: list) -> list:
        found = [profile(t, rare, shingle, least) for t in texts]
        prints = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
        return [prints, *map(list, zip(*found, strict=True))] if found else [prints, [], [], [], [], [], []]

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return common.append_columns(rows.withColumn("same", F.xxhash64("text")), ["text"], "fp long, set long, n int, first array<long>, cool int, buckets array<int>, hashes array<int>", made).drop("text")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a < b) between representatives of distinct fingerprints (rep, fp) that differ in at most ``radius`` bits, an even number."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius is an even number of bits")
    # A variant has up to half the radius of bits flipped, in ascending order; bit 64 stands for no more flips.
    variants = nodes.select("rep", "fp", F.col("fp").alias("variant"), F.lit(-1).alias("bit"))
    for _ in range(radius // 2):
        after = F.when(F.col("bit") < 64, F.sequence(F.col("bit") + 1, F.lit(64))).otherwise(F.array(F.lit(64)))
        variants = variants.select("rep", "fp", "variant", F.explode(after).alias("bit"))
        flip = F.when(F.col("bit") < 64, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("long"))
        variants = variants.select("rep", "fp", F.col("variant").bitwiseXOR(flip).alias("variant"), "bit")
    # The representative's own bits are carried, for the check of the pair.
    groups = variants.select("variant", F.struct("rep", "fp").alias("of")).groupBy("variant").agg(F.sort_array(F.collect_list("of")).alias("all")).where(F.size("all") > 1)
    star = groups.select(F.col("all")[0].alias("x"), F.explode(F.slice("all", 2, F.size("all"))).alias("y"))
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius
    return star.where(near).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b), for every node that has an edge and isn't itself the smallest.

    Each round does a large-star and a small-star step and writes the new edges, and deletes those of the round before; the rounds needed
    grow with the logarithm of the longest chain. Nothing but counts and checksums reaches the driver.
    """

    def signature(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = common.materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    was = signature(edges)
    while was[0]:
        # Large star: every larger neighbour of u is tied to the smallest of u and its neighbours.
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("least")).select("u", F.least("u", "least").alias("least"))
        # An edge (a, b) with a < b is seen from a: b is the larger one.
        large = edges.join(low, edges["a"] == low["u"]).select(F.col("least").alias("a"), "b")
        # Small star: u and its smaller neighbours are tied to the smallest of those.
        large = common.materialise(large.where("a <> b").distinct(), "large-star")
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("least"))
        small = large.join(least, large["b"] == least["u"]).select(F.col("least").alias("a"), F.col("a").alias("b")).where("a <> b")
        before, edges = edges, common.materialise(small.union(least.select(F.col("least").alias("a"), F.col("u").alias("b"))).distinct(), "small-star")
        common.discard(before, large)
        now = signature(edges)
        if now == was:
            break
        was = now
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def _labelled(df: DataFrame, id_col: str, text: str, width: int, radius: int, shingle: int | None = None, least: float = similar.LEAST) -> DataFrame:
    """(doc_id, same, fp, component_id) for each row; with ``shingle``, similar sets of shingles of so many words are linked too."""
    made = profiles(df, id_col, text, width, shingle, least).withColumn("row", F.monotonically_increasing_id()) if shingle else fingerprints(df, id_col, text, width)
    prints = common.materialise(made, "fingerprints")
    nodes = common.materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "distinct-fingerprints")
    # Dealt anew, as the written table may be a few files and each row becomes many.
    edges = links(nodes.where("rep is not null").select("rep", "fp").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), radius)
    if shingle:
        known = prints.where("doc_id is not null and set is not null")
        # One row per set: that of its smallest id.
        firsts = common.materialise(known.groupBy("set").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("set", "first.*"), "distinct-sets")
        # A row's set and its fingerprint belong together.
        tied = known.select("fp", "set").distinct().join(nodes.select("fp", F.col("rep").alias("a")), "fp")
        tied = tied.join(firsts.select("set", F.col("doc_id").alias("b")), "set").where("a <> b").select("a", "b")
        edges = similar.links(known, firsts, edges.unionByName(tied), least, components)
        prints = prints.select("doc_id", "same", "fp")
    found = components(edges)
    labels = common.materialise(nodes.join(found, nodes["rep"] == found["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id")), "labels")
    return common.join_unique(prints, labels, "fp", nodes.select("fp", "n"), prints.count())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row; component_id is the smallest id that links reach."""
    return _labelled(df, id_col, text, width, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, radius: int = RADIUS, shingle: int = similar.WIDTH, least: float = similar.LEAST) -> DataFrame:
    """One row per component of ``near_duplicates``' links and those between similar sets: that of the smallest id. Rows with a null id stay; all columns stay.

    Rows that share an id are told apart by their text; of a component's texts with its smallest id one stays, and of rows equal in both
    any one, whatever their other columns. But for the list of the ids that stay, the tables written on the way are deleted before the result is returned.
    """
    with common.scratch_scope(df.sparkSession):
        found = _labelled(df, id_col, text, width, radius, shingle, least).where("doc_id = component_id")
        first = common.materialise(found.groupBy(F.col("component_id").alias("__keep")).agg(F.min("same").alias("__first")), "kept-ids", lasting=True)
    # The join and the choice among repeated rows need the same partitioning, so texts are shuffled once.
    rows = df.withColumn("__same", F.xxhash64(df[text].cast("string")))
    kept = rows.join(first, (F.col(id_col).cast("long") == F.col("__keep")) & (F.col("__same") == F.col("__first")), "left_semi")
    kept = kept.dropDuplicates([id_col, "__same"]).drop("__same")
    return kept.unionByName(df.where(F.col(id_col).isNull()))
