import os
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from sigloom.llm import packing, token_counts, token_output, tokens  # noqa: E402

TEXTS = [None, "", "   ", "Hello world, it's 42!", "naïve café é " * 40, "word " * 5000, "a\u00a0b\tc\r\nd", "x" * 9000, "Σίσυφος ΟΔΟΣ", "<|endoftext|> mid<|startoftext|>dle", "don't we'll I'm", "日本語 テキスト 123"]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name))


def table(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, length string")


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_encoder_equals_library():
    lib, enc = library("word_bpe_49k.json"), tokens.SpaceDroppingEncoder(P.path("word_bpe_49k.json"), 5)
    for t in TEXTS:
        assert np.frombuffer(enc.id_bytes(t), "<u4").tolist() == lib.encode(t or "", add_special_tokens=False).ids


def test_pack_is_whole_and_gapless(spark):
    lib, docs = library("word_bpe_49k.json"), table(spark, TEXTS + TEXTS[3:5])
    rows = packing.pack(docs, P.path("word_bpe_49k.json")).toPandas()
    for i, t in enumerate(TEXTS + TEXTS[3:5]):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        mine = rows[rows.doc_id == i].sort_values("piece")
        assert mine.start.tolist() == list(range(0, len(ids), 2048))
        assert mine.ids_crc32.tolist() == [crc(ids[s : s + 2048]) for s in range(0, len(ids), 2048)]
    for _, seq in rows.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= 2048
    assert packing.pack(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0
    again = packing.pack(docs.union(docs), P.path("word_bpe_49k.json"))  # repeated rows are packed each
    assert again.count() == 2 * len(rows)


def exact(sizes, capacity):
    """Fewest bins by exhaustive search."""
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i, r in enumerate(rooms):
            if r >= sizes[k]:
                place(k + 1, [*rooms[:i], r - sizes[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


def test_patterns_are_optimal_on_small_cases():
    rng = np.random.default_rng(3)
    for _ in range(25):
        sizes = sorted(rng.integers(1, 20, rng.integers(1, 9)).tolist(), reverse=True)
        counts = {s: sizes.count(s) for s in sizes}
        made = packing.choose_patterns(counts, 20)
        assert sum(t for _, t in made) == exact(sizes, 20)
        used = {s: sum(dict(p).get(s, 0) * t for p, t in made) for s in counts}
        assert used == counts


def undominated(sizes, counts, room):
    """By definition: no other filling has places for all pieces of this one, each place a piece at least as long as what it holds."""
    every = [c for c in product(*[range(counts[s] + 1) for s in sizes]) if sum(n * s for n, s in zip(c, sizes, strict=True)) <= room]

    def pieces(c):
        return [s for s, n in zip(sizes, c, strict=True) for _ in range(n)][::-1]

    def holds(rooms, what):
        if not what:
            return True
        return any(holds([*rooms[:i], r - what[0], *rooms[i + 1 :]], what[1:]) for i, r in enumerate(rooms) if r >= what[0])

    return {c for c in every if not any(g != c and holds(pieces(g), pieces(c)) for g in every)}


def test_fillings_are_the_undominated_ones():
    rng = np.random.default_rng(5)
    for _ in range(120):
        sizes = sorted(set(rng.integers(1, 20, rng.integers(1, 6)).tolist()))
        counts, room = {s: int(rng.integers(1, 4)) for s in sizes}, int(rng.integers(5, 40))
        found = [tuple(dict(f).get(s, 0) for s in sizes) for f in packing.fillings(sizes, counts, room)]
        sums = [sum(n * s for n, s in zip(c, sizes, strict=True)) for c in found]
        assert sums == sorted(sums, reverse=True) and len(set(found)) == len(found)
        assert set(found) == undominated(sizes, counts, room)


def test_search_closes_the_gap_that_best_fit_leaves():
    sizes = [38, 37, 36, 35, 29, 29, 24, 17, 16, 10, 9, 9]
    counts = {s: sizes.count(s) for s in sizes}
    assert sum(t for _, t in packing.best_fit(counts, 60)) == 6
    made = packing.choose_patterns(counts, 60)
    assert sum(t for _, t in made) == exact(sizes, 60) == 5
    assert made == packing.choose_patterns(counts, 60)


def test_counts_equal_library(spark):
    lib = library("byte_bpe_50k.json")
    texts = [*TEXTS, "  lead  and   trail  ", "\n\n\nx", "tab\t\tt <|endoftext|><|endoftext|>"]
    rows = token_counts.count_tokens(table(spark, texts).withColumnRenamed("length", "N_TOKENS"), P.path("byte_bpe_50k.json"), P.PATTERN, 1024).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (rows.n_tokens[i], rows.n_bytes[i], rows.over_limit[i]) == (n, len((t or "").encode()), n > 1024)
    assert token_counts.count_tokens(table(spark, []), P.path("byte_bpe_50k.json"), P.PATTERN, 5).count() == 0


def test_sketch_keeps_heavy_hitters():
    from collections import Counter

    counts = Counter({f"w{i}": 1 for i in range(100)} | {"the": 500, "of": 300})
    assert set(token_counts.prune(counts, 10)) == {"the", "of"}


def test_orc_round_trip(spark, tmp_path):
    lib, texts = library("word_bpe_49k.json"), [TEXTS[i % len(TEXTS)] for i in range(60)]
    docs = table(spark, texts).union(spark.createDataFrame([(None, "null id", "x")], "doc_id long, text string, length string"))
    path = f"file://{tmp_path}/ids"
    token_output.write_orc(docs, path, P.path("word_bpe_49k.json"), 2)
    rows = token_output.digest(token_output.read_orc(spark, path)).toPandas().sort_values("doc_id", na_position="first")
    want, start = [], 0
    for t in ["null id", *texts]:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((start, len(ids), crc(ids)))
        start += len(ids)
    assert list(zip(rows.start, rows.n_tokens, rows.ids_crc32)) == want
    some = token_output.read_orc(spark, path, [7, 31])
    assert sorted(r.doc_id for r in some.collect()) == [7, 31]
    assert "In(doc_id" in some._jdf.queryExecution().toString()
    assert token_output.read_orc(spark, path, [1_000]).count() == 0
    token_output.write_orc(table(spark, []), f"file://{tmp_path}/none", P.path("word_bpe_49k.json"), 2)
    assert token_output.digest(token_output.read_orc(spark, f"file://{tmp_path}/none")).count() == 0


def test_orc_files_have_indexes_and_an_id_reads_one_shard(spark, tmp_path):
    from pyarrow import orc

    n, path = 6_000, f"{tmp_path}/ids"
    docs = spark.range(n).select((F.col("id") * 2).alias("doc_id"), F.lit("some words").alias("text"))
    token_output.write_orc(docs, f"file://{path}", P.path("word_bpe_49k.json"), 2, shards=4)
    files = sorted(f for f in os.listdir(path) if f.endswith(".orc"))
    shards = spark.read.parquet(f"file://{path}/_shards").orderBy("shard").collect()
    assert [r.file for r in shards] == files and sum(r.n_rows for r in shards) == n
    assert all(a.largest < b.least for a, b in zip(shards, shards[1:], strict=False))
    assert all(orc.ORCFile(f"{path}/{f}").row_index_stride == token_output.ROW_INDEX for f in files)
    one = token_output.read_orc(spark, f"file://{path}", [2_000])
    assert len(one.inputFiles()) == 1 and one.count() == 1
    assert 0 < rows_scanned(spark, one) <= token_output.ROW_INDEX < shards[0].n_rows  # the row index passes over the other row groups
    assert rows_scanned(spark, token_output.read_orc(spark, f"file://{path}", [2_001])) == 0  # within a row group's range, so only the Bloom filter can tell


def rows_scanned(spark, df):
    """Rows that the file scan hands on."""
    df = df.select("doc_id")
    df.collect()
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        if "Scan" in plan.nodeName():
            return plan.metrics().apply("numOutputRows").value()
        todo += [plan.children().apply(i) for i in range(plan.children().size())]


def test_rows_with_one_id_span_shards(spark, tmp_path):
    docs = spark.range(4_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.col("id") % 50).alias("text"))
    path = f"file://{tmp_path}/same"
    token_output.write_orc(docs, path, P.path("word_bpe_49k.json"), 2, shards=4)
    rows = token_output.digest(token_output.read_orc(spark, path)).orderBy("start").collect()
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows]).tolist()[:-1]]
    assert spark.read.parquet(f"{path}/_shards").agg(F.max("n_rows")).first()[0] < 2_000
