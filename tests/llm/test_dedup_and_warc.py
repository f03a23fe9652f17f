import base64
import hashlib
import json
import os
import random
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sigloom.llm import common, similar, simhash, warc


def brute_print(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(ws[i : i + width]) for i in range(len(ws) - width + 1)] if len(ws) >= width else [" ".join(ws)] if ws else []
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if bin(prints[i] ^ prints[j]).count("1") <= 2 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(50)] + ["É", "ß", "A\u00a0B", "XyZ"]
    texts = [None, "", " \t\n", "one", "two words", "One", "TWO words"]
    for _ in range(60):
        t = [rng.choice(words) for _ in range(rng.choice([3, 5, 30, 400]))]
        texts.append(" ".join(t))
        for _ in range(rng.randrange(3)):
            u = list(t)
            u[rng.randrange(len(u))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", "  "]).join(u))
    texts.append("long " * 100_000)
    rows = simhash.near_duplicates(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp int")).collect()
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    root = brute_components(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", root[i]) for i in prints}
    assert len(set(root.values())) < len(root)


def test_links_on_chains_and_hot_groups(spark):
    nodes = [(i, (1 << (2 * i)) - 1) for i in range(30)] + [(100 + i, (1 << 62) | (1 << i)) for i in range(20)]
    prints = dict(nodes)
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in nodes], "rep long, fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = {i: r for i, r in brute_components(prints).items() if any(i != j and bin(prints[i] ^ prints[j]).count("1") <= 2 for j in prints)}
    assert found == {i: r for i, r in want.items() if i != r}


def test_links_of_a_wider_radius(spark):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(12)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), n)) for p in prints for n in (1, 2, 3, 4, 5)]
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(prints)], "rep long, fp long")
    near = {(i, j) for i, f in enumerate(prints) for j, g in enumerate(prints) if i < j and bin(f ^ g).count("1") <= 4}
    edges = {(r.a, r.b) for r in simhash.links(df, 4).collect()}
    root = {i: i for i in range(len(prints))}
    for _ in prints:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    assert edges <= near and {r.node: r.root for r in simhash.components(simhash.links(df, 4)).collect()} == {i: r for i, r in root.items() if i != r}
    with pytest.raises(ValueError):
        simhash.links(df, 3)


def test_many_near_copies_of_one_text(spark):
    """More copies than GROUP share each shingle; most are nearer to the text than to each other."""
    rng = random.Random(21)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(base)]
    for k in range(300):
        u = list(base)
        for i in rng.sample(range(len(u)), rng.randrange(1, 9)):
            u[i] = f"e{k}x{i}"
        texts.append(" ".join(u))
    sets, root = brute_sets(texts), list(range(len(texts)))
    prints = [brute_print(t) for t in texts]
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and (len(a & b) >= 0.8 * len(a | b) or bin(prints[i] ^ prints[j]).count("1") <= 2)]
    for _ in range(20):
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == set(root) and 20 < len(kept) < 250


def kept_of(texts):
    """The documents that brute force keeps: pairs from an inverted index of shingles, verified on the sets."""
    sets, prints = brute_sets(texts), [brute_print(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def tie(i, j):
        a, b = sorted((find(i), find(j)))
        root[b] = a

    by_shingle = {}
    for i, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    n = 0
    for i, a in enumerate(sets):
        met = Counter(j for x in a for j in by_shingle[x] if j < i)
        for j, both in met.items():
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                n += 1
                tie(i, j)
    for bits in range(4):  # fingerprints within two bits agree on one of four runs of 16 bits at least
        run = {}
        for i, f in enumerate(prints):
            for j in run.setdefault(f >> 16 * bits & 0xFFFF, []):
                if bin(f ^ prints[j]).count("1") <= 2:
                    tie(i, j)
            run[f >> 16 * bits & 0xFFFF].append(i)
    return {find(i) for i in range(len(texts))}, n


def stage_keeps(spark, texts):
    return {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect()}


def test_pairs_behind_a_common_boilerplate(spark):
    """Pairs of near copies that share most of their text with all other pairs: none is lost."""
    rng = random.Random(31)
    head, texts = [f"b{i}" for i in range(19)], []
    for k in range(400):
        own = [f"o{k}x{i}" for i in range(6)]
        texts += [" ".join(head + own), " ".join(head + own[:-1] + [f"e{k}"])]
    rng.shuffle(texts)
    want, n = kept_of(texts)
    assert n >= 400 and stage_keeps(spark, texts) == want


def test_documents_of_common_paragraphs(spark, monkeypatch):
    """All shingles are frequent, so the order of shingles tells nothing, and most sets that meet aren't similar."""
    rng = random.Random(32)
    paragraphs = [[f"p{k}w{i}" for i in range(30)] for k in range(24)]
    texts = []
    for _ in range(500):
        chosen = rng.sample(range(24), 14)
        texts.append(" ".join(w for k in chosen for w in paragraphs[k]))
        if rng.random() < 0.5:
            texts.append(" ".join(w for k in [*chosen[:-1], rng.randrange(24)] for w in paragraphs[k]))
    want, n = kept_of(texts)
    assert n > 100 and len(want) > 300
    for sets in (512, 60):
        monkeypatch.setattr(similar, "TILE_SETS", sets)
        assert stage_keeps(spark, texts) == want


def test_many_documents_of_one_template(spark):
    rng = random.Random(33)
    template, texts = [f"t{i}" for i in range(90)], []
    for k in range(5000):
        u = list(template)
        for i in rng.sample(range(90), rng.choice([0, 1, 2, 3, 4, 9])):
            u[i] = f"f{rng.randrange(40)}x{i}" if rng.random() < 0.5 else f"g{k}x{i}"
        texts.append(" ".join(u))
    want, n = kept_of_large(texts)
    assert n and stage_keeps(spark, texts) == want


def kept_of_large(texts):
    """``kept_of`` by bit masks of words' places: texts of one template are compared as rows of word numbers."""
    words = {w: i for i, w in enumerate({w for t in texts for w in t.split()})}
    m = np.array([[words[w] for w in t.split()] for t in texts])
    n = m.shape[1] - 4
    root = np.arange(len(texts))
    links = 0
    prints = np.array([brute_print(t) for t in texts], np.uint64)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(1, len(texts)):
        same = (m[:i] == m[i])
        both = np.lib.stride_tricks.sliding_window_view(same, 5, axis=1).all(axis=2).sum(axis=1)  # shingles of a template meet at their own place only
        near = (both >= 0.8 * (2 * n - both)) | (np.bitwise_count(prints[:i] ^ prints[i]) <= 2)
        links += int(near.sum())
        for j in np.unique([find(j) for j in np.flatnonzero(near)]):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return {find(i) for i in range(len(texts))}, links


def test_meetings_in_small_batches():
    """Pairs and frequent keys don't depend on how rows are cut into batches."""
    import pyarrow as pa

    rng = random.Random(5)
    rows = sorted((k, r, 20, rng.randrange(4), rng.randrange(3), int(k == 7)) for k in range(40) for r in range(rng.choice([1, 2, 3, 16, 128, 129, 300])))

    def run(size):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size], strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["key", "row", "n", "at", "before", "hot"]) for i in range(0, len(rows), size)]
        return sorted(tuple(r.values()) for b in similar.meetings(iter(batches), 0.8) for r in b.to_pylist())

    want, by_key = run(10_000), Counter(r[0] for r in rows)
    assert all(run(size) == want for size in (1, 5, 128, 129, 200))
    assert Counter(r[2] for r in want if r[1] < 0) == {k: n for k, n in by_key.items() if n > 128 or k == 7}


def test_a_stage_leaves_no_tables_but_its_list_of_ids(spark):
    root = common._scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    d = spark.createDataFrame([(i, f"text number {i % 3} of the same few words that all texts here have in common") for i in range(9)], "doc_id long, text string")
    kept = simhash.drop_near_duplicates(d)
    left = set(os.listdir(root)) - before
    assert len(left) == 1 and next(iter(left)).startswith("kept-ids") and kept.count() in (1, 2, 3)
    with common.scratch_scope(spark):
        kept = common.materialise(simhash.drop_near_duplicates(d), "result", lasting=True)
    assert {n.split("-")[0] for n in set(os.listdir(root)) - before - left} == {"result"} and kept.count() in (1, 2, 3)


def test_one_of_each_group_stays(spark):
    t = " ".join(f"w{i}" for i in range(80))
    rows = [(3, t, "a"), (1, t, "b"), (2, "else", "c"), (2, "else", "c"), (None, t, "d"), (9, t, "e")]
    d = spark.createDataFrame(rows, "doc_id long, text string, root string")
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns and sorted((r.doc_id or -1, r.root) for r in kept.collect()) == [(-1, "d"), (1, "b"), (2, "c")]
    assert simhash.drop_near_duplicates(d.limit(0)).count() == 0 and simhash.near_duplicates(d.limit(0)).count() == 0


def brute_sets(texts):
    words = [(t or "").lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def test_stage_drops_near_copies_of_five_word_shingles(spark):
    rng = random.Random(13)
    texts = []
    for _ in range(40):  # an edited word per about 60, as in an edited copy: op4's radius sees few of these
        t = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 120, 300, 1000]))]
        for _ in range(rng.randrange(1, 4)):
            u = list(t)
            for i in rng.sample(range(len(u)), len(u) // rng.choice([20, 40, 60])):
                u[i] = "edited"
            texts.append(" ".join(u))
        texts.append(" ".join(t))
    sets, root = brute_sets(texts), list(range(len(texts)))
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) >= 0.8 * len(a | b)]
    for _ in texts:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(d).collect()}
    assert kept == set(root) and len(near) > 20
    assert len(set(brute_components({i: brute_print(t) for i, t in enumerate(texts)}).values())) > len(kept)


PAGES = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, None, "same"), (2, "u\r\nX: y", None), (4, "é", ""), (6, "z", "long " * 50_000), (7, "z", "WARC/1.1\r\n\r\nblock\r\n\r\n"), (8, "dup", "twice"), (8, "dup", "twice"), (None, "n", "same"), (None, "n2", "only")]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/a"
    warc.write_warc(pages, path, shards=3, roll_bytes=200)
    rows = warc.read_warc(spark, path).collect()
    got = sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in rows)
    want = []
    for p, u, h in PAGES:
        body = (h or "").encode()
        to = {"same": 5, "": 4, None: 4}.get(h)
        kind = "revisit" if to not in (None, p) else "response"
        want.append((p or -1, kind, to if kind == "revisit" else None, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()))
    want[8] = (8, "revisit", 8, *want[8][3:])
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[2] or -1, x[3]))
    assert {r.payload for r in rows if r.page_id == 7} == {PAGES[6][2].encode()}
    assert next(r.url for r in rows if r.page_id == 2) == "u%0D%0AX: y"
    files = sorted(f for f in os.listdir(f"{tmp_path}/a") if f.endswith(".warc.gz"))
    assert len(files) > 3 and not os.path.exists(f"{tmp_path}/a/_temporary_warc")
    assert json.load(open(f"{tmp_path}/a/_MANIFEST.json"))["records"] == len(PAGES)
    # A second run makes the same bytes.
    warc.write_warc(pages.repartition(5), f"file://{tmp_path}/b", shards=3, roll_bytes=200)
    assert all(open(f"{tmp_path}/a/{f}", "rb").read() == open(f"{tmp_path}/b/{f}", "rb").read() for f in files)


def test_warc_of_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_warc(pages, f"file://{tmp_path}/n").count() == 0
    assert warc.read_warc(spark, f"file://{tmp_path}/n").count() == 0


def test_warc_bytes_do_not_depend_on_the_partitioning(spark, tmp_path):
    n = 60_000
    pages = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.pow("id", F.lit(2)).cast("long")).alias("page_id"), F.lit("http://a/b").alias("url"), F.concat(F.lit("page "), F.col("id") % 20_000).alias("html"))
    for name, df in (("a", pages), ("b", pages.repartition(13))):
        warc.write_warc(df, f"file://{tmp_path}/{name}", shards=6, roll_bytes=200_000)
    a, b = (sorted(f for f in os.listdir(f"{tmp_path}/{x}") if f.endswith(".warc.gz")) for x in "ab")
    assert a == b and len({f[:11] for f in a}) == 6
    assert all(open(f"{tmp_path}/a/{f}", "rb").read() == open(f"{tmp_path}/b/{f}", "rb").read() for f in a)
    shards = Counter()
    for r in spark.read.json(f"file://{tmp_path}/a/manifest").collect():
        shards[r.name[:11]] += r.n_records
    assert sum(shards.values()) == n and max(shards.values()) <= 1.3 * n / 6  # a third of the rows has no id: they are split by digest
    rows = warc.read_warc(spark, f"file://{tmp_path}/a")
    assert rows.count() == n and rows.where("record_type = 'response'").count() == 20_000
    os.remove(f"{tmp_path}/b/_MANIFEST.json")
    with pytest.raises(FileNotFoundError):
        warc.read_warc(spark, f"file://{tmp_path}/b")


def test_bounds_of_crowded_ids(spark):
    ids = [*range(1000), *[1 << 60] * 600, *range((1 << 61), (1 << 61) + 400), *[None] * 10, -(1 << 62)]
    keys = spark.createDataFrame([(i, hashlib.sha1(str(k).encode()).hexdigest()) for k, i in enumerate(ids)], "page_id long, digest string")
    found = warc.bounds(keys, 8)
    assert found == sorted(found) and len(found) == 7
    order = sorted((warc._NULL if r.page_id is None else r.page_id, r.digest[:3]) for r in keys.collect())
    sizes = np.diff([0, *[bisect_left(order, f) for f in found], len(order)])
    assert sizes.sum() == len(ids) and sizes.max() <= -(-len(ids) // 8) + 1
    assert warc.bounds(keys.limit(0), 8) == []


def test_bounds_of_many_shards(spark):
    n = 1_000_000
    even = spark.range(n).select((F.col("id") * 9_000_000_000_000 - (1 << 62)).alias("page_id"), F.sha1(F.col("id").cast("string")).alias("digest"))
    far = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise((1 << 62) + F.col("id")).alias("page_id"), F.sha1(F.col("id").cast("string")).alias("digest"))
    for keys, rows, shards in ((even, n, 20_000), (far, 200_000, 5_000)):
        found = warc.bounds(keys, shards)
        assert found == sorted(found) and shards * 0.6 < len(found) < shards
        ids = np.sort(np.array([r[0] for r in keys.select("page_id").toArrow().to_pandas().itertuples(index=False)]))
        sizes = np.diff([0, *np.searchsorted(ids, [f for f, _ in found]), rows])
        assert sizes.sum() == rows and sizes[:-1].max() <= -(-rows // shards)
    ends = spark.createDataFrame([(-(1 << 63) + 1, "a" * 40), ((1 << 63) - 1, "b" * 40), (0, "c" * 40)], "page_id long, digest string")
    first, second = [f for f, _ in warc.bounds(ends, 3)]
    assert -(1 << 63) + 1 < first <= 0 < second <= (1 << 63) - 1
