"""Fill-in-the-middle, the metric range join and the source audit against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigloom.llm import divergence, fim, metric_join

EMB = "vec_id long, embedding array<float>, label int"


def brute_rearranged(doc_id, text):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text or "")
    n, text = len(units), text or ""
    h = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if doc_id is None or not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:lo], units[lo:hi], units[hi:]))
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_brute_force_and_is_restored(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "\n\t ", "one", " one", "one ", "<P>", "a <S b>", "x <M> y", "<P", "P> <S", "é ß   z", "😀 😀\r\n😀", "w " * 200_000, "x" * 300_000, " " * 100_000]
    texts += ["".join(rng.choice(["a", "bc", " ", "\n", "<", ">", "P", "S", "M", "é", " ", "😀"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = [(i, t, "mine") for i, t in enumerate(texts)] + [(None, "a b c", "mine"), (7, "seven again", "mine"), (-5, "minus five", "mine")]
    d = fim.transform(spark.createDataFrame(rows, "doc_id long, text string, form string"))
    got = d.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert [(r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got] == [brute_rearranged(i, t) for i, t, _ in rows]
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    every = fim.transform(spark.createDataFrame([(i, "a b c") for i in range(50)], "doc_id long, text string"), rate=100, suffix_first=0).collect()
    assert {r.form for r in every} == {"psm"}


def test_the_matcher_stores_no_units():
    text = "word " * 400_000
    tracemalloc.start()
    n = fim.count_units(text)
    at = fim.cuts(text, n // 3, n // 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == (5 * (n // 3) - 1, 5 * (n // 2) - 1) and peak < 20_000


def brute_near(rows, least=0.95):
    width = max((len(v) for _, v in rows if v), default=0)
    links, comp = [0] * len(rows), {}
    ok = [i is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    m = np.array([[*v, *[0.0] * (width - len(v))] if k else [0.0] * width for (_, v), k in zip(rows, ok, strict=True)], float)
    m = np.divide(m, np.abs(m).max(axis=1, keepdims=True), out=np.zeros_like(m), where=np.abs(m).max(axis=1, keepdims=True) > 0)
    norm = np.linalg.norm(m, axis=1)
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and m[a] @ m[b] / (norm[a] * norm[b]) >= least:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            comp[find(k)] = min(comp.get(find(k), i), i)
    return sorted((-1 if i is None else i, links[k], -1 if i is None else comp[find(k)], i is None or comp[find(k)] == i) for k, (i, _) in enumerate(rows))


def found(spark, rows, kind="float", **more):
    d = spark.createDataFrame([(i, v, 0) for i, v in rows], EMB.replace("float", kind))
    return sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in metric_join.near_vectors(d, **more).collect())


def clustered(seed, n=420, dim=12):
    """Even noise, chains whose ends aren't linked, a large tight group, and copies."""
    rng = np.random.default_rng(seed)
    some = [rng.normal(size=dim) for _ in range(n // 3)]
    centre = rng.normal(size=dim)
    some += [centre + rng.normal(size=dim) * 0.02 for _ in range(n // 3)]
    step = rng.normal(size=dim)
    for _ in range(n // 6):
        step = step + rng.normal(size=dim) * 0.12
        some.append(step)
    some += [some[int(rng.integers(len(some)))] * float(rng.choice([1, 1, 2])) for _ in range(n // 6)]
    order = rng.permutation(len(some))
    return [(int(k), [float(np.float32(x)) for x in some[at]]) for k, at in enumerate(order)]


@pytest.mark.parametrize(("cell", "held", "passing"), [(4096, 1 << 20, 131_072), (20, 12 * 60, 50), (3, 12 * 5, 20), (150, 12 * 40, 64)])
def test_metric_join_equals_brute_force_whatever_the_cells(spark, cell, held, passing):
    rows = clustered(cell)
    want = brute_near(rows)
    assert found(spark, rows, cell=cell, held=held, passing=passing) == want
    assert len({r[2] for r in want}) < len(rows) - 100 and max(r[1] for r in want) > 100


def test_a_slice_and_its_passers_in_batches(monkeypatch):
    monkeypatch.setattr(metric_join, "BATCH", 37)
    m = metric_join.matrix(pa.array([v for _, v in clustered(1)]))
    own, others = m[:250], m[250:]
    s = metric_join.Slice(np.arange(250), np.full(250, 2), own, True, 0.95)
    rep, links, to = s.passing(np.arange(250, 420), np.ones(170, np.int64), others)
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    assert s.links.tolist() == (2 * near[:250, :250].sum(1) + near[:250, 250:].sum(1)).tolist()
    assert dict(zip(rep, links, strict=True)) == {k: n for k, n in zip(range(250, 420), 2 * near[250:, :250].sum(1), strict=True) if n}
    assert near[rep, to].all() and len({s.forest.root[k] for k in range(100)}) <= 100


def test_metric_join_of_odd_vectors_and_other_thresholds(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, -inf]), (7, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [3.0, 0.0]), (9, [3.0, 0.0]), (9, [0.0, 1.0]), (None, [1.0, 0.0]), (11, [1e200, 1e199]), (12, [1e-200, 1e-201]), (13, [-1.0, 0.0]), (14, [0.0, 0.0, 0.0, 2.0])]
    assert found(spark, rows, "double") == brute_near(rows)
    rows = clustered(5, 120, 4)
    for least in (1.0, 0.5, -0.2):
        if least < 1:
            assert found(spark, rows, least=least) == brute_near(rows, least)
    assert found(spark, []) == []
    assert found(spark, [(1, None), (1, None)]) == [(1, 0, 1, True)] * 2
    d = spark.createDataFrame([(5, [1.0, 0.0], 3, "x"), (2, [1.0, 0.0], 3, "x")], "vec_id long, embedding array<double>, rep int, cell string")
    assert sorted(tuple(r) for r in metric_join.near_vectors(d).collect()) == [(2, 1, 2, True), (5, 1, 2, False)]


def test_op12_of_the_whole_table_equals_brute_force(spark):
    from sigloom.llm import queries

    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op12_embedding_near_dedup(spark, sf)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(tuple(r) for r in got.collect()) == brute_near(rows)


def brute_audit(rows, least=3, ranks=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    pattern = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = pattern.findall(text.translate(lower))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang in {r[1] for r in rows}:
        kept = [t for t, k in docs[lang].items() if k >= least]
        v, sources = len(kept), sorted({s for of, s in counts if of == lang})
        share = lambda c, n: 1 + 1_000_000_000 * (c + 1) // (n + v)  # noqa: E731, B023
        of_group = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        total = {t: sum(of_group[s][t] for s in sources) for t in kept}
        p = {s: {t: share(c, sum(of_group[s].values())) for t, c in of_group[s].items()} for s in sources}
        q = {t: share(c, sum(total.values())) for t, c in total.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            best = [(t, f(p[s][t], q[t])) for t in kept if of_group[s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", best, ranks)):
                out += [(lang, s, part, i, x, k + 1) for k, (i, x) in enumerate(sorted(items, key=lambda y: (-y[1], y[0].encode()))[:most])]
    return sorted(out)


@pytest.mark.parametrize(("tile_terms", "tile_groups", "held"), [(2048, 128, 400_000), (7, 3, 5), (1, 1, 50)])
def test_audit_equals_brute_force_whatever_the_tiles(spark, monkeypatch, tile_terms, tile_groups, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(9)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["É", "é", "ß", "naïve", "İ", "a1b", "can't", "日本", "A B", "😀"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "s4", None, "S1"])) for _ in range(150)]
    rows += [(None, "en", "empty"), ("", "fr", "a"), ("alone", "fr", "b"), ("x " * 50_000 + "rare", "en", "s1"), ("..", "xx", None)] + [rows[0]] * 3
    d = spark.createDataFrame([(*r, 1, "y") for r in rows], "text string, lang string, source string, n int, term string")
    got = divergence.audit(d, tile_terms=tile_terms, tile_groups=tile_groups, ranks=6)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows, ranks=6)
    assert divergence.audit(d.limit(0)).count() == 0


def test_shares_are_exact_for_large_counts():
    rng = random.Random(1)
    pairs = [(rng.randrange(1, 10**15), 9 * 10**15 - rng.randrange(10**14)) for _ in range(200)] + [(5, 3), (1, 1), (8 * 10**15, 8 * 10**15)]
    got = divergence.shares(np.array([c for c, _ in pairs]), np.array([t for _, t in pairs]))
    assert got.tolist() == [1 + 10**9 * c // t for c, t in pairs]
    t = divergence.tile(pa.table({"source": ["a"], "own": [0], "n_group": [0], "n_terms": [0], "n_lang": [0], "here": [0], "a": [0], "b": [0]}), pa.table({"source": pa.array([], pa.string()), "term": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "total": pa.array([], pa.int64())}))
    assert t["item"] == []
