"""Versions of operators that share nothing with them but their parameters: BM25 leaks by scoring every item, and the fit of the toxicity chain."""

import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sigloom.llm import decontaminate, queries, toxicity


def plain_leaks(items, texts):
    """{(doc, item): score}: passages of a text against every item of their length class, weights from counts made here."""
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    shingles = lambda ws: {tuple(ws[i : i + 3]) for i in range(len(ws) - 2)} or {tuple(ws)} - {()}
    own = [(i, words(t)) for i, t in items]
    own = [(i, ws) for i, ws in own if len(ws) > 1]
    tf = [Counter(zip(ws, ws[1:])) for _, ws in own]  # noqa: B905
    df = Counter(p for c in tf for p in c)
    mean = sum(len(ws) - 1 for _, ws in own) / max(1, len(own))
    holders, parts = defaultdict(dict), []
    for k, (_, ws) in enumerate(own):
        norm = 1.2 * (0.25 + 0.75 * (len(ws) - 1) / mean)
        raw = {p: math.log(1 + (len(own) - df[p] + 0.5) / (df[p] + 0.5)) * 2.2 * c / (c + norm) for p, c in tf[k].items()}
        for p, w in raw.items():
            holders[p][k] = w / sum(raw.values())
        cut = len(ws) - max(1, round(len(ws) / 4))
        span = 2 ** math.ceil(math.log2(len(ws)))
        parts.append((span, shingles(ws[:cut]), shingles(ws[cut:])))
    found = {}
    for d, t in texts:
        ws = words(t)
        for span in {s for s, _, _ in parts}:
            for start in range(0, max(1, len(ws) - span), span):
                part = ws[start : start + 2 * span]
                scores = Counter()
                for p in set(zip(part, part[1:])):  # noqa: B905
                    for k, w in holders.get(p, {}).items():
                        if parts[k][0] == span:
                            scores[k] += w
                there = {tuple(part[i : i + n]) for n in (1, 2, 3) for i in range(len(part))}
                for k, s in scores.items():
                    if s >= 0.35 - 1e-9 and all(len(x & there) >= 0.6 * len(x) for x in parts[k][1:]):
                        found[d, own[k][0]] = max(s, found.get((d, own[k][0]), 0))
    return found


def test_leaks_of_whole_tables_equal_plain_bm25(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    assert (decontaminate.K1, decontaminate.B, decontaminate.THRESHOLD, decontaminate.OVERLAP, decontaminate.ANSWER_SHARE) == (1.2, 0.75, 0.35, 0.6, 0.25)
    rows = lambda name, key: [(r[key], r.text) for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]
    want = plain_leaks(rows("benchmark", "item_id"), rows("documents", "doc_id"))
    got = {(r.doc_id, r.item_id): r.score for r in queries.op3_benchmark_decontamination(spark, sf).collect()}
    assert got.keys() == want.keys() and len(want) > 0
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def spark_key(words, y):
    """Spark's hash of the two arrays: each element's XXH64 seeds the next one's."""
    import xxhash

    h = 42
    for w in words:
        h = xxhash.xxh64(w.encode(), seed=h).intdigest()
    for v in y:
        h = xxhash.xxh64(int(v).to_bytes(4, "little"), seed=h).intdigest()
    return h - (1 << 64) if h >= 1 << 63 else h


def plain_logistic(x, y):
    """Penalised logistic regression by damped Newton steps on the whole loss, to convergence."""
    x, penalty = np.c_[x, np.ones(len(x))], np.r_[np.ones(x.shape[1]), 1e-3]
    share = (y.sum() + 1) / (len(y) + 10)
    w = np.r_[np.zeros(x.shape[1] - 1), math.log(share / (1 - share))]
    if y.min() == y.max():
        return w
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + (penalty * w * w).sum() / 2
    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (p - y) + penalty * w
        step, t = np.linalg.lstsq(x.T @ np.diag(p * (1 - p)) @ x + np.diag(penalty), slope, rcond=None)[0], 1.0
        while loss(w - t * step) > loss(w) + 1e-12 and t > 1e-6:
            t /= 2
        w = w - t * step
        if np.abs(step).max() < 1e-11:
            break
    return w


def plain_chain(texts, marks):
    """Probabilities of (insult, contempt, toxic) of all ``texts``; ``marks`` are the labels of some, None elsewhere."""

    def seen(t):
        ws = set(re.findall(r"\w+", (t or "").lower()))
        return ws | {f"{w[:4]}*" for w in ws if len(w) > 4}

    distinct = {}
    for t, mark in zip(texts, marks, strict=True):
        if mark is not None:
            f = seen(t)
            y = (int(bool(mark and f & set(toxicity.INSULT))), int(bool(mark and f & set(toxicity.CONTEMPT))), mark)
            distinct[spark_key(sorted(f), y)] = (f, y)
    rows = [distinct[k] for k in sorted(distinct)]
    y = np.array([r[1] for r in rows], float)
    n, df = len(rows), Counter(w for f, _ in rows for w in f)
    score = {}
    for w, d in df.items():
        p, best = (d + 1) / (n + 2), 0.0
        for k in range(3):
            m, hits = int(y[:, k].sum()), sum(1 for f, v in rows if v[k] and w in f)
            if 0 < m < n:
                best = max(best, abs(hits / m - (d - hits) / (n - m)) / math.sqrt(p * (1 - p) * (1 / m + 1 / (n - m))))
        score[w] = best
    chosen = sorted(sorted((w for w in df if df[w] >= 6), key=lambda w: (-score[w], w))[:192])
    x = np.array([[w in f for w in chosen] for f, _ in rows], float)
    every = np.array([[w in f for w in chosen] for f in map(seen, texts)], float)
    guess = lambda w, x: 1 / (1 + np.exp(-(np.c_[x, np.ones(len(x))] @ w)))
    for k in range(3):  # a category's probability is a feature of the next ones: out of fold in training, the model's own in use
        out, fold = np.zeros(n), np.arange(n) % 3
        for f in range(3):
            out[fold == f] = guess(plain_logistic(x[fold != f], y[fold != f, k]), x[fold == f])
        p = guess(plain_logistic(x, y[:, k]), every)
        x, every = np.c_[x, out], np.c_[every, p]
    return every[:, -3:]


def test_toxicity_chain_equals_plain_fit(spark):
    pytest.importorskip("public_tokenizers")
    from .test_pipeline import fixture_rows

    rows, _, labels, _ = fixture_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marks = {i: t for i, _, t in labels}
    want = plain_chain([t for _, t, *_ in rows], [marks.get(i) for i, *_ in rows])
    chain = toxicity.train_on(docs, known)
    assert chain.categories == ["insult", "contempt", "toxic"] and len(chain.words) > 100
    got = np.array([tuple(r) for r in toxicity.classify(docs, chain).orderBy("doc_id").select("p_insult", "p_contempt", "p_toxic").collect()])
    assert np.abs(got - want).max() < 1e-6
    assert np.ptp(got, axis=0).min() > 0.5
