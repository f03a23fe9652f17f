import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.llm import decontaminate, licenses, quality, queries, toxicity, urls


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, votes int")


# --- quality


def brute_counts(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    tri = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    c = Counter(tri)
    rep = {j for i, w in enumerate(tri) if c[w] > 1 for j in range(i, i + 3)}
    return [len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep)]


CASES = [None, "", " \n\t ", "one", "a b c a b c", "a a a a a", "x\ny\nx\n\n  \n  ", "é\u00a0è # $ |", "The cat sat on the mat. " * 30, "line one\r\nline one\r\nz", "w " * 60]


def test_quality_counts(spark):
    rows = quality.score(docs(spark, CASES)).orderBy("doc_id").collect()
    for r, t in zip(rows, CASES, strict=True):
        got = brute_counts(t)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == got
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (r.base_failed and r.kept)
    assert quality.score(docs(spark, [])).count() == 0
    assert quality.keep_good(docs(spark, CASES)).columns == ["doc_id", "text", "votes"]
    assert quality.keep_good(docs(spark, [])).count() == 0


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.7
    rate = [0.9, 0.85, 0.8, 0.95, 0.7, 0.9, 0.75]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.2, 2, np.where(rng.random(len(truth)) < r, truth, ~truth)) for r in rate], 1)
    codes = (votes * 3 ** np.arange(6, -1, -1)).sum(1)
    c, n = np.unique(codes, return_counts=True)
    p, given = quality.estimate(c, n)
    said = p[np.searchsorted(c, codes)] >= 0.5
    assert (said == truth).mean() > 0.95
    for k, r in enumerate(rate):
        assert abs(given[1, k, 1] / (given[1, k, 1] + given[1, k, 0]) - r) < 0.03


# --- toxicity


def test_toxicity_held_out(spark):
    rng = random.Random(5)
    calm = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(900):
        ws = [rng.choice(calm) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            ws[rng.randrange(60)] = rng.choice(["idiot", "stupid", "grimmor" + rng.choice("abcdefgh")])
        rows.append((i, " ".join(ws), int(toxic)))
    d = spark.createDataFrame([r[:2] for r in rows] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 600] + [(None, 1), (7000, 1), (3, None)], "doc_id long, toxic int")
    chain = toxicity.train_on(d, labels)
    assert chain.categories == ["insult", "contempt", "toxic"] and np.abs(chain.links[2, :2]).sum() > 0
    out = {r.doc_id: r for r in toxicity.classify(d, chain).collect()}
    right = sum(out[i].toxic == bool(y) for i, _, y in rows if i >= 600)
    assert right >= 294
    assert not out[5000].toxic and not out[5001].toxic
    assert toxicity.drop_toxic(d, chain).columns == d.columns
    empty = toxicity.train_on(d, labels.limit(0))
    assert toxicity.classify(d, empty).where("toxic").count() == 0


# --- licenses


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_patience_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghijkl") for _ in range(rng.randrange(0, 25))] for _ in range(2))
        got = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x < u and y < v for (x, y), (u, v) in zip(got, got[1:], strict=False))
        assert len(got) <= lcs(a, b)
    same = list("abcabcddbca")
    assert len(licenses.align(same, same)) == len(same)


def test_license_scan(spark):
    rng = random.Random(4)
    filler = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    planted, texts = {}, [None, "", "!!!", filler(30), "the license " * 50]
    for name, notice in licenses.NOTICES.items():
        for change in (False, True):
            ws = notice.split()
            if change and len(ws) > 8:
                ws[len(ws) // 2] = "zzz"
            planted[len(texts)] = name
            texts.append(f"{filler(rng.randrange(400))} {' '.join(ws)} {filler(rng.randrange(400))}")
    planted[len(texts)] = "Apache-2.0"
    texts.append(filler(50_000) + " " + licenses.NOTICES["Apache-2.0"])
    rows = licenses.scan(docs(spark, texts)).collect()
    assert sorted((r.doc_id, r.license) for r in rows) == sorted(planted.items())
    for r in rows:  # the coverage is that of the best possible alignment at the place found
        ws, notice = licenses.words(texts[r.doc_id]), licenses.words(licenses.NOTICES[r.license])
        assert r.coverage == pytest.approx(lcs(ws[r.first_word : r.first_word + r.n_words], notice) / len(notice))


def test_notices_are_found_behind_strays_of_their_words():
    table = [(n, licenses.words(t)) for n, t in licenses.NOTICES.items()]
    for name, notice in table:
        for stray in (notice[0], notice[-1]):
            for d in range(0, 2 * len(notice) + 1, 3):
                for pad in range(0, len(notice), 4):
                    ws = [*["x"] * pad, stray, *["x"] * d, *notice, *["x"] * d, stray, *["x"] * 9]
                    got = licenses.find(" ".join(ws), table)
                    assert [(g[0], g[1]) for g in got] == [(name, 1.0)], (name, stray, d, pad)


def test_a_notice_is_found_after_a_longer_one_that_holds_its_words():
    table = [(n, licenses.words(t)) for n, t in licenses.NOTICES.items()]
    by, nc, sa = (licenses.NOTICES[f"CC-BY-{x}4.0"] for x in ("", "NC-", "SA-"))
    for longer, name in ((nc, "CC-BY-NC-4.0"), (sa, "CC-BY-SA-4.0")):
        for gap in ("", "x " * 3, "x " * 40):
            got = licenses.find(f"{longer} {gap}{by} {by}", table)
            at = 7 + len(gap.split())
            assert got == [("CC-BY-4.0", 1.0, at, 6), (name, 1.0, 0, 7)]
            assert licenses.find(f"{by} {gap}{longer}", table) == [("CC-BY-4.0", 1.0, 0, 6), (name, 1.0, at - 1, 7)]
    assert licenses.find(nc, table) == [("CC-BY-NC-4.0", 1.0, 0, 7)]


# --- decontamination


def brute_leaks(index, text):
    """Every passage against every item, without the index's bounds."""
    ws, best = decontaminate.words(text), {}
    step = index.span
    weights = {}
    for t in range(len(index.keys)):
        for i, w in zip(index.items[t], index.weights[t], strict=True):
            weights[int(i), int(index.keys[t])] = w
    for start in range(0, max(1, len(ws) - step), step):
        part = ws[start : start + 2 * step]
        keys = {index.words[a] * len(index.words) + index.words[b] for a, b in zip(part, part[1:], strict=False) if a in index.words and b in index.words}
        there = decontaminate.triples_of(part) | set(decontaminate.pairs_of(part)) | {(w,) for w in part}
        for i, (q, a) in enumerate(index.parts):
            score = sum(weights.get((i, k), 0) for k in keys)
            shares = [len(p & there) / len(p) if p else 1.0 for p in (q, a)]
            if score >= decontaminate.THRESHOLD - 1e-9 and min(shares) >= decontaminate.OVERLAP:
                best[index.ids[i]] = max(best.get(index.ids[i], (0, 0, 0)), (score, *shares))
    return {i: tuple(np.round(x, 9)) for i, x in best.items()}


def test_wand_equals_scoring_everything():
    rng = random.Random(9)
    for _ in range(40):
        vocab = [f"t{i}" for i in range(rng.choice([4, 12, 60]))]
        items = []
        for i in range(rng.randrange(1, 150)):
            q, a = decontaminate.parts(" ".join(rng.choice(vocab) for _ in range(rng.randrange(2, 15))))
            items.append((i, q, a))
        df = Counter(p for _, q, a in items for p in set(decontaminate.pairs_of(q + a)))
        index = decontaminate.Index(items, df, len(items), 8.0)
        for threshold in (0.2, 0.5, 0.9):
            keys = rng.sample(range(len(index.keys)), min(len(index.keys), rng.randrange(1, 25)))
            total = Counter()
            for t in keys:
                for i, w in zip(index.items[t], index.weights[t], strict=True):
                    total[int(i)] += w
            want = {i: round(s, 9) for i, s in total.items() if s >= threshold - 1e-9}
            assert {i: round(s, 9) for i, s in index.search(sorted(keys), threshold)} == want


def test_leaks(spark):
    rng = random.Random(11)
    words = [f"q{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(12, 50))) for i in range(60)] + [(60, None), (61, "one"), (62, "")]
    texts = [None, "", "...", text(2000)]
    planted = set()
    for i in range(40):
        planted.add((len(texts), i))
        leak = items[i][1].upper() if i % 2 else items[i][1].replace(" ", ", ")
        texts.append(f"{text(rng.randrange(300))} {leak}. {text(rng.randrange(300))}")
    texts.append(" ".join(items[50][1].split()[:4]))  # the question's start only
    d = docs(spark, texts)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_leaks(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == planted
    shard = next(decontaminate.shards(b, "item_id", "text", None))
    assert [x.span for x in shard.indexes] == [16, 32, 64]
    for i, t in enumerate(texts):
        want = {k: v for x in shard.indexes for k, v in brute_leaks(x, t).items()}
        assert {r.item_id: tuple(np.round((r.score, r.question_overlap, r.answer_overlap), 9)) for r in rows if r.doc_id == i} == want
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(d, b).collect()) == sorted(set(range(len(texts))) - {i for i, _ in planted})
    assert decontaminate.find_leaks(d, b.limit(0)).count() == 0 and decontaminate.find_leaks(d.limit(0), b).count() == 0


def test_leaks_with_many_shards(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 60)
    items = [(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i}") for i in range(30)]
    d = docs(spark, [t for _, t in items] + ["alpha1 beta1 gamma1 delta1 other other"])
    rows = decontaminate.find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(i, i) for i in range(30)}


def test_shards_and_other_items_change_no_leak(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: " ".join(f"v{rng.randrange(900)}" for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([6, 9, 12, 12, 20, 33, 70, 150, 1500])]
    half = items[2][1].split()
    texts = [f"{' '.join(half[:6])} {text(900)} {' '.join(half[6:])}"]  # both halves of an item, far apart
    texts += [f"{text(rng.randrange(80))} {t} {text(rng.randrange(80))}" for _, t in items]
    d, found = docs(spark, texts), []
    for size, together in ((400_000, 4), (100, 4), (30, 1)):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", size)
        monkeypatch.setattr(decontaminate, "SHARDS_A_SCAN", together)
        found.append(sorted(map(tuple, decontaminate.find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect())))
    assert found[0] == found[1] == found[2] and {(r[0], r[1]) for r in found[0]} == {(i + 1, i) for i in range(len(items))}
    alone = decontaminate.find_leaks(d, spark.createDataFrame([items[2]], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in alone} == {(3, 2)}


# --- urls

RULES = [("com", "en/", "block"), ("example.com", "en/7", "allow"), ("net", "de/", "allow"), ("example.net", "de/8", "block"), ("org", "es/", "block")]


def test_rules_and_parts(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "no scheme/en/1": ("", "", None), "http://EXAMPLE.com": ("example.com", "", None),
        "http://a.EXAMPLE.com/en/71?q=/en/#x": ("a.example.com", "/en/71", "example.com/en/7"), "https://example.com/en/1": ("example.com", "/en/1", "com/en/"),
        "x://badexample.com/en/7": ("badexample.com", "/en/7", "com/en/"), "x://com/en/": ("com", "/en/", "com/en/"), "x://h.example.net/de/8#f": ("h.example.net", "/de/8", "example.net/de/8"),
        "x://h.net/DE/8": ("h.net", "/DE/8", None), "x://ÄB.com?u=1://z": ("Äb.com", "", None), "a://b.org/c\nd?e": ("b.org", "/c\nd", None), "x://a.com/en": ("a.com", "/en", None),
    }
    d = spark.createDataFrame([(i, u, "own") for i, u in enumerate(cases)], "page_id long, url string, Rule string")
    rows = urls.judge(d, RULES).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in rows] == list(cases.values())
    assert len(rows) == len(cases) and all(r.verdict in ("allow", "block") for r in rows)
    said = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert all(r.verdict == said[r.rule] for r in rows if r.rule) and set(RULES) == set(queries.URL_RULES)
    assert urls.judge(d.limit(0), RULES).count() == 0


def test_templates_learn_from_labels(spark):
    rows = [f"http://h.io/spam/{i}.html" for i in range(40)] + [f"http://h.io/blog/{i}" for i in range(40)]
    rows += [f"http://h.io/tag/name{chr(97 + i % 26)}{chr(97 + i // 26)}/x" for i in range(60)]
    rows += ["http://my.casino-x.io/en/1", "http://my.casino-x.io/fr/2", "http://my.casino-x.io/de/2"]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    rules = [("h.io", "spam/1", "block"), ("h.io", "blog/1", "allow")]
    out = {r.url: r for r in urls.judge(d, rules).collect()}
    assert out["http://h.io/spam/25.html"].verdict == "block" and out["http://h.io/spam/25.html"].rule is None
    assert out["http://h.io/blog/25"].verdict == "allow"
    assert out["http://h.io/tag/nameba/x"].template == "/tag/*/x"
    assert all(out[u].verdict == "block" for u in rows if "casino" in u)


def test_a_branch_without_labels_is_allowed_beside_a_blocked_one(spark):
    rows = [f"http://big.com/{lang}/{i}.html" for lang in ("en", "fr") for i in range(500)]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    for r in urls.judge(d, RULES).collect():
        assert r.verdict == ("block" if "/en/" in r.url else "allow"), r


def test_deep_paths_get_templates_of_their_own_in_spark_and_sql(spark, tmp_path):
    import duckdb

    rows = [f"http://h.com/en/a/b/c/d/{x}/{i}" for x in ("spam", "news") for i in range(20)] + [f"http://h.org/a/b/c/{x}/d/{y}/{i}" for x in ("k", "l") for y in ("es", "fr") for i in range(9)]
    rows += [f"http://h.org/es/{'x' * (i % 20 + 1)}/a/b/{i % 3}" for i in range(60)] + [None, "nothing", "http://casino.org/q/r/s/t/u/v"]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(rows)], "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    got = queries.op7_url_templates(spark, f"file://{tmp_path}").toPandas().sort_values("page_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op7_url_templates"]).df().sort_values("page_id").reset_index(drop=True)
    for c in want.columns:
        assert got[c].astype(object).where(got[c].notna(), None).tolist() == want[c].astype(object).where(want[c].notna(), None).tolist(), c
    of = dict(zip([u or "" for u in rows], got.template, strict=True))
    assert of["http://h.org/a/b/c/k/d/es/1"].split("/")[:4] == ["", "a", "b", "c"] and "*" in of["http://h.org/es/xx/a/b/1"]
    rules = [("deep.io", "a/b/c/d/e/bad/1", "block"), ("deep.io", "a/b/c/d/e/good/1", "allow")]
    deep = [f"http://deep.io/a/b/c/d/e/{x}/{i}" for x in ("bad", "good") for i in range(40)]
    out = {r.url: r for r in urls.judge(spark.createDataFrame([(i, u) for i, u in enumerate(deep)], "page_id long, url string"), rules).collect()}
    assert out[deep[30]].template != out[deep[70]].template and (out[deep[30]].verdict, out[deep[70]].verdict) == ("block", "allow")


def test_url_levels_that_decide_nothing_are_passed_over(spark, monkeypatch):
    rng = random.Random(8)
    # Levels 1 to 10 differ between the branches and never below a node; level 11 has many segments below each.
    rows = [(i, f"https://{'casino' if b == 'x' and i % 3 else 'calm'}.example/{b}/" + "/".join(f"{b}{k}" for k in "cdefghijkl") + "/s" + "".join(rng.choice("abcdefghij") for _ in range(4))) for i, b in enumerate("xyz" * 40)]
    rows += [(200 + i, "https://calm.example/" + "/".join(rng.choice("pq") for _ in range(6))) for i in range(30)] + [(300, None), (301, "https://calm.example")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = sorted(map(str, urls.judge(pages, queries.URL_RULES).collect()))
    shapes = pages.select(urls.host_of(F.col("url")).alias("host"), urls.shape_of(urls.path_of(F.col("url"))).alias("shape")).distinct()
    assert urls.wide_levels(shapes) == [11]
    assert urls.split_levels(shapes.select("host", F.col("shape").alias("template"))) == [0, 1, 2, 3, 4, 5, 11]
    assert urls.split_levels(shapes.where("size(shape) = 12").select("host", F.slice("shape", 1, 11).alias("template"))) == [0]
    monkeypatch.setattr(urls, "wide_levels", lambda tree: list(range(12)))
    monkeypatch.setattr(urls, "split_levels", lambda small: list(range(12)))
    assert sorted(map(str, urls.judge(pages, queries.URL_RULES).collect())) == got
