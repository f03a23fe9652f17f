"""The corpus pipeline against a plain, single-process version of each stage, and every operator on the defined edge cases."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from sigloom.llm import decontaminate, licenses, packing, quality, queries, simhash, token_counts, token_output, toxicity, urls, warc  # noqa: E402

from .test_dedup_and_warc import brute_components, brute_print  # noqa: E402
from .test_filters import brute_counts, brute_leaks  # noqa: E402

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def posterior_by_document(texts):
    """EM with a row per document: what the operator does on counts of vote patterns."""
    votes = []
    for t in texts:
        counts = dict(zip(quality._COUNTS + quality._MORE, quality.measure(t), strict=True))
        assert [counts[k] for k in quality._COUNTS] == brute_counts(t)
        votes.append([rule(counts) for rule in quality.RULES.values()])
    p = np.array([(v.count(1) + 1) / (v.count(1) + 2 * v.count(0) + 2) for v in votes])
    prior = {1: {1: 8, 0: 1, 2: 1}, 0: {1: 2, 0: 4, 2: 2}}
    for _ in range(200):
        share, odds = (p.sum() + 2) / (len(p) + 4), np.zeros(len(p))
        for rule in range(len(quality.RULES)):
            mine = [v[rule] for v in votes]
            for k, weight, sign in ((1, p, 1), (0, 1 - p, -1)):
                mass = {v: prior[k][v] + sum(w for w, x in zip(weight, mine, strict=True) if x == v) for v in range(3)}
                odds += sign * np.log([mass[v] / sum(mass.values()) for v in mine])
        p = 1 / (1 + np.exp(-(odds + np.log(share / (1 - share)))))
    return p


def fixture_rows():
    rng = random.Random(21)
    vocabulary = [f"term{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rng.randrange(15, 40))) for i in range(25)] + [(40, None), (41, "")]
    texts, truth = [], {"toxic": set(), "leak": {}, "copy": {}, "junk": set()}
    for i in range(260):
        kind = i % 13
        if kind == 3:
            ws = prose(120).split()
            for _ in range(4):
                ws[rng.randrange(len(ws))] = rng.choice(["idiot", "stupid", "moron", "pathetic"])
            truth["toxic"].add(i)
            texts.append(" ".join(ws))
        elif kind == 5:
            item = rng.randrange(25)
            truth["leak"][i] = item
            texts.append(f"{prose(80)} {items[item][1]} {prose(60)}")
        elif kind == 7:
            truth["copy"][i] = i - 1
            texts.append(texts[i - 1].upper() if i % 2 else texts[i - 1])
        elif kind == 9:
            truth["junk"].add(i)
            texts.append(rng.choice([None, "", "#$% " * 70, "buy now\n" * 60, prose(12)]))
        else:
            texts.append(prose(rng.choice([90, 200, 600, 4000 if i == 14 else 300])))
    docs = [(i, t, None if i % 17 == 0 else "en", None if i % 5 == 0 else "web", None if t is None else len(t)) for i, t in enumerate(texts)]
    labels = [(i, int(i not in truth["junk"]), int(i in truth["toxic"])) for i in range(260) if i % 4] + [(None, 1, 1), (9999, 1, 1)]
    return docs, items, labels, truth


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, items, labels, truth = fixture_rows()
    sf = str(tmp_path)
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, texts, got = spark.read.parquet(f"{sf}/documents.parquet"), {r[0]: r[1] for r in rows}, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf)
        made.write.parquet(f"{sf}/stage-{name}")
        docs = spark.read.parquet(f"{sf}/stage-{name}")
        if name != "packing":
            assert sorted(docs.dtypes) == sorted(spark.createDataFrame([], DOCUMENTS).dtypes)
            kept = sorted(tuple(r) for r in docs.collect())
            got[name] = [r[0] for r in kept]
            assert {r[0]: r for r in kept} == {r[0]: r for r in rows if r[0] in set(got[name])}  # rows are kept as they were

    p = posterior_by_document(list(texts.values()))
    counts = {i: brute_counts(t) for i, t in texts.items()}
    failed = {i for i, c in counts.items() if c[0] < 50 or 100 * c[4] > 50 * c[0]}
    assert got["quality"] == [i for i in texts if i not in failed and p[i] >= quality.KEEP_AT]
    assert not set(got["quality"]) & truth["junk"] and len(got["quality"]) == 260 - len(truth["junk"])

    chain = toxicity.train_on(spark.createDataFrame([(i, texts[i]) for i in got["quality"]], "doc_id long, text string"), spark.read.parquet(f"{sf}/labels.parquet"))
    clean = []
    for i in got["quality"]:
        found, said = toxicity.features(texts[i]), []
        for k in range(len(chain.categories)):
            z = chain.intercepts[k] + sum(chain.weights[k, j] for j, w in enumerate(chain.words) if w in found) + sum(chain.links[k, e] * said[e] for e in range(k))
            said.append(1 / (1 + np.exp(-z)))
        clean += [i] if said[-1] < toxicity.TOXIC_AT else []
    assert got["toxicity"] == clean == [i for i in got["quality"] if i not in truth["toxic"]]

    root = brute_components({i: brute_print(texts[i]) for i in clean})
    assert got["near_duplicates"] == sorted(set(root.values()))
    assert all(c not in got["near_duplicates"] for c, of in truth["copy"].items() if of in clean)

    shard = next(decontaminate.shards(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", None))
    assert got["decontamination"] == [i for i in got["near_duplicates"] if not any(brute_leaks(x, texts[i]) for x in shard.indexes)]
    assert got["decontamination"] == [i for i in got["near_duplicates"] if i not in truth["leak"]]

    from tokenizers import Tokenizer

    lib, pieces = Tokenizer.from_file(P.path("word_bpe_49k.json")), docs.toPandas()
    want, lengths = set(), []
    for i in got["decontamination"]:
        ids = [*lib.encode(texts[i], add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.asarray(ids[at : at + 2048], "<u4")
            lengths.append(len(part))
            want.add((i, k, at, len(part), zlib.crc32(part.tobytes())))
    assert set(pieces[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want and len(pieces) == len(want)
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    rooms = []
    for n in sorted(lengths, reverse=True):  # first-fit-decreasing
        k = next((k for k, r in enumerate(rooms) if r >= n), None)
        if k is None:
            rooms.append(2048 - n)
        else:
            rooms[k] -= n
    assert packing.lower_bound(Counter(lengths), 2048) <= pieces.sequence_id.nunique() <= len(rooms)
    assert sorted(map(str, corpus_pipeline.run(spark, sf).drop("sequence_id", "offset").collect())) == sorted(map(str, docs.drop("sequence_id", "offset").collect()))


def test_stages_of_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{sf}/embeddings.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
    for name, query in queries.queries().items():
        if name not in ("op7_url_templates", "op10_warc_archive"):
            assert query(spark, sf).count() == 0, name


#: Names that operators use for their own columns.
CLASHING = ["fp", "rep", "root", "votes", "p_good", "Kept", "toxic", "p_insult", "N_Tokens", "length", "piece", "start", "bucket", "ids", "shard", "digest", "refers_to", "payload", "host", "Rule", "template", "score", "item_id", "license", "y", "word", "key", "n", "count"]
EDGES = [(None, None), (None, "only words here"), (1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, " "), (5, "x"), (6, "same words in both rows"), (6, "same words in both rows"), (7, "same words in both rows"), (8, "ẃ \U0001f600   é"), (9, "long words " * 30_000), (10, "z" * 200_000), (11, "\x00 nul")]


def edges(spark, id_name, text_name):
    clash = [c for c in CLASHING if c.lower() not in (id_name, text_name)]
    rows = [(i, t, *([None] * len(clash) if k % 2 else ["own"] * len(clash))) for k, (i, t) in enumerate(EDGES)]
    return spark.createDataFrame(rows, f"{id_name} long, {text_name} string, " + ", ".join(f"`{c}` string" for c in clash))


def ids_of(df, name="doc_id"):
    return Counter(r[0] for r in df.select(name).collect())


def test_edge_rows_of_every_operator(spark, tmp_path):
    d, every = edges(spark, "doc_id", "text"), Counter(i for i, _ in EDGES)
    words, bytes_ = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
    first = packing.pack(d, words).where("piece = 0")
    assert ids_of(first) == every
    assert ids_of(simhash.near_duplicates(d)) == every
    assert ids_of(quality.score(d)) == every
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, None)], "doc_id long, toxic int")
    assert ids_of(toxicity.classify(d, toxicity.train_on(d, labels))) == every
    counted = token_counts.count_tokens(d, bytes_, P.PATTERN, 1024)
    assert ids_of(counted) == every and len({c.lower() for c in counted.columns}) == len(counted.columns)
    token_output.write_orc(d, f"file://{tmp_path}/orc", words, 2)
    assert ids_of(token_output.digest(token_output.read_orc(spark, f"file://{tmp_path}/orc"))) == every
    assert licenses.scan(d).count() == 0
    items = spark.createDataFrame([(None, None, "x"), (1, "", None), (2, "same words in both rows", "x"), (2, "same words in both rows", "y")], "item_id long, text string, score string")
    assert set(ids_of(decontaminate.find_leaks(d, items))) == {6, 7}
    pages = d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").selectExpr("*", "html as url")
    warc.write_warc(pages, f"file://{tmp_path}/warc")
    assert ids_of(warc.read_warc(spark, f"file://{tmp_path}/warc"), "page_id") == every
    assert ids_of(urls.judge(pages, queries.URL_RULES), "page_id") == every
    for keep in (quality.keep_good, simhash.drop_near_duplicates, lambda x: decontaminate.drop_leaks(x, items), lambda x: toxicity.drop_toxic(x, toxicity.train_on(x, labels))):
        assert keep(d).columns == d.columns
        assert set(ids_of(keep(d))) <= set(every)


def test_one_document_of_each_group_stays_where_ids_repeat(spark):
    """Rows with the same id and different texts are different documents."""
    t = [" ".join(f"{c}{i}" for i in range(70)) for c in "abc"]
    d = spark.createDataFrame([(1, t[0]), (3, t[0]), (3, t[1]), (5, t[1]), (5, t[2]), (5, t[2]), (None, t[2])], "doc_id long, text string")
    kept = sorted((r.doc_id or -1, r.text[0]) for r in simhash.drop_near_duplicates(d).collect())
    assert kept == [(-1, "c"), (1, "a"), (3, "b"), (5, "c")]




def test_queries_of_whole_tables_equal_brute_force(spark, tmp_path):
    """Each ``opN_`` query over the smallest tables, as registered."""
    import base64
    import hashlib

    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").toPandas()
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    run = lambda name: queries.queries()[name](spark, sf).toPandas()
    words, bytes_ = (Tokenizer.from_file(P.path(f)) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    crc = lambda ids: zlib.crc32(np.asarray(ids, "<u4").tobytes())
    ids = {d: words.encode(t or "", add_special_tokens=False).ids for d, t in texts.items()}

    got, want = run("op1_best_fit_packing"), set()
    for d, x in ids.items():
        x = [*x, 0]
        want |= {(d, k, at, len(x[at : at + 2048]), crc(x[at : at + 2048])) for k, at in enumerate(range(0, len(x), 2048))}
    assert set(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want and len(got) == len(want)
    sequences = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert all(s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048 for _, s in sequences)
    assert got.sequence_id.nunique() == packing.lower_bound(Counter(got.length), 2048)

    found = {(r.doc_id, r.license) for r in run("op2_license_scan").itertuples()}
    for d, t in texts.items():  # a notice that stands in the text word by word is found
        plain = f" {' '.join(licenses.words(t))} "
        here = {n for n, x in licenses.NOTICES.items() if f" {' '.join(licenses.words(x))} " in plain}
        assert here <= {n for e, n in found if e == d}, d

    prints = {d: brute_print(t) for d, t in texts.items()}
    root = brute_components(prints)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in run("op4_simhash_near_dedup").itertuples()} == {(d, f"{f:016x}", root[d]) for d, f in prints.items()}

    for r, p in zip(run("op5_quality_rules").sort_values("doc_id").itertuples(), posterior_by_document(list(texts.values())), strict=True):
        n_words, chars, symbols, dup, repeat = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, chars, symbols, dup, repeat)
        base = n_words < 50 or 100 * repeat > 50 * n_words
        assert (r.base_failed, r.kept) == (base, not base and p >= 0.5) and abs(r.p_good - p) < 1e-6

    counts = run("op8_token_counts").set_index("doc_id")
    for d, t in texts.items():
        n = len(bytes_.encode(t or "", add_special_tokens=False).ids)
        assert tuple(counts.loc[d, ["n_bytes", "n_tokens", "over_limit"]]) == (len((t or "").encode()), n, n > 1024)

    start = 0
    for r in run("op9_token_ids_orc").sort_values("doc_id").itertuples():
        x = [*ids[r.doc_id], 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(x), crc(x))
        start += len(x)

    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas()
    bodies = {p: (h or "").encode() for p, h in zip(pages.page_id, pages.html, strict=True)}
    largest: dict[bytes, int] = {}
    for p, b in bodies.items():
        largest[b] = max(p, largest.get(b, p))
    for r in run("op10_warc_archive").itertuples():
        b = bodies[r.page_id]
        to = None if largest[b] == r.page_id else largest[b]
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r.record_type, None if r.refers_to != r.refers_to else r.refers_to) == ("response" if to is None else "revisit", to)
