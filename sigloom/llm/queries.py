"""The operators' registered queries over the tables of ``sf_dir``, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, decontaminate, divergence, fim, licenses, metric_join, packing, quality, simhash, token_counts, token_output, toxicity, urls, warc

#: The url rules of the contract, as (host, path prefix, verdict).
URL_RULES = [("com", "en/", "block"), ("example.com", "en/7", "allow"), ("net", "de/", "allow"), ("example.net", "de/8", "block"), ("org", "es/", "block")]
TOKEN_LIMIT = 1024
PACK_END_ID, OUTPUT_END_ID = 0, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=PACK_END_ID)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train_on(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.classify(docs.select("doc_id", "text"), chain)
    return scored.drop("text").withColumn("kept", ~F.col("toxic"))


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES).drop("url")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer("byte_bpe_50k.json"), public_tokenizers.PATTERN, TOKEN_LIMIT).drop("text")


def op9_token_ids_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "token-ids")
    token_output.write_orc(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), OUTPUT_END_ID)
    return token_output.digest(token_output.read_orc(spark, path))


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_best_fit_packing, op2_license_scan, op3_benchmark_decontamination, op4_simhash_near_dedup, op5_quality_rules, op6_toxicity_chain, op7_url_templates, op8_token_counts, op9_token_ids_orc, op10_warc_archive, op11_fill_in_middle, op12_embedding_near_dedup, op13_source_divergence, pipeline]
    return {f.__name__: f for f in found}


#: Levels that the SQL unrolls; it fails on a table with longer paths.
_SQL_LEVELS = 8


def _url_sql() -> str:
    """The template tree as one chain of common table expressions, with the same formulas as ``urls``. The contract's rules stand here once more, the longest first."""
    spam = " or ".join(f"contains(host, '{s}')" for s in urls.SPAM_HOSTS)
    steps = [
        "u as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages)",
        """r as (select *, case when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/7') then 'example.com/en/7'
            when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/de/8') then 'example.net/de/8'
            when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/en/') then 'com/en/'
            when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/de/') then 'net/de/'
            when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/es/') then 'org/es/' end as rule from u)""",
        "p as (select *, case rule when 'com/en/' then 'block' when 'example.com/en/7' then 'allow' when 'net/de/' then 'allow' when 'example.net/de/8' then 'block' when 'org/es/' then 'block' end as rule_verdict, list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda x: x <> '') as parts from r)",
        f"l as (select *, case when len(parts) > {_SQL_LEVELS} then error('a path has more segments than the SQL has levels') else parts end as shape, case when rule_verdict = 'block' then 1 when rule_verdict = 'allow' then 0 when {spam} then 1 end as bad from p)",
        "t0 as materialized (select host, shape, shape as template, count(*) as n, count(*) filter (bad = 1) as bad, count(*) filter (bad = 0) as good from l group by host, shape)",
    ]
    name = "t0"
    for k in range(_SQL_LEVELS):
        steps.append(f"w{k} as (select host as h, template[1:{k}] as node from {name} where len(template) > {k} group by 1, 2 having count(distinct template[{k + 1}]) > {urls.MAX_CHILDREN})")
        steps.append(f"x{k} as materialized (select host, shape, case when w.h is not null then list_concat(list_append(template[1:{k}], '*'), template[{k + 2}:]) else template end as template, n, bad, good from {name} t left join w{k} w on t.host = w.h and t.template[1:{k}] = w.node and len(t.template) > {k})")
        name = f"x{k}"
    for k in reversed(range(_SQL_LEVELS)):
        steps += [
            f"a{k} as (select host as h, template[1:{k}] as node, template[{k + 2}:] as below, template[{k + 1}] as seg, sum(n) as n, (sum(bad) + 0.5::double) / (sum(n) + 1.0::double) as share from {name} where len(template) > {k} group by 1, 2, 3, 4)",
            f"b{k} as (select *, coalesce(share - lag(share) over o > 2 * sqrt(share * (1 - share) / (n + 1.0::double) + lag(share * (1 - share) / (n + 1.0::double)) over o), false)::int as new from a{k} window o as (partition by h, node, below order by share, seg))",
            f"c{k} as (select *, sum(new) over (partition by h, node, below order by share, seg) as class from b{k})",
            f"d{k} as (select h, node, below, seg, list_aggregate(list_sort(list(seg) over (partition by h, node, below, class)), 'string_agg', '|') as name from c{k})",
            f"y{k} as materialized (select host, shape, case when d.h is not null then list_concat(list_append(template[1:{k}], d.name), template[{k + 2}:]) else template end as template, n, bad, good from {name} t left join d{k} d on t.host = d.h and t.template[1:{k}] = d.node and t.template[{k + 2}:] = d.below and t.template[{k + 1}] = d.seg and len(t.template) > {k})",
        ]
        name = f"y{k}"
    steps.append(f"tp as (select host, template, (sum(good) + {urls.STRENGTH * urls.NEUTRAL}::double) / (sum(good) + sum(bad) + {urls.STRENGTH}::double) as purity from {name} group by 1, 2)")
    return f"""with {", ".join(steps)}
        select page_id, l.host, path, rule, coalesce(rule_verdict, case when purity < {urls.LEAST_PURITY} then 'block' else 'allow' end) as verdict,
               '/' || array_to_string(m.template, '/') as template, round(purity, 6) as purity
        from l join {name} m on l.host = m.host and l.shape = m.shape join tp on m.host = tp.host and m.template = tp.template"""


_WARC_SQL = """with p as (select page_id, coalesce(html, '') as body from pages),
    d as (select page_id, sha1(body) as hex, strlen(body)::bigint as payload_bytes from p),
    b as (select *, list_aggregate(list_transform(range(1, 41), lambda i: right('000' || bin(('0x' || substr(hex, i, 1))::int), 4)), 'string_agg', '') as bits,
                 max(page_id) over (partition by hex) as largest from d)
    select page_id, payload_bytes,
           list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::int + 8 * substr(bits, 5 * i + 2, 1)::int
             + 4 * substr(bits, 5 * i + 3, 1)::int + 2 * substr(bits, 5 * i + 4, 1)::int + substr(bits, 5 * i + 5, 1)::int, 1)), 'string_agg', '') as payload_digest,
           case when page_id = largest then 'response' else 'revisit' end as record_type,
           case when page_id = largest then null else largest end as refers_to
    from b"""


_FIM_SQL = r"""with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u, sha256('42:' || doc_id) as h from documents),
    r as (select *, len(u)::bigint as n, ('0x' || h[1:8])::bigint % (len(u) + 1) as c1, ('0x' || h[9:16])::bigint % (len(u) + 1) as c2, ('0x' || h[17:24])::bigint % 100 as h3, ('0x' || h[25:32])::bigint % 100 as h4 from d),
    f as (select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 >= 50 then 'plain' when h4 < 80 then 'spm' else 'psm' end as form, least(c1, c2) as lo, greatest(c1, c2) as hi from r),
    p as (select *, array_to_string(u[1:lo], '') as prefix, array_to_string(u[lo + 1:hi], '') as middle, array_to_string(u[hi + 1:], '') as suffix from f)
    select doc_id, n, form, case when form <> 'plain' then length(prefix)::bigint end as prefix_chars, case when form <> 'plain' then length(middle)::bigint end as middle_chars,
           sha256(case form when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else t end) as output_sha256, sha256(t) as restored_sha256
    from p"""


_DIVERGENCE_SQL = r"""with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
        unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), null)) as term from documents),
    grp as (select distinct lang, source from d),
    w as (select lang, term, count(*)::hugeint as total from d where term is not null group by all having count(distinct row) >= 3),
    c as (select d.lang, d.source, d.term, count(*)::hugeint as n from d join w on d.lang = w.lang and d.term = w.term group by all),
    l as (select lang, count(*)::hugeint as v, sum(total)::hugeint as nl from w group by lang),
    m as (select lang, source, sum(n)::hugeint as ng from c group by all),
    p as (select g.lang, g.source, w.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (coalesce(m.ng, 0) + l.v) as p, 1 + 1000000000::hugeint * (w.total + 1) // (l.nl + l.v) as q
          from grp g join l on g.lang = l.lang join w on g.lang = w.lang left join m on g.lang = m.lang and g.source = m.source left join c on g.lang = c.lang and g.source = c.source and w.term = c.term),
    pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
    every as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value from grp a join grp b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
              union all select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p where n > 0 and p > q),
    ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from every)
    select * from ranked where part = 'pair' or rank <= 200"""


def oracle_sql() -> dict[str, str]:
    return {"op7_url_templates": _url_sql(), "op10_warc_archive": _WARC_SQL, "op11_fill_in_middle": _FIM_SQL, "op13_source_divergence": _DIVERGENCE_SQL}
