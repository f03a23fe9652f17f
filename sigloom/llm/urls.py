"""URL filters: explicit rules, then a path-template tree per host learned from labelled urls.

A rule is (host, path prefix, block or allow); it fits its host and all subdomains, and the longest one that fits
decides. Every other url is judged by its template:

1. Segments of the path become shapes: digits are ``#``, so ``/en/825.html`` is ``en/#.html``. Paths are taken whole.
2. Per host the shapes form a tree. A segment place with more than ``MAX_CHILDREN`` different children becomes ``*``.
   The tree is grown level by level, at those levels alone at which some host has that many different segments.
3. From the deepest level up, siblings whose share of bad urls differs by less than two standard errors
   from the next one's (in order of that share) are merged, so like branches pool their labels. Levels at which no node has two children
   are passed over; one job finds those of either kind, so the number of jobs grows with the levels that can decide something alone.
4. A template's purity is its share of good labels, smoothed with ``STRENGTH`` labels' worth of ``NEUTRAL``; below
   ``LEAST_PURITY`` the template is rejected. So it takes labels of the template itself: one without labels is allowed, whatever its host's other branches are.

All of it is DataFrame functions: counts are aggregated before any shuffle, the tree holds no more
rows than there are distinct shapes, siblings are merged over distinct wildcarded templates, and hot keys of the joins back are
salted or broadcast. A null url, or one without ``://``, has an empty host and path, no rule, and the template of the empty host.
Repeated rows are judged alike; other columns are kept by ``judge`` unless named like a result column. No labels: all allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

MAX_CHILDREN = 16
LEAST_PURITY = 0.3
STRENGTH, NEUTRAL = 2.0, 0.5
#: Parts into which the shapes below one node are dealt for the join with the wildcards.
SALT = 16
#: (host, path prefix, verdict)
Rule = tuple[str, str, str]
#: Name parts that mark a host as spam; they label its urls as bad for the tree.
SPAM_HOSTS = ["casino", "pills", "ads-track", "viagra", "porn", "poker", "betting", "payday"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        text, verdict = F.when(fits, f"{h}/{p}").otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def shape_of(path: Column) -> Column:
    """The path's segments with digits as ``#``."""
    return F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda s: s != "")


def _replaced(template: Column, k: int, value: Column) -> Column:
    return F.transform(template, lambda s, i: F.when(i == k, value).otherwise(s))


def _key(host: str, segments: str) -> Column:
    """Neither holds a slash, so this tells them apart."""
    return F.concat(F.col(host), F.lit("/"), F.array_join(segments, "/"))


def wide_levels(tree: DataFrame) -> list[int]:
    """The levels at which a host has more than MAX_CHILDREN different segments: at no other can a node have as many children."""
    places = tree.select("host", F.posexplode("shape").alias("k", "seg")).distinct().groupBy("host", "k").agg(F.count("*").alias("n"))
    return sorted(r[0] for r in places.where(F.col("n") > MAX_CHILDREN).select("k").distinct().collect())


def split_levels(small: DataFrame) -> list[int]:
    """The levels at which a node has two children, by a hash of its host and the segments above; at no other can siblings be alike."""
    differ = small.select("host", F.posexplode("template").alias("k", "seg")).groupBy("host", "k").agg((F.min("seg") < F.max("seg")).alias("differ"))
    some = sorted(r[0] for r in differ.where("differ").select("k").distinct().collect())
    if not some:
        return []
    ks = F.filter(F.array(*map(F.lit, some)), lambda k: k < F.size("template"))
    node = F.transform(ks, lambda k: F.struct(k.alias("k"), F.xxhash64("host", F.slice("template", F.lit(1), k)).alias("node"), F.get("template", k).alias("seg")))
    children = small.select(F.explode(node).alias("x")).groupBy("x.k", "x.node").agg((F.min("x.seg") < F.max("x.seg")).alias("split"))
    return sorted(r[0] for r in children.where("split").select("k").distinct().collect())


def wildcards(tree: DataFrame, k: int) -> DataFrame:
    """``template`` with ``*`` at level k below the nodes that have more than MAX_CHILDREN children there."""
    node, deep = F.slice("template", 1, k), F.size("template") > k
    place = tree.where(deep).select("host", node.alias("node"), F.element_at("template", k + 1).alias("seg")).distinct()
    wide = place.groupBy("host", "node").agg(F.count("*").alias("children")).where(F.col("children") > MAX_CHILDREN)
    wide = wide.select(F.col("host").alias("w_host"), F.col("node").alias("w_node"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("w_salt"))
    there = (F.col("host") == F.col("w_host")) & (node == F.col("w_node")) & (F.pmod(F.xxhash64("shape"), F.lit(SALT)) == F.col("w_salt")) & deep
    star = F.when(F.col("w_host").isNotNull(), _replaced(F.col("template"), k, F.lit("*"))).otherwise(F.col("template"))
    return tree.join(wide, there, "left").withColumn("template", star).drop("w_host", "w_node", "w_salt")


def merged(small: DataFrame, k: int) -> DataFrame:
    """``merged`` with the joint name, at level k, of siblings that are alike."""
    node, seg, below = F.slice("merged", 1, k), F.get("merged", F.lit(k)), F.slice("merged", k + 2, F.greatest(F.size("merged"), F.lit(1)))
    branch = small.where(F.size("merged") > k).groupBy("host", node.alias("node"), below.alias("below"), seg.alias("seg")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    branch = branch.withColumn("share", (F.col("bad") + 0.5) / (F.col("n") + 1.0))
    # Siblings with the same place and the same segments below: at most MAX_CHILDREN, and the wildcard.
    order = Window.partitionBy("host", "node", "below").orderBy("share", "seg")
    error = F.col("share") * (1 - F.col("share")) / (F.col("n") + 1.0)
    apart = F.col("share") - F.lag("share").over(order) > 2 * F.sqrt(error + F.lag(error).over(order))
    branch = branch.withColumn("new", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("class", F.sum("new").over(order))
    names = Window.partitionBy("host", "node", "below", "class")
    name = F.array_join(F.sort_array(F.collect_set("seg").over(names)), "|").alias("name")
    found = branch.select(F.col("host").alias("m_host"), F.col("node").alias("m_node"), F.col("below").alias("m_below"), F.col("seg").alias("m_seg"), name)
    at = (F.col("host") == F.col("m_host")) & (node == F.col("m_node")) & (below == F.col("m_below")) & (seg == F.col("m_seg"))
    named = F.when(F.col("name").isNotNull(), _replaced(F.col("merged"), k, F.col("name"))).otherwise(F.col("merged"))
    return small.join(found, at, "left").withColumn("merged", named).drop("m_host", "m_node", "m_below", "m_seg", "name")


def templates(urls: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(key, template, purity) of every distinct host and shape of ``urls`` (host, shape, bad); (key, n) of them; and the number of urls."""
    bad, good = F.sum((F.col("bad") == 1).cast("long")), F.sum((F.col("bad") == 0).cast("long"))
    counted = urls.groupBy("host", "shape").agg(F.count("*").alias("n"), F.coalesce(bad, F.lit(0)).alias("bad"), F.coalesce(good, F.lit(0)).alias("good"))
    tree = common.materialise(counted.withColumn("template", F.col("shape")), "url-shapes")
    for k in wide_levels(tree):  # from the root down
        tree = common.materialise(wildcards(tree, k), "url-wildcards")
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "good")]
    small = common.materialise(tree.groupBy("host", "template").agg(*sums).withColumn("merged", F.col("template")), "url-templates")
    for k in reversed(split_levels(small)):
        small = common.materialise(merged(small, k), "url-merged")
    purity = (F.col("good") + STRENGTH * NEUTRAL) / (F.col("good") + F.col("bad") + STRENGTH)
    pooled = small.groupBy("host", "merged").agg(*sums).select(F.col("host").alias("p_host"), F.col("merged").alias("p_merged"), purity.alias("purity"))
    judged = small.join(pooled, (F.col("host") == F.col("p_host")) & (F.col("merged") == F.col("p_merged")))
    judged = judged.select(_key("host", "template").alias("of"), F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), "purity")
    shapes = tree.select(_key("host", "shape").alias("key"), _key("host", "template").alias("of"), "n")
    total, n_shapes = tree.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    found = common.join_unique(shapes, judged, "of", shapes.groupBy("of").agg(F.count("*").alias("n")), n_shapes)
    found = common.materialise(found.select("key", "template", "purity"), "url-purity")
    return found, shapes.select("key", "n"), total


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", spam_hosts: list[str] | None = None) -> DataFrame:
    """Add host, path, rule, verdict, template and purity. Labels: the rules' verdicts, and bad where the host has a spam name."""
    names = ["host", "path", "rule", "verdict", "template", "purity"]
    own = common.without(pages, [n for n in names if n.lower() != url.lower()])
    # A fixed number of rules: each is a condition of one expression.
    host, path = host_of(F.col(url).cast("string")), path_of(F.col(url).cast("string"))
    own = own.select(*[F.col(c).alias(f"__own_{i}") for i, c in enumerate(own.columns)], host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": rule, "rule_verdict": verdict, "shape": shape_of(F.col("path"))})
    spam = reduce(Column.__or__, [F.col("host").contains(s) for s in (SPAM_HOSTS if spam_hosts is None else spam_hosts)], F.lit(False))
    bad = F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0).when(spam, 1)
    found, counts, total = templates(own.select("host", "shape", bad.alias("bad")))
    out = common.join_unique(own.withColumn("key", _key("host", "shape")), found, "key", counts, total)
    learned = F.when(F.col("purity") < LEAST_PURITY, "block").otherwise("allow")
    kept = [c for c in pages.columns if c.lower() not in names or c.lower() == url.lower()]
    return out.select(*[F.col(f"__own_{i}").alias(c) for i, c in enumerate(kept)], "host", "path", "rule", F.coalesce("rule_verdict", learned).alias("verdict"), "template", F.round("purity", 6).alias("purity"))
