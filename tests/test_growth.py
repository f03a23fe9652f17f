"""What grows with the tables: spread over tasks, and bounded in each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.frame import from_array
from sigloom.operators import blocks, filters as fl, wavelets as wv
from sigloom.plans import catalog
from sigloom.sources import datasets as ds

SF = "/root/testdata/sf0.001"


def test_label_groups_are_made_by_several_tasks(spark):
    df = spark.range(400).select((F.col("id") % 40 * 3).alias("task"))
    rows = ds.label_groups(df).withColumn("made_by", F.spark_partition_id()).orderBy("label").collect()
    assert [(r.task, r.label, r.one_hot) for r in rows] == [(3 * k, k, [int(i == k) for i in range(40)]) for k in range(40)]
    assert len({r.made_by for r in rows}) > 1
    texts = ds.label_groups(df, text=True).orderBy("label").collect()
    assert [(r.task, r.label, r.one_hot) for r in texts] == [(r.task, r.label, "".join(map(str, r.one_hot))) for r in rows]
    assert [r.one_hot for r in ds.label_groups(df.where("task = 6")).collect()] == [[1]] and ds.label_groups(df.where("task < 0"), text=True).count() == 0
    assert {f.name: f.dataType.simpleString() for f in catalog.queries()["label_groups"](spark, SF).schema} == {"task": "bigint", "label": "int", "one_hot": "string"}


def plan_of(x):
    return x.df._jdf.queryExecution().executedPlan().toString()


def checked(spark, op):
    """The filter in blocks of 16 equals that of whole series, with a series whose key is null and blocks cut over several batches; no task calls Python once per block."""
    a = np.random.default_rng(2).normal(size=(40, 83))
    x = from_array(spark, a)
    x = x.to(x.df.where("channel > 3 or t < 10 * channel + 1").withColumn("channel", F.when(F.col("channel") != 39, F.col("channel"))))
    got = {(r.channel, r.t): r.value for r in op(x).df.collect()}
    sizes = {None if k == 39 else k: 83 if k > 3 else 10 * k + 1 for k in range(40)}
    want = {}
    for k, n in sizes.items():
        y = fl.run_sections(a[39 if k is None else k, :n].tolist(), op.sections, op.clamp)
        y = fl.run_sections(y[::-1], op.sections, op.clamp)[::-1] if op.both_ways else y
        want |= {(k, t): v for t, v in enumerate(y)}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-10
    assert "FlatMap" not in plan_of(op(x))


@pytest.mark.parametrize("rows", [50, 1 << 18])
def test_short_blocks_are_filtered_together(spark, monkeypatch, rows):
    monkeypatch.setattr(fl, "BLOCK_ROWS", rows)
    checked(spark, fl.bandpass(20.0, 450.0, 2048.0, order=2, block=16))


def test_many_blocks_as_one_by_one():
    rng = np.random.default_rng(3)
    sections = fl.bandpass(20.0, 450.0, 2048.0, order=1).sections
    for clamp in (True, False):
        for m, n in ((1, 1), (9, 16), (2, 500), (300, 7)):
            x, starts = rng.normal(size=(m, n)), rng.normal(size=(m, 4))
            y, ends = fl.cascades(x, sections, starts, clamp)
            for k in range(m):
                one, end = fl.cascade(x[k], sections, starts[k], clamp)
                np.testing.assert_allclose(y[k], one, atol=1e-12)
                np.testing.assert_allclose(ends[k], end, atol=1e-12)


def test_both_ways_without_the_series_lengths(spark):
    op = fl.Sections(fl.lowpass(20.0, 2048.0, 2).sections, clamp=False, both_ways=True, block=16)
    checked(spark, op)
    assert "Aggregate" not in plan_of(op(from_array(spark, np.ones((2, 40)))))


def test_clamped_low_pass_in_short_blocks(spark):
    checked(spark, fl.lowpass(400.0, 2048.0, 2, block=16))


def test_unclamped_low_pass_in_short_blocks(spark):
    checked(spark, fl.lowpass(20.0, 2048.0, clamp=False, block=16))


def transformed(v, wavelet, level):
    """The bands of a series, and the series from bands, by the definition alone."""
    low, high = wv.taps(wavelet)
    sizes, made = [len(v)], []
    for _ in range(level):
        v = np.r_[v, v[-1:]] if len(v) % 2 else v
        at = (2 * np.arange(len(v) // 2)[:, None] + np.arange(len(low))) % len(v)
        made.append(v[at] @ np.array(high))
        v = v[at] @ np.array(low)
        sizes.append(len(v))
    return [v, *made[::-1]], sizes


def restored(bands, sizes, wavelet):
    low, high = wv.taps(wavelet)
    v = bands[0]
    for d, n in zip(bands[1:], sizes[-2::-1], strict=True):
        out = np.zeros(2 * len(v))
        for j, (h, g) in enumerate(zip(low, high, strict=True)):
            np.add.at(out, (2 * np.arange(len(v)) + j) % len(out), h * v + g * d)
        v = out[:n]
    return v


def values_of(df, *axes):
    rows = df.orderBy(*axes).toPandas()
    return {k: g["value"].to_numpy() for k, g in rows.groupby(list(axes[:-1]))}


@pytest.mark.parametrize("wavelet, level", [("haar", 1), ("haar", 3), ("db2", 1), ("db2", 3)])
def test_wavelets_in_blocks(spark, monkeypatch, wavelet, level):
    monkeypatch.setattr(blocks, "BLOCK", 8)
    sizes = [1, 2, 5, 31, 32, 33, 35, 63, 64, 65, 67, 95, 97, 100, 129, 131]
    a = np.random.default_rng(4).normal(size=(len(sizes), max(sizes)))
    full = from_array(spark, a)
    n_of = spark.createDataFrame(list(enumerate(sizes)), "channel long, n long")
    x = full.to(full.df.join(n_of, "channel").where("t < n"))
    bands = wv.Decompose(wavelet, level)(x)
    got = values_of(bands.df, "channel", "band", "t")
    want = [transformed(a[c, :n], wavelet, level) for c, n in enumerate(sizes)]
    for c in range(len(sizes)):
        for b in range(level + 1):
            np.testing.assert_allclose(got[c, b], want[c][0][b], atol=1e-12)
    assert len(got) == len(sizes) * (level + 1)
    # Other coefficients than a series' own, as what is changed between has no perfect reconstruction; then the bands without one.
    changed = bands.to(bands.df.withColumn("value", F.col("value") * (F.col("band") + 1)))
    back = values_of(wv.Reconstruct(n_of, wavelet, level)(changed).df, "channel", "t")
    part = values_of(wv.Reconstruct(n_of, wavelet, level)(bands.to(bands.df.where("band <> 1"))).df, "channel", "t")
    for c in range(len(sizes)):
        np.testing.assert_allclose(back[c,], restored([v * (b + 1) for b, v in enumerate(want[c][0])], want[c][1], wavelet), atol=1e-12)
        np.testing.assert_allclose(part[c,], restored([v * (b != 1) for b, v in enumerate(want[c][0])], want[c][1], wavelet), atol=1e-12)
    one = x.to(x.df.where("channel = 15"), ("t",))
    smooth = wv.WaveletDecomposition(0.0, wavelet, level)(one).df.orderBy("t").toPandas()["value"]
    np.testing.assert_allclose(smooth, restored([want[15][0][0], *[0 * v for v in want[15][0][1:]]], want[15][1], wavelet), atol=1e-12)


def test_wavelets_of_nulls(spark):
    """A null is left out of the sums; where nothing else is reached, the sum is null."""
    x = from_array(spark, np.arange(1.0, 9.0)[None])
    x = x.to(x.df.withColumn("value", F.when(~F.col("t").isin(2, 4, 5), F.col("value"))))
    bands = {(r.band, r.t): r.value for r in wv.Decompose("haar", 1)(x).df.collect()}
    r = 0.5**0.5
    assert [bands[0, k] and round(bands[0, k], 9) for k in range(4)] == [round(3 * r, 9), round(4 * r, 9), None, round(15 * r, 9)]
    rows = {r.t: r.value for r in wv.Reconstruct(8, "haar", 1)(wv.Decompose("haar", 1)(x)).df.collect()}
    assert [rows[t] is None for t in range(8)] == [False] * 4 + [True] * 2 + [False] * 2


def test_wavelets_hold_no_aggregate_per_level(spark):
    df = catalog.queries()["wavelet_roundtrip"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 2 and plan.count("sum(") == 0
