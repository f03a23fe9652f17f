"""Series spread over tasks in blocks, chunks, streams, whole windows and wavelets."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.frame import Compose, Identity, from_array, signal
from sigloom.functions import elementwise as e
from sigloom.operators import blocks, filters as fl, shape as s, wavelets as wv, windows as w
from sigloom.plans import catalog
from sigloom.streaming import filters as sf
from test_signals import back, slide

RNG = np.random.default_rng(1)


def long_signal(spark, n, channels=1):
    """A series in Spark: two tones and steps, so that clamps act."""
    t = F.col("id")
    df = spark.range(channels * n).select((t % channels).alias("channel"), F.floor(t / channels).alias("t"))
    return signal(df.withColumn("value", F.sin(F.col("t") * 0.05) + 0.7 * F.sin(F.col("t") * 1.3 + F.col("channel")) + F.when(F.floor(F.col("t") / 5000) % 3 == 0, 0.9).otherwise(0.0)), ("channel", "t"))


def whole(x, sections, clamp):
    rows = x.df.where("channel = 0").orderBy("t").toPandas()
    return np.array(fl.run_sections(rows["value"].tolist(), sections, clamp))


@pytest.mark.parametrize("clamp", [True, False])
def test_one_long_series_on_many_tasks(spark, clamp):
    n, op = 300_000, fl.bandpass(20.0, 450.0, 2048.0, order=2, clamp=clamp, block=20_000)
    x = long_signal(spark, n)
    got = op(x).df.withColumn("task", F.spark_partition_id()).toPandas().sort_values("t")
    assert got["t"].tolist() == list(range(n)) and got["task"].nunique() >= 4
    assert np.abs(got["value"] - whole(x, op.sections, clamp)).max() < 1e-10
    plan = op(x).df._jdf.queryExecution().toString()
    assert "Window" not in plan.split("== Physical Plan ==")[1]


@pytest.mark.parametrize("block", [7, 16, 1000])
def test_blocks_of_short_series_and_both_ways(spark, block):
    a = RNG.normal(size=(3, 83))
    for x, arr in ((from_array(spark, a), a), (from_array(spark, a[0]), a[0])):
        for clamp, both in ((True, False), (False, True)):
            op = fl.Sections(fl.lowpass(300.0, 2048.0, 2).sections, clamp, both)
            np.testing.assert_allclose(back(fl.Sections(op.sections, clamp, both, block=block)(x)), back(op(x)), atol=1e-12)
        np.testing.assert_allclose(back(fl.Notch(500.0, 400.0, 2048.0, block=block)(x)), back(fl.Notch(500.0, 400.0, 2048.0)(x)), atol=1e-9)
        assert arr.shape == back(fl.Notch(5000.0, 1.0, 2048.0, block=block)(x)).shape


def test_notch_of_a_long_series(spark):
    n = 120_000
    x = long_signal(spark, n)
    got = fl.Notch(16.3, 3.0, 2048.0, block=9_000)(x).df.toPandas().sort_values("t")["value"].to_numpy()
    rows = x.df.orderBy("t").toPandas()["value"].to_numpy()
    bins = np.fft.rfft(rows)
    lo, hi = fl.band(16.3, 3.0, 2048.0, n)
    bins[lo : hi + 1] = 0
    np.testing.assert_allclose(got, np.fft.irfft(bins, n), atol=1e-9)
    assert np.abs(got - rows).max() > 0.5


def test_chirp_of_far_places():
    n, a, b = 10**12 + 39, 10**11 * 7, 10**11 * 3
    x = RNG.normal(size=30)
    want = [sum(v * np.exp(-2j * np.pi * ((a + i) * (b + k) % n) / n) for i, v in enumerate(x.tolist())) for k in range(20)]
    np.testing.assert_allclose(fl.chirp(x, a, b, 20, n), want, atol=1e-8)


def test_chunks_of_a_series(spark):
    a, size = RNG.normal(size=(2, 90)), 20
    x = from_array(spark, a)
    x = x.to(x.df.withColumns({"chunk": F.floor(F.col("t") / size), "t": F.col("t") % size}), ("channel", "chunk", "t"))
    sections = fl.lowpass(100.0, 2048.0, 2).sections
    run = lambda v: np.array(fl.run_sections(v.tolist(), sections, False))
    full = np.stack([run(v) for v in a])
    for overlap in (0, 5, 33):
        want = np.stack([np.concatenate([run(v[max(0, k - overlap) : k + size])[min(k, overlap) :] for k in range(0, 90, size)]) for v in a])
        rows = fl.ChunkedSections(sections, size, False, continuous=False, overlap=overlap)(x).df.toPandas()
        got = np.full(a.shape, np.nan)
        got[rows["channel"], rows["chunk"] * size + rows["t"]] = rows["value"]
        np.testing.assert_allclose(got, want, atol=1e-12)
        assert overlap or np.abs(got - full).max() > 1e-3
    rows = fl.ChunkedSections(sections, size, False)(x).df.toPandas()
    np.testing.assert_allclose(rows.sort_values(["channel", "chunk", "t"])["value"], full.ravel(), atol=1e-12)
    with pytest.raises(ValueError):
        fl.ChunkedSections(sections, size)(from_array(spark, a))


def test_stream_of_chunks_equals_the_whole_series(spark, tmp_path):
    a = RNG.normal(size=(3, 120))
    df = from_array(spark, a).df
    for k, piece in enumerate(["t < 30", "t between 60 and 79", "t between 30 and 59 or t between 20 and 25", "t >= 80"]):  # one piece comes early, some samples twice
        df.where(piece).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    for key, v in sf.STATE_STORE.items():
        spark.conf.set(key, v)
    op = fl.bandpass(100.0, 400.0, 2048.0, order=1)
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
        q = sf.filtered_stream(stream, op.sections).writeStream.format("memory").queryName("filtered").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)
        rows = spark.table("filtered").toPandas().sort_values(["channel", "t"])
    finally:
        for key in sf.STATE_STORE:
            spark.conf.unset(key)
    np.testing.assert_allclose(rows["value"].to_numpy().reshape(3, 120), [fl.run_sections(v.tolist(), op.sections, True) for v in a], atol=1e-12)


@pytest.mark.parametrize("size, stride", [(5, 1), (8, 3), (7, 7), (4, 9), (53, 10), (60, 2)])
def test_functions_of_whole_windows(spark, monkeypatch, size, stride):
    monkeypatch.setattr(blocks, "BLOCK", 12)
    monkeypatch.setattr(blocks.windows_of_block, "__defaults__", (12,))
    monkeypatch.setattr(blocks.with_window_blocks, "__defaults__", (12,))
    a = RNG.normal(size=(2, 53))
    x, win = from_array(spark, a), slide(a, size, stride) if size <= 53 else None
    got = w.WindowFunction(size, stride, lambda v: np.ptp(v, axis=1))(x)
    wave = w.WaveformLength(size, stride)(x)
    if win is None:
        assert got.df.count() == wave.df.count() == 0
        return
    np.testing.assert_allclose(back(got), np.ptp(win, axis=-1))
    np.testing.assert_allclose(back(wave), abs(np.diff(win, axis=-1)).sum(-1), atol=1e-12)
    holes = x.to(x.df.where("t <> 20"))
    full = {k for k in range(win.shape[-2]) if not k * stride <= 20 < k * stride + size}
    assert {r.t for r in w.WindowFunction(size, stride, lambda v: v.max(axis=1))(holes).df.collect()} == full


def test_window_functions_must_give_a_number_per_window(spark):
    x = from_array(spark, RNG.normal(size=(1, 20)))
    with pytest.raises(Exception, match="one number per window"):
        w.WindowFunction(4, 2, lambda v: v)(x).df.collect()

    class Span(w.WindowFunction):
        def compute(self, windows):
            return windows[:, -1] - windows[:, 0]

    assert back(Span(4, 4)(x)).shape == (1, 5)


def test_halo_differences_and_medians(spark):
    a = RNG.normal(size=(2, 61))
    x = from_array(spark, a)
    for n in (1, 3):
        df = blocks.with_halo(x.df, "t", n, block=5)
        for _ in range(n):
            df = df.withColumn("value", F.col("value") - F.lag("value").over(blocks.along(["channel"], "t")))
        rows = blocks.own(df, "t", 5).where(F.col("t") >= n).orderBy("channel", "t").toPandas()
        np.testing.assert_allclose(rows["value"].to_numpy().reshape(2, 61 - n), np.diff(a, n), atol=1e-12)
        np.testing.assert_allclose(back(s.Diff(n)(x)), np.diff(a, n), atol=1e-12)
    seen = blocks.with_halo(x.df.where("channel = 0"), "t", 4, 6, block=5).groupBy("__block").agg(F.collect_set("t").alias("t")).collect()
    assert {r["__block"]: set(r.t) for r in seen if r["__block"] < 13} == {b: set(range(max(0, 5 * b - 4), min(61, 5 * b + 11))) for b in range(13)}


def test_no_window_over_a_whole_series(spark):
    x = from_array(spark, RNG.normal(size=(2, 61)))
    for op in (s.Diff(2), w.WaveformLength(8, 4), w.SlopeSignChanges(8, 4), w.Median(5)):
        plan = op(x).df._jdf.queryExecution().optimizedPlan().toString()
        overs = [line for line in plan.splitlines() if "Window [" in line]
        assert overs and all("__block" in line for line in overs)


def test_branches_share_their_input_and_windows(spark):
    df = catalog.queries()["filtered_features"](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 1 and len(re.findall(r"- (?:Broadcast)?Exchange ", plan)) <= 5, plan
    a = RNG.normal(size=(2, 40))
    x = from_array(spark, a)
    mixed = s.Stack({"a": Compose([e.Rectify(), w.RMS(8, 4)]), "b": Identity(), "c": w.WaveformLength(8, 4), "d": w.RMS(8, 4), "e": w.RMS(8)})
    got, win = mixed(x).df.toPandas(), slide(a, 8, 4)
    of = lambda k: got[got["representation"] == k].sort_values(["channel", "t"])["value"].to_numpy()
    rms = np.sqrt((win**2).mean(-1)).ravel()
    np.testing.assert_allclose(of(0), rms, atol=1e-12)
    np.testing.assert_allclose(of(1), a.ravel())
    np.testing.assert_allclose(of(2), abs(np.diff(win, axis=-1)).sum(-1).ravel(), atol=1e-12)
    np.testing.assert_allclose(of(3), rms, atol=1e-12)
    assert len(of(4)) == 10
    with pytest.raises(ValueError):
        s.Stack({"a": Identity(), "b": s.Index(0, "t")})(x)


@pytest.mark.parametrize("wavelet", ["haar", "db2"])
@pytest.mark.parametrize("n", [1, 3, 16, 21])
def test_wavelets_are_orthogonal_and_reconstruct(spark, wavelet, n):
    a = RNG.normal(size=(2, n))
    x = from_array(spark, a)
    bands = wv.Decompose(wavelet, 3)(x)
    np.testing.assert_allclose(back(wv.Reconstruct(n, wavelet, 3)(bands)), a, atol=1e-10)
    sizes, k = [], n
    for _ in range(3):
        k = -(-k // 2)
        sizes.append(k)
    assert [r.n for r in bands.df.groupBy("band").agg((F.max("t") + 1).alias("n")).orderBy("band").collect()] == [sizes[2], sizes[2], sizes[1], sizes[0]]
    if n == 16:  # energy is kept where no sample is repeated
        assert bands.df.agg(F.sum(F.col("value") ** 2)).first()[0] == pytest.approx((a**2).sum())
    smooth = bands.df.withColumn("value", F.when(F.col("band") == 0, F.col("value")).otherwise(0.0))
    part = back(wv.Reconstruct(n, wavelet, 3)(bands.to(smooth)))
    want = a.copy()
    want[0], want[1] = 0.3 * a[0] + 0.7 * part[0], a[1]
    np.testing.assert_allclose(back(wv.WaveletDecomposition([0.3], wavelet, 3, electrodes=1)(x)), want, atol=1e-10)
    with pytest.raises(ValueError):
        wv.Decompose("db99")(x)
