import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from sigloom.frame import Compose, SignalFrame, TransformError, Lambda, from_array, signal
from sigloom.functions import elementwise as e
from sigloom.operators import augment as g, filters as fl, normalize as n, shape as s, spatial as sp, windows as w
from sigloom.plans import presets
from sigloom.sources import datasets as ds
from sigloom.sources.containers import Recording


def back(x: SignalFrame) -> np.ndarray:
    """The signal as a dense array."""
    rows = x.df.toPandas()
    out = np.full([int(rows[a].max()) + 1 for a in x.axes], np.nan)
    assert not rows.duplicated(list(x.axes)).any()
    out[tuple(rows[a].to_numpy() for a in x.axes)] = rows["value"]
    return out


def slide(a, size, stride):
    return np.stack([a[..., k : k + size] for k in range(0, a.shape[-1] - size + 1, stride)], -2)


RNG = np.random.default_rng(0)
X = RNG.normal(size=(3, 53))


@pytest.mark.parametrize("size, stride", [(5, 1), (8, 3), (7, 7), (4, 9), (53, 10)])
def test_window_features(spark, size, stride):
    x, win = from_array(spark, X), slide(X, size, stride)
    d = np.diff(win, axis=-1)
    want = {
        w.RMS: np.sqrt((win**2).mean(-1)), w.MAV: abs(win).mean(-1), w.VAR: win.var(-1, ddof=1), w.IAV: abs(win).sum(-1), w.WaveformLength: abs(d).sum(-1),
        w.ZeroCrossings: (np.diff(np.sign(win), axis=-1) != 0).sum(-1), w.SlopeSignChanges: (np.diff(np.sign(d), axis=-1) != 0).sum(-1),
    }
    for op, v in want.items():
        np.testing.assert_allclose(back(op(size, stride)(x)), v, atol=1e-12)
    np.testing.assert_array_equal(back(w.Chunk(size, stride)(x)), np.moveaxis(win, -2, 0))


def test_exact_window_cases(spark):
    ramp, zigzag = from_array(spark, np.arange(100.0)[None]), from_array(spark, (np.arange(100) % 2.0)[None])
    assert back(w.VAR(10)(ramp))[0, 0] == pytest.approx(9.1666666667) and back(w.VAR(10, ddof=0)(ramp))[0, 0] == pytest.approx(8.25)
    assert back(w.WaveformLength(10)(ramp)).tolist() == [[9.0] * 10] and back(w.SlopeSignChanges(10)(zigzag)).tolist() == [[8.0] * 10]
    one = from_array(spark, [[1.0, 0.0, -1.0]])
    assert back(w.ZeroCrossings(3)(one))[0, 0] == 2 and back(w.ZeroCrossings(3, halved=True)(one))[0, 0] == 0


def test_normalise_and_reduce(spark):
    a = RNG.normal(size=(2, 3, 11))
    x = from_array(spark, a)
    np.testing.assert_allclose(back(n.ZScore()(x)), (a - a.mean(-1, keepdims=True)) / (a.std(-1, ddof=1, keepdims=True) + 1e-8), atol=1e-9)
    np.testing.assert_allclose(back(n.InstanceNorm()(x)), (a - a.mean(-1, keepdims=True)) / np.sqrt(a.var(-1, keepdims=True) + 1e-5), atol=1e-9)
    np.testing.assert_allclose(back(n.BatchNorm()(x)), (a - a.mean(0)) / np.sqrt(a.var(0) + 1e-5), atol=1e-9)
    np.testing.assert_allclose(back(n.LayerNorm(2)(x)), (a - a.mean((1, 2), keepdims=True)) / np.sqrt(a.var((1, 2), keepdims=True) + 1e-5), atol=1e-9)
    np.testing.assert_allclose(back(n.Normalize(3)(x)), a / (abs(a) ** 3).sum(1, keepdims=True) ** (1 / 3), atol=1e-9)
    np.testing.assert_allclose(back(n.Mean("channel")(x)), a.mean(1), atol=1e-12)
    np.testing.assert_allclose(back(n.Sum(keepdim=True)(x)), a.sum(-1, keepdims=True), atol=1e-12)


def test_shapes(spark):
    a = np.arange(24.0).reshape(2, 3, 4)
    x = from_array(spark, a)
    np.testing.assert_array_equal(back(s.Reshape((4, -1), ("p", "q"), (2, 3, 4))(x)), a.reshape(4, -1))
    np.testing.assert_array_equal(back(s.Flatten(0, 1, [3])(x)), a.reshape(6, 4))
    np.testing.assert_array_equal(back(s.Flatten(1, -1, [4])(x)), a.reshape(2, 12))
    np.testing.assert_array_equal(back(s.Transpose([2, 0, 1])(x)), a.transpose(2, 0, 1))
    np.testing.assert_array_equal(back(s.Repeat(2)(x)), np.tile(a, (1, 2, 1)))
    np.testing.assert_array_equal(back(s.Index([2, 0, 0])(x)), a[:, [2, 0, 0]])
    np.testing.assert_array_equal(back(s.Index(slice(-3, None, 2), "t")(x)), a[..., -3::2])
    np.testing.assert_array_equal(back(s.Index(-1)(x)), a[:, -1])
    np.testing.assert_array_equal(back(s.Diff(2)(x)), np.diff(a, 2))
    twice = s.Concat({"a": lambda y: y, "b": s.Index(slice(0, 2))}, "channel")(x)
    np.testing.assert_array_equal(back(twice), np.concatenate([a, a[:, :2]], 1))
    np.testing.assert_array_equal(back(s.Stack({"a": lambda y: y, "b": g.Scale(2.0)})(x)), np.stack([a, 2 * a]))


@settings(max_examples=6, deadline=None)
@given(size=st.integers(2, 7), before=st.integers(0, 9), after=st.integers(0, 9))
def test_padding_like_numpy(spark, size, before, after):
    a = np.arange(1.0, size + 1)[None]
    for mode, theirs in (("constant", "constant"), ("reflect", "reflect"), ("replicate", "edge"), ("circular", "wrap")):
        np.testing.assert_array_equal(back(s.Pad((before, after), mode=mode)(from_array(spark, a))), np.pad(a, ((0, 0), (before, after)), theirs))


def test_filters(spark):
    a = RNG.normal(size=(2, 67)) / 4
    want = a - np.fft.irfft(np.where(abs(np.fft.rfftfreq(67, 1 / 100) - 10) <= 5, np.fft.rfft(a), 0), 67)
    np.testing.assert_allclose(back(fl.Notch(10.0, 10.0, 100.0)(from_array(spark, a))), want, atol=1e-10)
    t = np.arange(1000) / 1000
    tones = from_array(spark, (np.sin(2 * math.pi * 5 * t) + np.sin(2 * math.pi * 120 * t))[None] / 2, fs=1000.0)
    low = back(fl.lowpass(30.0, 1000.0)(tones))[0][300:]
    assert abs(np.fft.rfft(low, 700)).argmax() == pytest.approx(5 * 0.7, abs=1) and low.std() == pytest.approx(0.35, abs=0.05)
    assert abs(back(fl.lowpass(400.0, 1000.0, 1)(from_array(spark, 5 * np.ones((1, 50)))))).max() == 1.0
    assert abs(back(fl.lowpass(400.0, 1000.0, 1, clamp=False)(from_array(spark, 5 * np.ones((1, 50)))))).max() > 4


def test_spatial(spark):
    def on(rows, cols, **kw):
        grid = sp.create_grid_layout(spark, rows, cols, **kw)
        k = grid.where("electrode >= 0").count()
        x = from_array(spark, np.ones((k, 2)))
        return SignalFrame(x.df, x.axes, grids=grid)

    assert back(sp.SpatialFilter("NDD")(on(2, 2))).tolist() == [[0.5, 0.5]] * 4
    assert back(sp.SpatialFilter("NDD")(on(3, 3)))[:, 0].tolist() == [0.5, 0.25, 0.5, 0.25, 0, 0.25, 0.5, 0.25, 0.5]
    column = on(4, 4, fill_pattern="column")
    np.testing.assert_array_equal(back(sp.SpatialFilter("LSD")(column)), back(sp.SpatialFilter("LSD")(on(4, 4))))
    y = on(5, 5, missing=[(0, 0), (2, 2), (4, 4)])
    there = sp.channels_to_grid(y)
    assert back(there).sum() == 44 and back(sp.grid_to_channels(there, y.grids)).shape == (22, 2)
    with pytest.raises(ValueError):
        sp.create_grid_layout(spark, 2, 2, 5)
    with pytest.raises(ValueError):
        sp.SpatialFilter([[1.0]])(y)
    with pytest.raises(ValueError):
        sp.check_grids(spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 1)], "grid int, row int, col int, electrode int"))


def test_augmentation(spark):
    a = RNG.normal(size=(2, 40))
    x = from_array(spark, a)
    np.testing.assert_allclose(back(g.MagnitudeWarp([1.0, 2.0, 0.5])(x)), a * np.interp(np.arange(40), np.linspace(0, 39, 3), [1, 2, 0.5]))
    knots = np.clip(np.linspace(0, 39, 4) + np.array([0, 0.2, -0.1, -0.1]) * 40 / 2, 0, 39)
    at = np.interp(np.arange(40), np.linspace(0, 39, 4), knots)
    np.testing.assert_allclose(back(g.TimeWarp([0, 0.2, -0.1, -0.1])(x)), np.stack([np.interp(at, np.arange(40), r) for r in a]))
    np.testing.assert_array_equal(back(g.TimeShift(-7, "wrap")(x)), np.roll(a, -7, 1))
    assert (back(g.TimeShift(5, "edge_true")(x))[:, :5] == a[:, :1]).all()
    noise = back(g.GaussianNoise(0.5, 1)(from_array(spark, np.zeros((20, 200)))))
    assert abs(noise.std() - 0.5) < 0.02 and abs(noise.mean()) < 0.03
    kept = back(g.Dropout(0.25, 2)(from_array(spark, np.ones((20, 200)))))
    assert set(np.unique(kept)) == {0.0, 1 / 0.75} and abs((kept == 0).mean() - 0.25) < 0.03
    for draw in (g.draw_scale(), g.draw_cutout(40, 2, 5), g.draw_channel_shuffle(2), g.draw_time_shift(9)):
        one = g.Randomly(draw, 1.0, 4)
        np.testing.assert_array_equal(back(one(x)), back(one(x)))
    assert g.Randomly(g.draw_scale(), 0.0, 1)(x) is x


def test_split_and_windows(spark):
    def rec(name, k):
        return spark.range(k).selectExpr(f"'{name}' as task", "id as t", "cast(id as double) as value")

    sizes = {r["split"]: r["count"] for r in ds.center_split(rec("a", 1000), ["task"]).groupBy("split").count().collect()}
    assert sizes == {"train": 800, "test": 160, "val": 40}
    out = ds.center_split(rec("a", 1000), ["task"]).toPandas()
    for split, want in {"train": [*range(400), *range(600, 1000)], "test": [*range(400, 480), *range(520, 600)], "val": [*range(480, 520)]}.items():
        part = out[out.split == split].sort_values("t")
        assert part.t.tolist() == list(range(len(want))) and part.value.tolist() == want
    assert sorted(out[out.seam].value) == [520, 600]
    both = rec("b", 10).union(rec("a", 25)).union(rec("c", 3))
    starts = [tuple(r) for r in ds.window_starts(both, 5, 4).orderBy("window_id").collect()]
    assert starts == [(0, "a", 0), (1, "a", 4), (2, "a", 8), (3, "a", 12), (4, "a", 16), (5, "a", 20), (6, "b", 0), (7, "b", 4)]
    got = ds.fetch_windows(both, ds.random_starts(both, 5, 50, 1), 5).groupBy("window_id").count().collect()
    assert len(got) == 50 and {r["count"] for r in got} == {5}


def test_dataset_store(spark, tmp_path):
    emg = spark.range(200).selectExpr("'1' as task", "id % 2 as channel", "id div 2 as t", "cast(id as double) as value")
    kin = spark.range(240).selectExpr("'1' as task", "id % 3 as joint", "id div 3 as t", "cast(id as double) as value")
    path = f"file://{tmp_path}/store"
    ds.DatasetCreator({"emg": emg, "kinematics": kin}, path).create()
    assert ds.read_split(spark, path, "emg", "train").count() == 2 * 64 and ds.read_split(spark, path, "kinematics", "train").count() == 3 * 64
    test = ds.read_split(spark, path, "emg", "test")
    assert test.schema["task"].dataType.simpleString() == "string" and "split=test" in str(test.inputFiles())
    with pytest.raises(ValueError):
        ds.read_split(spark, path, "eeg", "train")


def test_errors_and_containers(spark):
    x = from_array(spark, X, fs=2048.0)
    with pytest.raises(ValueError):
        n.Mean("joint")(x)
    with pytest.raises(TypeError):
        n.Mean()(3)
    with pytest.raises(ValueError):
        e.ClampRange()
    with pytest.raises(TransformError):
        Compose([Lambda(lambda v: v + {}[1])])(x)
    with pytest.raises(ValueError):
        signal(x.df, fs=-1.0)
    r = Recording.of("emg", x).with_result("abs", e.Rectify()(x))
    assert r["Last"] is r["abs"] and not r.is_chunked("Input")
    gone = r.without("Last")
    with pytest.raises(RuntimeError):
        gone["abs"]
    with pytest.raises(KeyError):
        gone["other"]
    with pytest.raises(RuntimeError):
        r.with_result("Input", x)
    with pytest.raises(ValueError):
        Recording.of("kinematics", x)


def test_activations(spark):
    v = np.linspace(-2, 2, 41)
    x = from_array(spark, v, ("t",))
    erf = np.vectorize(math.erf)
    np.testing.assert_allclose(back(Lambda(e.pserf)(x)), v * erf(np.log1p(np.exp(1.25 * v))) + 1e-12, atol=1e-12)
    np.testing.assert_allclose(back(Lambda(e.smu)(x)), (1.01 * v + 0.99 * v * erf(2.5 * 0.99 * v)) / 2, atol=1e-12)


def test_streamed_features(spark, tmp_path):
    from sigloom.streaming.features import stream_features

    rows = spark.range(100).selectExpr("id % 2 as channel", "timestamp_seconds(id) as ts", "cast(id as double) as value")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = stream_features(stream, "channel", "ts", "20 seconds").writeStream.format("memory").queryName("feats").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["channel"], r["n"]) for r in spark.table("feats").collect()}
    assert len(got) == 2 and spark.table("feats").count() == 10


def test_alignment(spark):
    a, b = from_array(spark, np.arange(4.0), ("channel",)), from_array(spark, np.arange(5.0), ("t",))
    both = e.weighted_sum(a, b, 0.25)
    assert both.axes == ("channel", "t")
    np.testing.assert_allclose(back(both), 0.25 * np.arange(4)[:, None] + 0.75 * np.arange(5))
    scalar = n.Mean()(b)
    np.testing.assert_allclose(back(e.weighted_sum(a, scalar, 0.5)), 0.5 * np.arange(4) + 1.0)
    wide = from_array(spark, np.arange(20.0).reshape(4, 5))
    np.testing.assert_allclose(back(e.weighted_sum(a, wide, 0.5)), 0.5 * np.arange(4)[:, None] + 0.5 * np.arange(20).reshape(4, 5))


def test_axes_by_their_usual_place(spark):
    a = np.arange(24.0).reshape(2, 3, 4)
    x = from_array(spark, a, ("dim_0", "dim_1", "dim_2"))
    np.testing.assert_allclose(back(n.Mean("channel")(x)), a.mean(1))
    np.testing.assert_allclose(back(n.Mean("t")(x)), a.mean(2))
    np.testing.assert_allclose(back(n.Sum("batch")(x)), a.sum(0))
    with pytest.raises(ValueError):
        n.Mean("channel")(from_array(spark, np.arange(3.0), ("dim_0",)))


@pytest.mark.parametrize("shift", [0, 5, 7, -5, -7, 3, -2, 0.5, -0.3])
def test_shifts_of_any_size(spark, shift):
    a = np.arange(1.0, 11.0).reshape(2, 5)
    s_ = int(5 * shift) if isinstance(shift, float) else shift
    x, at = from_array(spark, a), np.arange(5)
    freed = at < s_ if s_ > 0 else at >= 5 + s_
    np.testing.assert_array_equal(back(g.TimeShift(shift, "wrap")(x)), np.roll(a, s_, 1))
    np.testing.assert_array_equal(back(g.TimeShift(shift, "zero")(x)), np.where(freed, 0, np.roll(a, s_, 1)))
    for fill, edge in (("edge", min(s_, 4) if s_ > 0 else max(4 + s_, 0)), ("edge_true", 0 if s_ > 0 else 4)):
        np.testing.assert_array_equal(back(g.TimeShift(shift, fill)(x)), np.where(freed, a[:, [edge]], np.roll(a, s_, 1)))


def test_many_series_together_equal_one_by_one(spark, monkeypatch):
    sections = fl.bandpass(20.0, 450.0, 2048.0).sections
    sizes = np.array([1, 2, 3, 40, 55, 41, 60, 77, 44, 50, 61, 70, 58, 1000])
    values = RNG.normal(size=sizes.sum())
    for clamp in (True, False):
        want = np.concatenate([fl.run_sections(v.tolist(), sections, clamp) for v in np.split(values, np.cumsum(sizes)[:-1])])
        np.testing.assert_allclose(fl.filtered(values, sizes, sections, clamp), want, rtol=1e-12, atol=1e-12)
    back_ = np.concatenate([v[::-1] for v in np.split(values, np.cumsum(sizes)[:-1])])
    np.testing.assert_array_equal(values[fl.backwards(sizes)], back_)
    monkeypatch.setattr(fl, "SERIES_ROWS", 100)  # series are cut out of several batches
    a = RNG.normal(size=(30, 90))
    want = np.stack([fl.run_sections(fl.run_sections(r.tolist(), sections[:2], False)[::-1], sections[:2], False)[::-1] for r in a])
    np.testing.assert_allclose(back(fl.Sections(sections[:2], False, True)(from_array(spark, a))), want, atol=1e-12)
    np.testing.assert_allclose(back(fl.Sections(sections[:1], False)(from_array(spark, a[0], ("t",)))), fl.run_sections(a[0].tolist(), sections[:1], False), atol=1e-12)


def test_interpolation_of_a_line_and_its_harmonics(spark):
    t = np.arange(2000) / 2000
    x = np.sin(2 * np.pi * 10 * t) + 0.5 * np.sin(2 * np.pi * 50 * t) + 0.3 * np.sin(2 * np.pi * 100 * t) + 0.2 * np.sin(2 * np.pi * 150 * t)
    y = back(Compose(fl.spectral_interpolation(50.0, 2000.0))(from_array(spark, x, ("t",))))
    was, now = abs(np.fft.rfft(x)), abs(np.fft.rfft(y))
    assert all(now[k] < 0.5 * was[k] for k in (50, 100, 150)) and now[10] == pytest.approx(was[10])


def test_random_starts_are_uniform_and_seeded(spark):
    rows = spark.createDataFrame([(f"r{k}", t, 0.0) for k, n_ in enumerate([3, 30, 8, 100, 5]) for t in range(n_)], "task string, t long, value double")
    draws = ds.random_starts(rows, 5, 4000, 1).toPandas()
    assert sorted(draws.window_id) == list(range(4000)) and (draws.start >= 0).all()
    spans = {"r1": 26, "r2": 4, "r3": 96, "r4": 1}
    share = draws.task.value_counts() / 4000
    assert set(share.index) == set(spans) and all(abs(share[k] - v / 127) < 0.03 for k, v in spans.items())
    assert all(draws[draws.task == k].start.max() < v for k, v in spans.items()) and len(set(draws[draws.task == "r3"].start)) > 90
    assert ds.random_starts(rows, 5, 50, 1).toPandas().equals(ds.random_starts(rows, 5, 50, 1).toPandas()) and not ds.random_starts(rows, 5, 50, 2).toPandas().equals(ds.random_starts(rows, 5, 50, 1).toPandas())


def test_data_module(spark, tmp_path):
    emg = ds.modality({"1": from_array(spark, RNG.normal(size=(2, 300))), "2": from_array(spark, RNG.normal(size=(2, 200)))})
    kin = ds.modality({"1": from_array(spark, RNG.normal(size=(4, 3, 300)), ("joint", "xyz", "t")), "2": from_array(spark, RNG.normal(size=(4, 3, 210)), ("joint", "xyz", "t"))}, presets.kinematics())
    path = f"file://{tmp_path}/store"
    ds.DatasetCreator({"emg": emg, "kinematics": kin}, path, val_ratio=0.5, chunk=64).create()
    module = ds.DataModule(spark, path, window_size=20, window_stride=10, n_windows_per_epoch=12, target_transform=presets.target(), val_transform=e.Rectify())
    x, y = module.pairs("train")
    assert x.axes == ("batch", "channel", "t") and y.axes == ("batch", "channel")
    assert back(x).shape == (12, 2, 20) and back(y).shape == (12, 9)
    vx, vy = module.pairs("val")
    assert back(vx).min() >= 0 and back(vx).shape[0] == back(vy).shape[0] > 0
    assert ds.sample_shapes(emg, ("channel", "t")).first().asDict() == {"channel": 2}
    with pytest.raises(ValueError):
        ds.DataModule(spark, path)
    with pytest.raises(ValueError):
        ds.split_axis(from_array(spark, X), test_ratio=0.7, val_ratio=0.5)
    with pytest.raises(ValueError):
        presets.training(augmentation="other")


def test_group_store(spark, tmp_path):
    store = ds.GroupStore(spark, f"file://{tmp_path}/groups")
    rows = spark.range(4).selectExpr("id as sample", "cast(id as double) as value")
    assert store.groups() == [] and not store.has_group("emg")
    with pytest.raises(ValueError):
        store.sample(0)
    store.add("emg", "data", rows)
    store.add("emg", "data", rows)
    store.add("label", "data", rows)
    store.add("emg", "none", rows.limit(0))
    with pytest.raises(ValueError):
        store.sample(0)
    store.add("ground_truth", "data", rows)
    assert store.groups() == ["emg", "ground_truth", "label"] and store.arrays("emg") == ["data"]
    assert sorted(r.sample for r in store.read("emg").collect()) == list(range(8))
    x, y = store.sample(3)
    assert [r.value for r in x.collect()] == [3.0] and [r.value for r in y.collect()] == [3.0]
    with pytest.raises(KeyError):
        store.read("emg", "none")


def test_saved_recording_and_runs(spark, tmp_path):
    from datetime import datetime

    x = from_array(spark, X, fs=2048.0)
    r = Recording.of("emg", x).with_result("abs", e.Rectify()(x)).with_result("mean", n.Mean(keepdim=True)(x)).without("Last")
    r.save(f"file://{tmp_path}/rec")
    again = Recording.load(spark, f"file://{tmp_path}/rec")
    assert repr(again) == repr(r) and "deleted" in repr(r) and "2048" in repr(r)
    np.testing.assert_array_equal(back(again["abs"]), abs(X))
    with pytest.raises(RuntimeError):
        again["mean"]
    for k, status in enumerate(["FINISHED", "FAILED", "FINISHED"]):
        ds.log_run(spark, f"file://{tmp_path}/runs", str(k), f"run {k}", status, datetime(2024, 1, 1 + k), {"lr": "0.1"}, {"loss": 1.0 / (k + 1)})
    runs = spark.read.parquet(f"file://{tmp_path}/runs")
    assert [r.run_id for r in ds.list_runs(runs).collect()] == ["2", "1", "0"] and [r.run_id for r in ds.list_runs(runs, "FAILED").collect()] == ["1"]
    assert ds.latest_run(runs).first().metrics["loss"] == pytest.approx(1 / 3)


def test_grids_are_checked_and_curves_by_grid_divide(spark):
    x = from_array(spark, np.ones((6, 9)))
    bad = spark.createDataFrame([(0, 0, 0, -1)], "grid int, row int, col int, electrode int")
    with pytest.raises(ValueError):
        signal(x.df, ("channel", "t"), grids=bad)
    y = back(g.GridMagnitudeWarp([[1.0, 1.0], [2.0, 4.0]])(x))
    assert (y[:3] == 1).all() and y[3:, 0].tolist() == [2.0] * 3 and y[3:, -1].tolist() == [4.0] * 3
    with pytest.raises(Exception, match="divide"):
        g.GridMagnitudeWarp([[1.0, 1.0]] * 4)(x).df.collect()
    with pytest.raises(ValueError):
        s.Reshape((2, -1), ("a", "b"), (None, 9))(x)
