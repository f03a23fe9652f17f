"""Array files, coordinates and masks, bucketed windows, dense batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.frame import from_array, signal
from sigloom.operators import indexing as ix
from sigloom.sources import arrays as ar, datasets as ds
from test_signals import back

RNG = np.random.default_rng(2)


@pytest.mark.parametrize("order", "CF")
def test_npy_files_are_read_block_by_block(spark, tmp_path, order):
    a = np.asarray(RNG.normal(size=(3, 4, 50)).astype("f4"), order=order)
    np.save(f"{tmp_path}/a.npy", a)
    x = ar.read_array(spark, f"file://{tmp_path}/a.npy", ("row", "col", "t"), block=8)
    assert x.df.rdd.getNumPartitions() == 7
    np.testing.assert_array_equal(back(x), a)
    for where, parts, keep in (("t >= 17 and t < 30", 2, slice(17, 30)), ("t = 31", 1, slice(31, 32)), ("t in (3, 20) and row = 1", 3, None), ("t > 200", 1, slice(0, 0)), ("t > 47", 1, slice(48, 50))):
        df = x.df.where(where)
        assert df.rdd.getNumPartitions() == parts, where
        if keep is not None:
            rows = df.orderBy("row", "col", "t").toPandas()["value"].to_numpy()
            np.testing.assert_array_equal(rows, a[..., keep].ravel())
    assert x.df.where("t in (3, 20) and row = 1").count() == 8


def test_broken_or_odd_array_files(spark, tmp_path):
    open(f"{tmp_path}/x.npy", "wb").write(b"nothing of the kind")
    with pytest.raises(ValueError):
        ar.Layout.of(f"{tmp_path}/x.npy")
    np.save(f"{tmp_path}/e.npy", np.zeros((3, 0)))
    assert ar.read_array(spark, f"{tmp_path}/e.npy").df.count() == 0
    np.save(f"{tmp_path}/big.npy", np.arange(6, dtype=">i2").reshape(2, 3))
    assert back(ar.read_array(spark, f"{tmp_path}/big.npy")).tolist() == [[0, 1, 2], [3, 4, 5]]
    with pytest.raises(Exception, match="axes"):
        ar.read_array(spark, f"{tmp_path}/big.npy", ("t",)).df.collect()


def test_chunk_folders_round_trip(spark, tmp_path):
    a = RNG.normal(size=(4, 3, 37))
    x = from_array(spark, a, ("channel", "row", "t"))
    for dim, block in (("t", 10), ("channel", 3), ("t", 1000)):
        path = f"file://{tmp_path}/{dim}{block}"
        layout = ar.write_chunks(x, path, block, dim)
        y = ar.read_array(spark, path, x.axes, dim, block)
        np.testing.assert_array_equal(back(y), a)
        assert y.df.rdd.getNumPartitions() == -(-layout.shape[x.axes.index(dim)] // block)
    holes = x.to(x.df.where("t <> 5 and t not between 10 and 19"))
    ar.write_chunks(holes, f"file://{tmp_path}/holes", 10)
    rows = ar.read_array(spark, f"file://{tmp_path}/holes", x.axes).df.where("not isnan(value)")
    assert rows.count() == holes.df.count()


X3 = RNG.normal(size=(5, 10, 30))
MASK = [k % 7 == 0 for k in range(30)]


@pytest.mark.parametrize("key", [0, slice(1, 4), (0, slice(None), slice(0, 10)), ([0, 2, 4], slice(None), [0, 15, 29]), (Ellipsis, [0, 15, 29]), (slice(None), slice(None), MASK), (slice(None), [1, -1], [-2, 3]), (2, slice(None), [4, 5]), ([3, 3], [1, 1], [0, 0]), (slice(None), 4, MASK), (1, ..., 2), (..., -1), ([[0], [1]][0], [4, 5], slice(2, 9, 3))])
def test_index_expressions_equal_numpy(spark, key):
    got = ix.At(key)(from_array(spark, X3, ("a", "b", "c")))
    want = X3[tuple(np.array(k) if isinstance(k, list) else k for k in key) if isinstance(key, tuple) else key]
    np.testing.assert_array_equal(back(got), want)


def test_masks_over_several_axes_and_large_tables_of_places(spark):
    x = from_array(spark, X3, ("a", "b", "c"))
    mask = X3[:, 0, :] > 0.2
    m = from_array(spark, mask.astype(float), ("a", "c"))
    for block in (1, 7, 1000):
        np.testing.assert_array_equal(back(ix.IndexMask(m, block=block)(x)), X3.transpose(0, 2, 1)[mask])
    full = X3 > 0.5
    np.testing.assert_array_equal(back(ix.IndexMask(from_array(spark, full.astype(float), ("a", "b", "c")), name="kept", block=9)(x)), X3[full])
    places = spark.range(400).select(F.col("id").alias("pos"), (F.col("id") * 7 % 5).alias("a"), (F.col("id") * 3 % 30).alias("c"))
    k = np.arange(400)
    np.testing.assert_array_equal(back(ix.IndexPairs(places, "pick")(x)), X3[k * 7 % 5, :, k * 3 % 30])
    for bad in (lambda: ix.IndexPairs({"a": [1], "b": [1, 2]})(x), lambda: ix.IndexMask(from_array(spark, mask.astype(float), ("a", "z")))(x)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(IndexError):
        ix.At((0, 0, 0, 0))(x)


def test_windows_of_a_bucketed_store_without_a_shuffle_of_samples(spark, tmp_path):
    rows = spark.range(6000).select((F.col("id") % 3).alias("task"), (F.col("id") % 2).alias("channel"), F.floor(F.col("id") / 6).alias("t"), F.col("id").cast("double").alias("value"))
    store = ds.BucketedStore(spark, "kept_recordings", f"file://{tmp_path}/s", block=100, buckets=8)
    store.write(rows)
    starts = ds.window_starts(store.read(), 250, 120)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        got = store.fetch(starts, 250)
        plan = got._jdf.queryExecution().executedPlan().toString()
        lines, deep = plan.splitlines(), lambda line: len(line) - len(line.lstrip(" :+-*"))
        at = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
        above, depth = [], deep(lines[at])
        for line in reversed(lines[:at]):
            if deep(line) < depth:
                depth = deep(line)
                above.append(line)
        join = next(i for i, line in enumerate(above) if "SortMergeJoin" in line)
        assert not any("Exchange" in line for line in above[:join]), plan
        key = ["window_id", "task", "start", "channel", "t"]
        want = {tuple(r) for r in ds.fetch_windows(rows, starts, 250).select(*key, "value").collect()}
        assert {tuple(r) for r in got.select(*key, "value").collect()} == want and len(want) == starts.count() * 250 * 2
        spark.sql("drop table kept_recordings")
        again = store.open("task long, channel long, t long, value double, block long")
        assert again.count() == 6000 and {tuple(r) for r in store.fetch(starts, 250).select(*key, "value").collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table if exists kept_recordings")


def test_dense_batches_of_two_modalities(spark, tmp_path):
    emg, kin = RNG.normal(size=(7, 4, 6)), RNG.normal(size=(7, 2, 3, 6))
    x, y = from_array(spark, emg, ("batch", "channel", "t")), from_array(spark, kin, ("batch", "joint", "xyz", "t"))
    got = list(ds.batch_arrays({"emg": x}, {"kinematics": y}, 3))
    assert [(a.shape, b.shape, a.dtype) for a, b in got] == [((n, 4, 6), (n, 2, 3, 6), np.float32) for n in (3, 3, 1)]
    np.testing.assert_allclose(np.concatenate([a for a, _ in got]), emg, rtol=1e-6)
    np.testing.assert_allclose(np.concatenate([b for _, b in got]), kin, rtol=1e-6)
    lacking = y.to(y.df.where("batch not in (1, 3, 4, 5)"))
    got = list(ds.batch_arrays({"emg": x, "half": x.with_value(F.col("value") / 2)}, {"kinematics": lacking}, 3, {"emg": (4, 6)}))
    assert [sorted(a) for a, _ in got] == [["emg", "half"]] * 2 and [b["kinematics"].shape[0] for _, b in got] == [2, 1]
    np.testing.assert_allclose(np.concatenate([a["half"] for a, _ in got]), emg[[0, 2, 6]] / 2, rtol=1e-6)
    holes = ds.dense_batches(x.to(x.df.where("not (batch = 1 and channel = 2)")), 4, dtype="float64").orderBy("batch").collect()
    data = np.array(holes[0].data).reshape(holes[0].shape)
    assert holes[0]["items"] == [0, 1, 2, 3] and np.isnan(data[1, 2]).all() and np.isnan(data).sum() == 6

    recordings = {k: signal(v, ("channel", "t")).df.withColumn("task", F.lit("a")) for k, v in (("emg", from_array(spark, RNG.normal(size=(4, 200))).df), ("kinematics", from_array(spark, RNG.normal(size=(2, 200))).df))}
    ds.DatasetCreator(recordings, f"{tmp_path}/store").create()
    module = ds.DataModule(spark, f"{tmp_path}/store", window_size=10, window_stride=5, n_windows_per_epoch=11)
    assert [(a.shape, b.shape) for a, b in module.batches("train", 4)] == [((n, 4, 10), (n, 2, 10)) for n in (4, 4, 3)]
    assert sum(len(a) for a, _ in module.batches("test", 2)) == 5


def test_tasks_of_the_first_modality_and_windows_that_none_can_have(spark, tmp_path):
    one = lambda tasks, n: spark.createDataFrame([(k, 0, t, 1.0) for k in tasks for t in range(n)], "task string, channel long, t long, value double")
    ds.DatasetCreator({"emg": one("ab", 40), "kinematics": one("bcd", 40)}, f"{tmp_path}/s").create()
    assert {r.task for r in ds.read_split(spark, f"{tmp_path}/s", "kinematics", "train").select("task").distinct().collect()} == {"b"}
    assert ds.read_meta(spark, f"{tmp_path}/s")["tasks"] == ["a", "b"]
    assert ds.window_starts(one("a", 5), 6, 1).count() == 0 and ds.window_starts(one("a", 6), 6, 1, strict=True).count() == 1
    for short in (one("a", 5), one("", 0)):
        with pytest.raises(Exception, match="no recording is long enough"):
            ds.window_starts(short, 6, 1, strict=True).collect()
        with pytest.raises(Exception, match="no recording is long enough"):
            ds.random_starts(short, 6, 10, strict=True).collect()


def test_stored_training_rows_are_doubled(spark, tmp_path):
    store = ds.GroupStore(spark, f"file://{tmp_path}/g")
    rows = spark.createDataFrame([(k, 10.0 * k) for k in range(4)], "sample long, value double")
    store.add("emg", "training", rows)
    store.add("label", "training", rows.selectExpr("sample", "cast(sample as string) as value"))
    store.augment("training", {"emg": lambda df, turn: df.withColumn("value", F.col("value") + turn)}, times=2)
    assert [tuple(r) for r in store.read("emg", "training").orderBy("sample").collect()] == [(4 * turn + k, 10.0 * k + turn) for turn in range(3) for k in range(4)]
    assert [r.value for r in store.read("label", "training").orderBy("sample").collect()] == list("0123") * 3
    with pytest.raises(KeyError):
        store.augment("training", {"none": lambda df, turn: df})


def test_configuration_and_sources_of_a_run(spark, tmp_path):
    path = f"file://{tmp_path}/config"
    ds.log_config(spark, path, "r1", {"model": {"width": 8, "layers": [1, 2]}, "rate": 0.5, "none": None})
    ds.log_config(spark, path, "r2", {"rate": 0.25})
    assert ds.read_config(spark, path, "r1") == {"model.width": 8, "model.layers": [1, 2], "rate": 0.5, "none": None}
    ds.log_sources(spark, f"file://{tmp_path}/src", "r1", {"a.py": "x = 1\n", "b.py": ""})
    assert {(r.run_id, r.name, r.text) for r in spark.read.parquet(f"file://{tmp_path}/src").collect()} == {("r1", "a.py", "x = 1\n"), ("r1", "b.py", "")}
