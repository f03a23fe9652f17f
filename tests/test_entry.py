import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from sigloom.plans import catalog

SF = "/root/testdata/sf0.001"


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(tuple(f"{v:.5g}" if isinstance(v, float) else str(v) for v in r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))


def test_entry(spark):
    assert driver.entry(spark).columns == ["channel", "t", "value"]
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", ["win_rms", "zscore_time", "pad_reflect", "spatial_ndd", "bandpass", "notch", "split_center_val", "windows_fetch", "time_warp_apply", "emg_features", "pserf", "align_product", "time_shift_edge_beyond", "noise_draw", "sos_both_ways", "windows_random", "supervised_pairs", "store_roundtrip", "embc_eval", "bandpass_blocks", "notch_blocks", "sos_continuous", "sos_overlap", "win_entropy", "stack_windows", "wavelet_db2", "index_mask", "npy_scan", "dense_batches", "windows_fetch_store", "grid_layout_column", "flatten"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert rows_of(got) == rows_of(want) and len(got)
