"""Registered queries of the signal operators over the test tables, and the same results as DuckDB SQL.

``events`` is read as one series per user, ``embeddings`` as an 8x8 electrode grid over time, ``orders`` as a
second modality. Values are rounded to six places on both sides, as sums may differ in their last bits.
"""

from __future__ import annotations

import random
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..frame import Compose, Identity, Lambda, SignalFrame, signal
from ..functions import elementwise as e
from ..operators import augment as g, filters as fl, indexing as ix, normalize as n, shape as s, spatial as sp, wavelets as wv, windows as w
from ..sources import arrays as ar, datasets as ds
from ..sources.containers import Recording
from . import presets

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def events(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> SignalFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "value")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return signal(df.select(F.col("user_id").alias("channel"), t.alias("t"), (F.col("value") * scale).alias("value")), ("channel", "t"), fs=2048.0)


def grid_signal(spark: SparkSession, sf_dir: str, missing: list[tuple[int, int]] | None = None) -> SignalFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("channel", "value"))
    return signal(df, ("channel", "t"), grids=sp.create_grid_layout(spark, 8, 8, missing=missing))


EV = "ev as (select user_id as channel, row_number() over (partition by user_id order by event_id) - 1 as t, value::double as value from events)"
LEN = "len as (select channel, max(t) + 1 as n from ev group by channel)"
EMB = "em as (select vec_id as t, unnest(range(0, 64)) as channel, unnest(embedding)::double as value from embeddings)"


def _add(name: str, build: Callable[[SparkSession, str], SignalFrame | DataFrame], sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = build(spark, sf_dir)
        return out.df.withColumn("value", F.round(F.col("value"), 6) + F.lit(0.0)) if isinstance(out, SignalFrame) else out

    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


def _ev(name: str, op: Callable[[SignalFrame], SignalFrame], select: str, rest: str = "from ev", axes: str = "channel, t", scale: float = 1.0, more: str = "") -> None:
    """A query over ``events``: its operator, and SQL for its value and source."""
    source = EV if scale == 1.0 else EV.replace("value::double", f"value::double * {scale!r}::double")
    _add(name, lambda spark, d: op(events(spark, d, scale)), f"with recursive {source}, {LEN}{more and ', ' + more} select {axes}, round({select}, 6) + 0.0::double as value {rest}")


# Windows. In SQL, each sample joins the windows that hold it.
def _windowed(size: int, stride: int) -> str:
    return f"""win as (select e.channel, k.k as win, e.t - k.k * {stride} as pos, e.value, lag(e.value) over o as p1, lag(e.value, 2) over o as p2
        from len l, unnest(range(0, greatest(0, (l.n - {size}) // {stride} + 1))) k(k), ev e
        where l.n >= {size} and e.channel = l.channel and e.t between k.k * {stride} and k.k * {stride} + {size - 1}
        window o as (partition by e.channel, k.k order by e.t))"""


for _name, _op, _value in [
    ("rms", w.RMS, "sqrt(avg(value * value))"), ("mav", w.MAV, "avg(abs(value))"), ("var", w.VAR, "var_samp(value)"), ("iav", w.IAV, "sum(abs(value))"),
    ("zero_crossings", w.ZeroCrossings, "coalesce(sum((sign(value) <> sign(p1))::int)::double, 0)"), ("waveform_length", w.WaveformLength, "coalesce(sum(abs(value - p1)), 0)"),
    ("slope_sign_changes", w.SlopeSignChanges, "coalesce(sum((sign(value - p1) <> sign(p1 - p2))::int)::double, 0)"),
]:
    _centre = "zero" in _name
    for _size, _stride, _suffix in ((16, 8, ""), (16, 16, "_nonoverlap"), (5, 7, "_gaps")):
        if _suffix and _name not in ("rms", "slope_sign_changes"):
            continue
        _src = "value - 100" if _centre else "value"
        _ev(f"win_{_name}{_suffix}", (lambda o, a, b, c: lambda x: o(a, b)(x.with_value(F.col("value") - 100) if c else x))(_op, _size, _stride, _centre), _value, "from win group by channel, win", "channel, win as t", more=("e2 as (select channel, t, value - 100 as value from ev), " if _centre else "") + (_windowed(_size, _stride).replace("ev e", "e2 e") if _centre else _windowed(_size, _stride)))
_ev("win_var_biased", w.VAR(16, 8, ddof=0), "var_pop(value)", "from win group by channel, win", "channel, win as t", more=_windowed(16, 8))
_ev("win_zero_crossings_halved", lambda x: w.ZeroCrossings(16, 8, halved=True)(x.with_value(F.col("value") - 100)), "coalesce(sum(floor(abs(sign(value - 100) - sign(p1 - 100)) / 2))::double, 0)", "from win group by channel, win", "channel, win as t", more=_windowed(16, 8))
_ev("win_slope_sign_changes_halved", w.SlopeSignChanges(16, 8, halved=True), "coalesce(sum(floor(abs(sign(value - p1) - sign(p1 - p2)) / 2))::double, 0)", "from win group by channel, win", "channel, win as t", more=_windowed(16, 8))
_ev("chunks", w.Chunk(20, 10), "value", "from win", "channel, win as chunk, pos as t", more=_windowed(20, 10))
_ev("median_filter", w.Median(5), "m", "from (select e.channel, e.t, q.m from ev e join len using (channel) join (select channel, t, median(value) over (partition by channel order by t rows between 2 preceding and 2 following) as m from ev) q on q.channel = e.channel and q.t = least(greatest(e.t, 2), n - 3))")

# Functions of whole windows that aren't aggregates of a column.
def _entropy(v: np.ndarray) -> np.ndarray:
    p = np.abs(v) / np.abs(v).sum(axis=1, keepdims=True)
    return -(p * np.log(np.where(p > 0, p, 1))).sum(axis=1)


def _kurtosis(v: np.ndarray) -> np.ndarray:
    d = v - v.mean(axis=1, keepdims=True)
    return (d**4).mean(axis=1) / (d**2).mean(axis=1) ** 2


_win_of = "from (select *, sum(abs(value)) over c as total, avg(value) over c as mean from win window c as (partition by channel, win)) group by channel, win"
_ev("win_entropy", w.WindowFunction(16, 8, _entropy), "sum(case when value <> 0 then -abs(value) / total * ln(abs(value) / total) else 0 end)", _win_of, "channel, win as t", more=_windowed(16, 8))
_ev("win_kurtosis_gaps", w.WindowFunction(5, 7, _kurtosis), "avg((value - mean) ** 4) / avg((value - mean) ** 2) ** 2", _win_of, "channel, win as t", more=_windowed(5, 7))
_ev("stack_windows", s.Stack({"wl": Compose([e.Rectify(), w.WaveformLength(16, 8)]), "rms": Compose([e.Rectify(), w.RMS(16, 8)]), "entropy": Compose([e.Rectify(), w.WindowFunction(16, 8, _entropy)]), "sum": Compose([Identity(), e.Rectify(), w.IAV(16, 8)])}), "case r when 0 then f0 when 1 then f1 when 2 then f2 else f3 end", "from agg, (values (0), (1), (2), (3)) v(r)", "r::bigint as representation, channel, t", more=_windowed(16, 8) + ", agg as (select channel, win as t, coalesce(sum(abs(abs(value) - abs(p1))), 0) as f0, sqrt(avg(value * value)) as f1, sum(case when value <> 0 then -abs(value) / total * ln(abs(value) / total) else 0 end) as f2, sum(abs(value)) as f3 from (select *, sum(abs(value)) over (partition by channel, win) as total from win) group by channel, win)")

# Elementwise.
_ev("rectify", lambda x: e.Rectify()(x.with_value(F.col("value") - 100)), "abs(value - 100)")
_ev("clamp_range", e.ClampRange(20, 200), "least(greatest(value, 20), 200)")
_ev("standardize", e.Standardize(50.0, 12.5), "(value - 50.0::double) / (12.5::double + 1e-8)")
_ev("standardize_by_channel", lambda x: e.Standardize(n.Mean()(x), 2.0)(x), "(value - m) / (2.0::double + 1e-8)", "from ev join (select channel, avg(value) as m from ev group by channel) using (channel)")
_ev("diff_1", s.Diff(1), "value - p", "from (select channel, t - 1 as t, value, lag(value) over (partition by channel order by t) as p from ev) where p is not null")
_ev("diff_2", s.Diff(2), "value - 2 * p + q", "from (select channel, t - 2 as t, value, lag(value) over o as p, lag(value, 2) over o as q from ev window o as (partition by channel order by t)) where q is not null")
_ev("weighted_sum", lambda x: e.weighted_sum(x, e.Rectify()(x), 0.25), "0.25::double * value + 0.75::double * abs(value)")
_ev("lambda_sql", Lambda("value * 2 + 1"), "value * 2 + 1")
_ev("identity", Identity(), "value")
_SERIES = "list_sum(list_transform(range(0, 200), lambda n: exp(n * ln(4.0::double) + (2 * n + 1) * ln(abs(z)) + lgamma(n + 1.0::double) - lgamma(2 * n + 2.0::double))))"
_ERF = f"case when abs(z) > 6 then sign(z)::double when z = 0 then 0.0::double else 2 / sqrt(pi()) * exp(-z * z) * sign(z) * {_SERIES} end"
_ev("pserf", Lambda(lambda v: e.pserf(v / 500)), f"v * ({_ERF}) + 1e-12", "from (select *, ln(1 + exp(1.25::double * v)) as z from (select *, value / 500 as v from ev))")
_ev("sau", Lambda(lambda v: e.sau(v / 500 - 0.2)), f"sqrt(2 / pi()) * exp(-4e8::double * v * v / 2) / 4e4::double + 1.15::double / 2 * v + 0.85::double / 2 * v * ({_ERF})", "from (select *, 2e4::double * v / sqrt(2.0::double) as z from (select *, value / 500 - 0.2::double as v from ev))")
_ev("smu", Lambda(lambda v: e.smu(v / 500 - 0.2)), f"(1.01::double * v + 0.99::double * v * ({_ERF})) / 2", "from (select *, 2.5::double * 0.99::double * v as z from (select *, value / 500 - 0.2::double as v from ev))")
_ev("align_scalar", lambda x: e.weighted_sum(x, n.Mean("channel")(n.Mean()(x)), 0.25), "0.25::double * value + 0.75::double * (select avg(m) from (select avg(value) as m from ev group by channel))")
_ev("align_product", lambda x: e.weighted_sum(n.Mean()(x), n.Mean("channel")(x), 0.25), "0.25::double * a.m + 0.75::double * b.m", "from (select channel, avg(value) as m from ev group by channel) a, (select t, avg(value) as m from ev group by t) b", "a.channel, b.t")

# Normalisation and reductions.
_over = "over (partition by {})".format
_ev("zscore_time", n.ZScore("t"), f"(value - avg(value) {_over('channel')}) / (stddev_samp(value) {_over('channel')} + 1e-8)")
_ev("zscore_channel", n.ZScore("channel"), f"(value - avg(value) {_over('t')}) / (coalesce(stddev_samp(value) {_over('t')}, 'nan'::double) + 1e-8)", "from ev")
_mm = f"(value - min(value) {_over('channel')}) / (max(value) {_over('channel')} - min(value) {_over('channel')} + 1e-8)"
_ev("minmax", n.MinMax(), _mm)
_ev("minmax_range", n.MinMax(range=(-1.0, 1.0)), f"{_mm} * 2.0::double - 1.0::double")
_ev("lp_norm_l1", n.Normalize(1, "t"), f"value / greatest(sum(abs(value)) {_over('channel')}, 1e-8)")
_ev("lp_norm_l2", n.Normalize(2, "t"), f"value / greatest(sqrt(sum(value * value) {_over('channel')}), 1e-8)")
_ev("lp_norm_inf", n.Normalize(float("inf"), "t"), f"value / greatest(max(abs(value)) {_over('channel')}, 1e-8)")
for _name, _op, _by in (("instance_norm", n.InstanceNorm(), "channel"), ("layer_norm", n.LayerNorm(1), "channel"), ("batch_norm", n.BatchNorm(), "t")):
    _ev(_name, _op, f"(value - avg(value) {_over(_by)}) / sqrt(var_pop(value) {_over(_by)} + 1e-5)")
_add("grid_norm", lambda spark, d: n.GridNorm(16)(grid_signal(spark, d)), f"with {EMB} select channel, t, round((value - avg(value) over (partition by channel // 16)) / (stddev_samp(value) over (partition by channel // 16) + 1e-15), 6) + 0.0::double as value from em")
_ev("mean_time", n.Mean(), "avg(value)", "from ev group by channel", "channel")
_ev("mean_time_keepdim", n.Mean(keepdim=True), "avg(value)", "from ev group by channel", "channel, 0::bigint as t")
_ev("sum_time", n.Sum(), "sum(value)", "from ev group by channel", "channel")
_ev("mean_channel", n.Mean("channel"), "avg(value)", "from ev group by t", "t")


def _joints(spark: SparkSession, sf_dir: str) -> SignalFrame:
    x = grid_signal(spark, sf_dir)
    return x.to(x.df.where("channel < 63").selectExpr("t as batch", "channel div 3 as joint", "channel % 3 as xyz", "value"), ("batch", "joint", "xyz"))


_add("euclidean_distance", lambda spark, d: n.euclidean_distance(_joints(spark, d), g.Scale(0.5)(_joints(spark, d))).select(F.round("value", 6).alias("value")), f"with {EMB} select round(avg(d), 6) as value from (select sqrt(sum((value * 0.5::double) ** 2)) as d from em where channel < 63 group by t, channel // 3)")
_add("mae", lambda spark, d: n.mean_absolute_error(events(spark, d), g.Scale(0.5)(events(spark, d))).select(F.round("value", 6).alias("value")), f"with {EV} select round(avg(abs(value - value * 0.5::double)), 6) as value from ev")
_add("memory_usage", lambda spark, d: n.memory_usage(events(spark, d), "channel"), f"with {EV} select channel, count(*) * 8 as n_bytes from ev group by channel")

# Shape.
_ev("index_int", s.Index(3, "t"), "value", "from ev where t = 3", "channel")
_ev("index_negative", lambda x: s.Index(-1, "channel")(x), "value", "from ev where channel = (select max(channel) from ev)", "t")
_ev("index_slice", s.Index(slice(4, 40, 3), "t"), "value", "from ev where t >= 4 and t < 40 and (t - 4) % 3 = 0", "channel, (t - 4) // 3 as t")
_ev("index_gather", s.Index([7, 2, 2, 0], "t"), "value", "from ev join (values (0, 7), (1, 2), (2, 2), (3, 0)) g(pos, src) on t = src", "channel, pos::bigint as t")
_ev("index_pairs", ix.IndexPairs({"channel": [0, 5, 5, 2], "t": [3, 0, 44, 1]}), "value", "from ev join (values (0, 0, 3), (1, 5, 0), (2, 5, 44), (3, 2, 1)) g(pos, c, k) on ev.channel = c and ev.t = k", "pos::bigint as channel")
_ev("index_mask", lambda x: ix.IndexMask(x.to(x.df.withColumn("value", (F.col("value") > 100).cast("double"))), block=64)(x), "value", "from ev where value > 100", "row_number() over (order by channel, t) - 1 as channel")
_ev("index_expression", ix.At((Ellipsis, [True, False, False, True, True])), "value", "from ev join (values (0, 0), (1, 3), (2, 4)) g(pos, src) on t = src", "channel, pos::bigint as t")
_add("reshape", lambda spark, d: s.Reshape((-1, 4, 16), ("t", "row", "col"), (None, 64))(grid_signal(spark, d).to(grid_signal(spark, d).df, ("t", "channel"))), f"with {EMB} select t, channel // 16 as row, channel % 16 as col, round(value, 6) + 0.0::double as value from em")
_add("flatten", lambda spark, d: s.Flatten(1, 2, [3])(_joints(spark, d)), f"with {EMB} select t as batch, channel as joint, round(value, 6) + 0.0::double as value from em where channel < 63")
_ev("squeeze_unsqueeze", Compose([s.Unsqueeze(0, "batch"), s.Unsqueeze(-1, "extra"), s.Squeeze("extra")]), "value", axes="0::bigint as batch, channel, t")
_ev("transpose", s.Transpose(["t", "channel"]), "value")
_ev("repeat", s.Repeat(3), "value", "from ev, unnest(range(0, 3)) r(r)", "channel + r * (select max(channel) + 1 from ev) as channel, t")
_PLACES = {"constant": "j", "reflect": "case when (j % (2 * (n - 1)) + 2 * (n - 1)) % (2 * (n - 1)) <= n - 1 then (j % (2 * (n - 1)) + 2 * (n - 1)) % (2 * (n - 1)) else 2 * (n - 1) - (j % (2 * (n - 1)) + 2 * (n - 1)) % (2 * (n - 1)) end", "replicate": "least(greatest(j, 0), n - 1)", "circular": "(j % n + n) % n"}
for _mode, _src in _PLACES.items():
    _ev(f"pad_{_mode}", s.Pad((70, 40), mode=_mode, fill=1.5), "coalesce(value, 1.5)", f"from (select channel, j, {_src} as src from len, unnest(range(-70, n + 40)) u(j)) p left join ev on ev.channel = p.channel and ev.t = p.src", "p.channel, p.j + 70 as t")
_ev("stack_repr", s.Stack({"raw": Identity(), "abs": e.Rectify()}), "case r when 0 then value else abs(value) end", "from ev, (values (0), (1)) v(r)", "r::bigint as representation, channel, t")
_ev("concat_channel", s.Concat({"raw": Identity(), "double": g.Scale(2.0)}), "value * (1 + r)", "from ev, (values (0), (1)) v(r)", "channel + r * (select max(channel) + 1 from ev) as channel, t")


# Grids and spatial filters.
_GAPS = [(0, 0), (2, 3), (5, 5)]


def _spatial_sql(kernel: list[list[float]], gaps: list[tuple[int, int]] | None = None) -> str:
    hole = " or ".join(f"(r = {r} and c = {c})" for r, c in gaps or []) or "false"
    weights = ", ".join(f"({i - 1}, {j - 1}, {float(v)!r}::double)" for i, row in enumerate(kernel) for j, v in enumerate(row) if v)
    return f"""with {EMB}, cell as (select r, c, row_number() over (order by r, c) - 1 as channel from range(0, 8) a(r), range(0, 8) b(c) where not ({hole})),
        k as (select * from (values {weights}) k(dr, dc, weight))
        select o.channel, em.t, round(sum(em.value * weight), 6) + 0.0::double as value from cell o, k, cell i, em
        where i.r = o.r + k.dr and i.c = o.c + k.dc and em.channel = i.channel group by o.channel, em.t"""


def _cells(spark: SparkSession, sf_dir: str) -> SignalFrame:
    x = grid_signal(spark, sf_dir)
    return x.to(x.df.selectExpr("t", "channel div 8 as row", "channel % 8 as col", "value"), ("t", "row", "col"))


_CUSTOM = [[0, 1, 0], [1, 2, 1], [0, 1, 0.5]]
for _name, _kernel in {**sp.KERNELS, "custom": _CUSTOM}.items():
    if _name != "identity":
        _add(f"spatial_{_name.lower()}", (lambda k: lambda spark, d: sp.SpatialFilter(k)(grid_signal(spark, d)))(_kernel), _spatial_sql(_kernel))
_add("spatial_with_gaps", lambda spark, d: sp.SpatialFilter("NDD")(grid_signal(spark, d, _GAPS)), _spatial_sql(sp.KERNELS["NDD"], _GAPS))
_add("spatial_other_grid_passes", lambda spark, d: sp.SpatialFilter("NDD", grids=[1])(grid_signal(spark, d)), f"with {EMB} select channel, t, round(value, 6) + 0.0::double as value from em")
_add("spatial_valid", lambda spark, d: sp.SpatialFilter("IR", valid=True)(grid_signal(spark, d)), _spatial_sql(sp.KERNELS["IR"]).replace("select o.channel,", "select (o.r - 1) * 6 + o.c - 1 as channel,").replace("where i.r", "where o.r between 1 and 6 and o.c between 1 and 6 and i.r").replace("group by o.channel,", "group by o.r, o.c,"))
_add("split_by_grid", lambda spark, d: s.split_by_grid(grid_signal(spark, d), 16), f"with {EMB} select channel // 16 as grid, channel % 16 as channel, t, round(value, 6) + 0.0::double as value from em")
_add("grid_round_trip", lambda spark, d: sp.grid_to_channels(sp.channels_to_grid(grid_signal(spark, d, _GAPS)), grid_signal(spark, d, _GAPS).grids), f"with {EMB} select channel, t, round(value, 6) + 0.0::double as value from em where channel < 61")
_add("circular_pad", lambda spark, d: s.circular_pad(_cells(spark, d), "row", "col", 2, 3), f"with {EMB} select t, r + 2 as row, c + 3 as col, round(value, 6) + 0.0::double as value from range(-2, 10) a(r), range(-3, 11) b(c), em where channel = (r + 8) % 8 * 8 + (c + 8) % 8")
_add("channels_to_grid", lambda spark, d: sp.channels_to_grid(grid_signal(spark, d)), f"with {EMB} select 0 as grid, channel // 8 as row, channel % 8 as col, t, round(value, 6) + 0.0::double as value from em")


def _label_grids(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    """A grid of 8 columns per label, with an electrode for each of its vectors and a gap in its second row."""
    count = F.count("*")
    sizes = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy(F.col("label").alias("grid")).agg(F.greatest(F.lit(2), F.ceil((count + 1) / 8)).cast("int").alias("n_rows"), F.lit(8).alias("n_cols"), count.alias("n_electrodes"))
    return sp.grid_layouts(sizes, sizes.select("grid", F.lit(1).alias("row"), (F.col("grid") % 8).alias("col")), pattern)


_GRID_SQL = """sz as (select label as grid, greatest(2, ceil((count(*) + 1) / 8.0::double))::int as n_rows, count(*) as n from embeddings group by label),
    cell as (select grid, r, c, n, r = 1 and c = grid % 8 as gap from sz, unnest(range(0, n_rows)) a(r), range(0, 8) b(c)),
    lay as (select grid, r::int as row, c::int as col, case when gap or sum((not gap)::int) over (partition by grid order by {}) > n then -1 else sum((not gap)::int) over (partition by grid order by {}) - 1 end::int as electrode from cell)"""
for _pattern, _order in (("row", "r, c"), ("column", "c, r")):
    _add(f"grid_layout_{_pattern}", (lambda p: lambda spark, d: _label_grids(spark, d, p))(_pattern), f"with {_GRID_SQL.format(_order, _order)} select * from lay")
_add("grid_dims", lambda spark, d: sp.grid_dimensions(_label_grids(spark, d, "row")), f"with {_GRID_SQL.format('r, c', 'r, c')} select grid, max(row) + 1 as n_rows, max(col) + 1 as n_cols, sum((electrode >= 0)::int) as n_electrodes from lay group by grid")


# Filters. In SQL, a pass is a recursion over t for all series at once.
def _iir(sections: list[fl.Section], clamp: bool, src: str = "ev", tag: str = "") -> tuple[str, str]:
    """The passes' table expressions, and the last one's name."""
    parts = []
    for i, (b0, b1, b2, a1, a2) in enumerate(sections):
        parts.append(f"""r{tag}{i} as (select channel, 0::bigint as t, {b0!r}::double * value as y, value as x1, 0.0::double as x2, 0.0::double as y1 from {src} where t = 0
            union all select r.channel, s.t, {b0!r}::double * s.value + {b1!r}::double * r.x1 + {b2!r}::double * r.x2 - {a1!r}::double * r.y - {a2!r}::double * r.y1, s.value, r.x1, r.y
            from r{tag}{i} r join {src} s on s.channel = r.channel and s.t = r.t + 1)""")
        parts.append(f"f{tag}{i} as (select channel, t, {'least(greatest(y, -1.0::double), 1.0::double)' if clamp else 'y'} as value from r{tag}{i})")
        src = f"f{tag}{i}"
    return ", ".join(parts), src


def _iir_sql(sections: list[fl.Section], clamp: bool, scale: float) -> str:
    parts, last = _iir(sections, clamp)
    return f"with recursive {EV.replace('value::double', f'value::double * {scale!r}::double')}, {parts} select channel, t, round(value, 6) + 0.0::double as value from {last}"


for _name, _op, _scale in [
    ("highpass", fl.highpass(20.0, 2048.0), 0.002), ("lowpass", fl.lowpass(20.0, 2048.0), 0.002), ("bandpass", fl.bandpass(20.0, 450.0, 2048.0), 0.002),
    ("lowpass_clamped", fl.lowpass(400.0, 2048.0, 2), 1.0), ("lowpass_noclamp", fl.lowpass(20.0, 2048.0, clamp=False), 1.0),
]:
    _add(_name, (lambda o, c: lambda spark, d: o(events(spark, d, c)))(_op, _scale), _iir_sql(_op.sections, _op.clamp, _scale))
_BOTH = fl.Sections(fl.lowpass(20.0, 2048.0, 2, clamp=False).sections, clamp=False, both_ways=True)
_there, _last = _iir(_BOTH.sections, False)
_back, _end = _iir(_BOTH.sections, False, "rv", "b")
_ev("sos_both_ways", _BOTH, "value", f"from {_end} join len using (channel)", "channel, n - 1 - t as t", more=f"{_there}, rv as (select channel, n - 1 - t as t, value from {_last} join len using (channel)), {_back}")


def _notch(freq: float, width: float, src: str, tag: str) -> str:
    """Table expressions of a notch; the last one is ``gone`` with the tag."""
    return f"""bin{tag} as (select channel, n, unnest(range(greatest(0, ceil({freq - width / 2}::double * n / 2048.0::double))::bigint, least(floor({freq + width / 2}::double * n / 2048.0::double), n // 2)::bigint + 1)) as k from len),
        co{tag} as (select channel, n, k, sum(value * cos(2 * pi() * ((k * t) % n) / n)) as re, sum(value * sin(2 * pi() * ((k * t) % n) / n)) as im from bin{tag} join {src} using (channel) group by channel, n, k),
        back{tag} as (select channel, t, sum(case when k = 0 or 2 * k = n then 1.0::double else 2.0::double end / n * (re * cos(2 * pi() * ((k * t) % n) / n) + im * sin(2 * pi() * ((k * t) % n) / n))) as gone from co{tag} join {src} using (channel) group by channel, t),
        gone{tag} as (select channel, t, value - coalesce(gone, 0) as value from {src} left join back{tag} using (channel, t))"""


_ev("notch", fl.Notch(300.0, 60.0, 2048.0), "value", "from gone", more=_notch(300.0, 60.0, "ev", ""))
_ev("spectral_interpolation", Compose(fl.spectral_interpolation(300.0, 2048.0, 60.0, 2)), "value", "from gone2", more=f"{_notch(300.0, 60.0, 'ev', '1')}, {_notch(600.0, 60.0, 'gone1', '2')}")

# The same filters with every series in blocks of 16 samples, so the shortest one has several: the SQL is that of the whole series.
for _name, _op, _scale in [("bandpass_blocks", fl.bandpass(20.0, 450.0, 2048.0, block=16), 0.002), ("lowpass_clamped_blocks", fl.lowpass(400.0, 2048.0, 2, block=16), 1.0), ("lowpass_noclamp_blocks", fl.lowpass(20.0, 2048.0, clamp=False, block=16), 1.0)]:
    _add(_name, (lambda o, c: lambda spark, d: o(events(spark, d, c)))(_op, _scale), _iir_sql(_op.sections, _op.clamp, _scale))
_add("sos_both_ways_blocks", lambda spark, d: fl.Sections(_BOTH.sections, clamp=False, both_ways=True, block=16)(events(spark, d)), _SQL["sos_both_ways"])
_add("notch_blocks", lambda spark, d: fl.Notch(300.0, 60.0, 2048.0, block=16)(events(spark, d)), _SQL["notch"])


def _chunked(x: SignalFrame, size: int = 16) -> SignalFrame:
    return x.to(x.df.withColumns({"chunk": F.floor(F.col("t") / size), "t": F.col("t") % size}), ("channel", "chunk", "t"))


_SOS = fl.lowpass(20.0, 2048.0, 2, clamp=False).sections
_passes, _out = _iir(_SOS, False)
_ev("sos_continuous", lambda x: fl.ChunkedSections(_SOS, 16, clamp=False)(_chunked(x)), "value", f"from {_out}", "channel, t // 16 as chunk, t % 16 as t", more=_passes)
_ev("sos_continuous_blocks", lambda x: fl.ChunkedSections(_SOS, 16, clamp=False, block=24)(_chunked(x)), "value", f"from {_out}", "channel, t // 16 as chunk, t % 16 as t", more=_passes)
# Chunks that start from silence, after up to six samples of the one before: each is a series of its own in the SQL.
for _name, _overlap in (("sos_overlap", 6), ("sos_by_chunk", 0)):
    _passes, _out = _iir(_SOS, False, "ch")
    _pieces = f"ch as (select e.channel * 1000 + c.c as channel, e.t - greatest(0, c.c * 16 - {_overlap}) as t, e.value from ev e join len using (channel), range(0, 1000) c(c) where c.c * 16 < n and e.t >= c.c * 16 - {_overlap} and e.t < c.c * 16 + 16)"
    _ev(_name, (lambda o: lambda x: fl.ChunkedSections(_SOS, 16, clamp=False, continuous=False, overlap=o)(_chunked(x)))(_overlap), "value", f"from (select channel // 1000 as channel, channel % 1000 as chunk, t + greatest(0, channel % 1000 * 16 - {_overlap}) - channel % 1000 * 16 as t, value from {_out}) where t >= 0", "channel, chunk, t", more=f"{_pieces}, {_passes}")


# Wavelets. In SQL, each level joins its coefficients with the places of their taps.
def _wavelet(wavelet: str, level: int) -> str:
    low, high = wv.taps(wavelet)
    values = ", ".join(f"({j}, {h!r}::double, {g!r}::double)" for j, (h, g) in enumerate(zip(low, high, strict=True)))
    parts = [f"tap as (select * from (values {values}) v(j, h, g))", "a0 as (select channel, t, value, n from ev join len using (channel))"]
    for k in range(1, level + 1):
        parts.append(f"""w{k} as (select s.channel, c as t, sum(e.value * h) as value, sum(e.value * g) as high, (s.n + 1) // 2 as n
            from (select distinct channel, n from a{k - 1}) s, unnest(range(0, (s.n + 1) // 2)) u(c), tap, a{k - 1} e
            where e.channel = s.channel and e.t = least((2 * c + j) % (s.n + s.n % 2), s.n - 1) group by s.channel, c, s.n)""")
        parts.append(f"a{k} as (select channel, t, value, n from w{k})")
    return ", ".join(parts)


for _wavelet_name in ("haar", "db2"):
    _bands = f"select 0::bigint as band, channel, t, value from w2 {' '.join(f'union all select {3 - k}, channel, t, high from w{k}' for k in (1, 2))}"
    _ev(f"wavelet_{_wavelet_name}", wv.Decompose(_wavelet_name, 2), "value", f"from ({_bands})", "band, channel, t", more=_wavelet(_wavelet_name, 2))
_add("wavelet_roundtrip", lambda spark, d: wv.Reconstruct(events(spark, d).df.groupBy("channel").agg((F.max("t") + 1).alias("n")), "db2", 3)(wv.Decompose("db2", 3)(events(spark, d))), f"with {EV} select channel, t, round(value, 6) + 0.0::double as value from ev")
_add(
    "wavelet_augment", lambda spark, d: wv.WaveletDecomposition([0.5, 2.0, 0.0], "haar", 1, 16)(grid_signal(spark, d)),
    f"""with {EMB}, pair as (select a.channel, a.t, a.value, (a.value + coalesce(b.value, a.value)) / 2 as smooth from em a left join em b on b.channel = a.channel and b.t = case when a.t % 2 = 0 then a.t + 1 else a.t - 1 end)
        select channel, t, round(smooth + (value - smooth) * case channel // 16 when 0 then 0.5::double when 1 then 2.0::double when 2 then 0.0::double else 1.0::double end, 6) + 0.0::double as value from pair""",
)

# Augmentation with given draws, then drawn ones (rows only).
_lin = "from (select channel, t, value, n, t * 3.0::double / (n - 1) as ap from ev join len using (channel))"
_ev("magnitude_warp_apply", g.MagnitudeWarp([1.0, 0.8, 1.3, 0.9]), "value * (lo + (hi - lo) * (ap - k))", "from (select *, ([1.0, 0.8, 1.3, 0.9]::double[])[k + 1] as lo, ([1.0, 0.8, 1.3, 0.9]::double[])[least(k + 2, 4)] as hi from (select *, least(floor(ap), 2)::int as k " + _lin + "))")
_SHIFTS = [0.0, 0.1, -0.2, 0.15, 0.15]
_ev(
    "time_warp_apply", g.TimeWarp(_SHIFTS), "a.value * (1 - f) + b.value * f",
    """from (select *, src - floor(src) as f from (select channel, t, n, k1 + (k2 - k1) * (ap - k) as src from (select *,
        least(greatest(k * (n - 1) / 4.0::double + (s)[k + 1] * (n / 3.0::double), 0), n - 1) as k1, least(greatest((k + 1) * (n - 1) / 4.0::double + (s)[k + 2] * (n / 3.0::double), 0), n - 1) as k2
        from (select channel, t, n, t * 4.0::double / (n - 1) as ap, least(floor(t * 4.0::double / (n - 1)), 3)::int as k, [0.0, 0.1, -0.2, 0.15, 0.15]::double[] as s from ev join len using (channel))))) w
        join ev a on a.channel = w.channel and a.t = floor(src)::bigint join ev b on b.channel = w.channel and b.t = least(floor(src)::bigint + 1, n - 1)""", "w.channel, w.t",
)
for _s, _tag in ((9, ""), (-9, "_left"), (120, "_beyond"), (-120, "_left_beyond"), (0.25, "_fraction"), (-0.25, "_left_fraction")):
    _by = f"{_s}" if isinstance(_s, int) else f"trunc(n * {_s}::double)::bigint"  # 120 is more than any series has
    _of = f"from (select *, {_by} as s from ev join len using (channel))"
    _ev(f"time_shift_zero{_tag}", g.TimeShift(_s, "zero"), "case when (s > 0 and pl < s) or (s <= 0 and pl >= n + s) then 0.0::double else value end", f"from (select *, ((t + s) % n + n) % n as pl {_of})", "channel, pl as t")
    _ev(f"time_shift_wrap{_tag}", g.TimeShift(_s, "wrap"), "value", _of, "channel, ((t + s) % n + n) % n as t")
    for _fill, _at in (("edge", "case when s > 0 then least(s, n - 1) else greatest(n + s - 1, 0) end"), ("edge_true", "case when s > 0 then 0 else n - 1 end")):
        _ev(f"time_shift_{_fill}{_tag}", g.TimeShift(_s, _fill), "b.value", f"from (select channel, t, case when t - s between 0 and n - 1 then t - s else {_at} end as src {_of}) q join ev b on b.channel = q.channel and b.t = q.src", "q.channel, q.t")
_ev("scale_apply", g.Scale(1.1), "value * 1.1::double")
_ev("cutout_apply", g.Cutout([5, 12], 10), "case when t between 5 and 14 or t between 12 and 21 then 0.0::double else value end")
_ev("cutout_fraction", g.Cutout([0.5], 0.2), "case when t >= s and t < s + l then 0.0::double else value end", "from (select *, floor((n - l + 1) * 0.5::double) as s from (select *, floor(n * 0.2::double) as l from ev join len using (channel)))")
_ev("drop_slices_apply", g.DropSlices([1, 7], "channel"), "case when channel in (1, 7) then 0.0::double else value end")
_add("channel_permute_apply", lambda spark, d: g.ChannelPermute([(7 * i + 3) % 64 for i in range(64)])(grid_signal(spark, d)), f"with {EMB} select i as channel, t, round(value, 6) + 0.0::double as value from em join range(0, 64) p(i) on channel = (7 * i + 3) % 64")
_GRID_KNOTS = [[1.0, 0.5], [2.0, 1.0, 3.0], [0.1, 0.9], [1.5, 1.5]]
_curves = " ".join(f"when {k} then {' + '.join(f'{v!r}::double * greatest(0, 1 - abs(t * {len(c) - 1}.0::double / (n - 1) - {i}))' for i, v in enumerate(c))}" for k, c in enumerate(_GRID_KNOTS))
_add("magnitude_warp_by_grid", lambda spark, d: g.GridMagnitudeWarp(_GRID_KNOTS)(grid_signal(spark, d)), f"with {EMB} select channel, t, round(value * case channel // 16 {_curves} end, 6) + 0.0::double as value from em, (select max(vec_id) + 1 as n from embeddings)")


def _uniform_sql(seed: int, turn: int = 0, axes: tuple[str, ...] = ("channel", "t")) -> str:
    h = f"{(seed * 7_919 + turn * 104_729 + 1) % (1 << 32)}::bigint"
    for a in axes:
        for m in g._MIX:
            h = f"(xor({h}, {a}) % 2147483648 * {m} % 4294967296)"
            h = f"xor({h}, {h} >> 15)"
    return f"({h} / 4294967296.0::double)"


def _normal_sql(seed: int, axes: tuple[str, ...] = ("channel", "t")) -> str:
    return f"sqrt(-2 * ln(1 - {_uniform_sql(seed, 1, axes)})) * cos(6.283185307179586::double * {_uniform_sql(seed, 2, axes)})"


_NORMAL = _normal_sql(3)
_ev("noise_draw", g.GaussianNoise(0.1, 3), f"value + 0.1::double * {_NORMAL}")
_ev("noise_snr_draw", g.NoiseAtSNR(20.0, 3), f"value + sqrt(p / 100.0::double) * {_NORMAL}", "from ev join (select channel, avg(value * value) as p from ev group by channel) using (channel)")
_ev("dropout_draw", g.Dropout(0.1, 3), f"case when {_uniform_sql(3)} < 0.1::double then 0.0::double else value / (1 - 0.1::double) end")


def _drawn(draw: Callable[[random.Random], g.Transform], seed: int = 5) -> g.Transform:
    """What ``Randomly`` draws with this seed."""
    rng = random.Random(seed)
    rng.random()
    return draw(rng)


def _curve_sql(knots: list[float], at: str) -> str:
    """Linear interpolation as a sum of tents."""
    return " + ".join(f"{v!r}::double * greatest(0, 1 - abs({at} - {i}))" for i, v in enumerate(knots))


_knots = _drawn(g.draw_magnitude_warp()).knots
_ev("magnitude_warp_draw", g.Randomly(g.draw_magnitude_warp(), 1.0, 5), f"value * ({_curve_sql(_knots, f't * {len(_knots) - 1}.0::double / (n - 1)')})", "from ev join len using (channel)")
_moved = _drawn(g.draw_time_warp()).shifts
_inner = len(_moved) - 2
_tents = " + ".join(f"least(greatest({i} * (n - 1) / {_inner + 1}.0::double + {v!r}::double * (n / {_inner}.0::double), 0), n - 1) * greatest(0, 1 - abs(t * {_inner + 1}.0::double / (n - 1) - {i}))" for i, v in enumerate(_moved))
_ev("time_warp_draw", g.Randomly(g.draw_time_warp(), 1.0, 5), "a.value * (1 - (src - floor(src))) + b.value * (src - floor(src))", f"from (select channel, t, n, least(greatest({_tents}, 0), n - 1) as src from ev join len using (channel)) q join ev a on a.channel = q.channel and a.t = floor(src)::bigint join ev b on b.channel = q.channel and b.t = least(floor(src)::bigint + 1, n - 1)", "q.channel, q.t")
_by = _drawn(g.draw_time_shift(20)).shift
_ev("time_shift_draw", g.Randomly(g.draw_time_shift(20), 1.0, 5), f"case when {f'pl < {_by}' if _by > 0 else f'pl >= n + {_by}'} then 0.0::double else value end", f"from (select channel, value, n, ((t + {_by}) % n + n) % n as pl from ev join len using (channel))", "channel, pl as t")


# Datasets: events by type as modalities are uneven, so each user is a task.
def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).df.select(F.col("channel").alias("task"), "t", "value")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    t = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return df.select(F.col("o_custkey").cast("long").alias("task"), t.cast("long").alias("t"), F.col("o_totalprice").cast("double").alias("value"))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = ds.align_modalities({"emg": _recordings(spark, sf_dir), "kinematics": _orders(spark, sf_dir)})
    return both["emg"].withColumn("modality", F.lit("emg")).unionByName(both["kinematics"].withColumn("modality", F.lit("kinematics"))).select("modality", "task", "t", F.round("value", 6).alias("value"))


_REC = EV + ", rec as (select channel as task, t, value from ev)"
_ORD = "ord as (select o_custkey as task, row_number() over (partition by o_custkey order by o_orderkey) - 1 as t, o_totalprice::double as value from orders)"
_add("align_truncate", _aligned, f"with {_REC}, {_ORD}, al as (select 'emg' as modality, * from rec union all select 'kinematics', * from ord), sz as (select task, min(n) as n from (select modality, task, max(t) + 1 as n from al group by 1, 2) group by 1) select modality, task, t, round(value, 6) as value from al join sz using (task) where t < n")


def _split_sql(test: float, val: float) -> str:
    return f"""sp as (select *, n // 2 as mid, floor(n * {test}::double / 2)::bigint as h from rec join (select task, max(t) + 1 as n from rec group by task) using (task)),
        sq as (select *, t >= mid - h and t < mid + h as te, t - (mid - h) as u, h as vm, floor(2 * h * {val}::double / 2)::bigint as vh from sp),
        sr as (select *, te and u >= vm - vh and u < vm + vh as va from sq),
        done as (select task, value, case when va then 'val' when te then 'test' else 'train' end as split,
            case when va then false when te then vh > 0 and u = vm + vh else h > 0 and t = mid + h end as seam,
            case when va then u - (vm - vh) when te and u < vm then u when te then u - 2 * vh when t < mid then t else t - 2 * h end as t from sr)"""


for _name, _test, _val in (("split_center", 0.2, 0.0), ("split_center_val", 0.2, 0.2), ("split_train_only", 0.0, 0.2)):
    _add(_name, (lambda a, b: lambda spark, d: ds.center_split(_recordings(spark, d), ["task"], a, b).withColumn("value", F.round("value", 6)))(_test, _val), f"with {_REC}, {_split_sql(_test, _val)} select task, split, seam, t, round(value, 6) as value from done")
_add("split_sizes", lambda spark, d: ds.center_split(_recordings(spark, d), ["task"]).groupBy("split").agg(F.count("*").alias("n")), f"with {_REC}, {_split_sql(0.2, 0.2)} select split, count(*) as n from done group by split")
_STARTS = "st as (select row_number() over (order by task, start) - 1 as window_id, task, start from (select task, unnest(range(0, n - 20 + 1, 10)) as start from (select task, max(t) + 1 as n from rec group by task) where n >= 20))"
_add("windows_deterministic", lambda spark, d: ds.window_starts(_recordings(spark, d), 20, 10), f"with {_REC}, {_STARTS} select * from st")
_add("windows_fetch", lambda spark, d: ds.fetch_windows(_recordings(spark, d), ds.window_starts(_recordings(spark, d), 20, 10), 20).select("window_id", "task", "start", "t", F.round("value", 6).alias("value")), f"with {_REC}, {_STARTS} select window_id, task, start, rec.t - start as t, round(value, 6) as value from st join rec using (task) where rec.t between start and start + 19")
_add("batch_assign", lambda spark, d: ds.batches(ds.window_starts(_recordings(spark, d), 20, 10), 32), f"with {_REC}, {_STARTS} select *, window_id // 32 as batch, window_id % 32 as item from st")
_U = "(((7 * 7919 + 1 + i) % 2147483648) * 2654435761 % 4294967296)"
_U = f"xor({_U}, {_U} >> 15)"
_U = f"({_U} % 2147483648 * 1597334677 % 4294967296)"
_U = f"(xor({_U}, {_U} >> 15) / 4294967296.0::double)"
_add("windows_random", lambda spark, d: ds.random_starts(_recordings(spark, d), 20, 500, 7), f"with {_REC}, spans as (select task, k, sum(k) over (order by task) as hi, sum(k) over () as total from (select task, max(t) + 1 - 20 + 1 as k from rec group by task having max(t) + 1 >= 20)) select i as window_id, task, (floor({_U} * total) - (hi - k))::bigint as start from range(0, 500) r(i), spans where floor({_U} * total) >= hi - k and floor({_U} * total) < hi")


def _scratch(spark: SparkSession) -> str:
    """A new folder that all executors share; a local one only where none is set, and in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster") and not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base or 'file://' + tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/signals/{uuid.uuid4().hex[:12]}"


def _from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ds.BucketedStore(spark, f"recordings_{uuid.uuid4().hex[:12]}", _scratch(spark), block=32, buckets=8)
    store.write(_recordings(spark, sf_dir))
    got = store.fetch(ds.window_starts(store.read(), 20, 10), 20)
    return got.select("window_id", "task", "start", "t", F.round("value", 6).alias("value"))


_add("windows_fetch_store", _from_store, _SQL["windows_fetch"])


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ds.fetch_windows(_recordings(spark, sf_dir), ds.window_starts(_recordings(spark, sf_dir), 20, 10), 20)
    made = ds.dense_batches(signal(got.select(F.col("window_id").alias("batch"), "t", "value"), ("batch", "t")), 32, (20,), "float64")
    weighted = F.aggregate(F.transform("data", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return made.select("batch", F.element_at("items", 1).alias("first"), F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"), F.round(weighted, 4).alias("weighted"))


_add("dense_batches", _dense, f"with {_REC}, {_STARTS} select window_id // 32 as batch, min(window_id) as first, count(distinct window_id) || 'x20' as shape, round(sum(value * (window_id % 32 * 20 + rec.t - start + 1)), 4) as weighted from st join rec using (task) where rec.t between start and start + 19 group by window_id // 32")


def _scanned(spark: SparkSession, sf_dir: str) -> SignalFrame:
    x, path = grid_signal(spark, sf_dir), _scratch(spark)
    ar.write_chunks(x.to(x.df, ("t", "channel")), path, block=64)
    y = ar.read_array(spark, path, ("t", "channel"), "t", block=64)
    return y.to(y.df.where("t >= 100 and t < 180 and channel <> 3"))


_add("npy_scan", _scanned, f"with {EMB} select channel, t, round(value, 6) + 0.0::double as value from em where t >= 100 and t < 180 and channel <> 3")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    recordings = ds.align_modalities({"emg": _recordings(spark, sf_dir), "kinematics": _orders(spark, sf_dir)})
    starts = ds.window_starts(recordings["emg"], 5, 3)
    x, y = (ds.collate(v) for v in ds.supervised_pairs(recordings, starts, 5, ["emg"], ["kinematics"], e.Rectify(), presets.target()))
    inputs, targets = (z.df.withColumn("value", F.round("value", 6)) for z in (x, y))
    return inputs.withColumn("modality", F.lit("emg")).unionByName(targets.withColumns({"modality": F.lit("kinematics"), "t": F.lit(-1).cast("long")}))


_ALIGNED = f"{_REC}, {_ORD}, sz as (select task, min(n) as n from (select task, max(t) + 1 as n from rec group by 1 union all select task, max(t) + 1 from ord group by 1) group by 1), rc as (select rec.* from rec join sz using (task) where t < n), oc as (select ord.* from ord join sz using (task) where t < n)"
_add(
    "supervised_pairs", _pairs,
    f"""with {_ALIGNED}, st as (select row_number() over (order by task, start) - 1 as batch, task, start from (select task, unnest(range(0, n - 5 + 1, 3)) as start from (select task, max(t) + 1 as n from rc group by task) where n >= 5))
        select 'emg' as modality, batch, rc.t - start as t, round(abs(value), 6) as value from st join rc using (task) where rc.t between start and start + 4
        union all select 'kinematics', batch, -1, round(avg(value), 6) from st join oc using (task) where oc.t between start and start + 4 group by batch""",
)
_add("storage_sizes", lambda spark, d: ds.storage_sizes(ds.center_split(_recordings(spark, d), ["task"])).withColumn("mb", F.round("mb", 9)), f"with {_REC}, {_split_sql(0.2, 0.2)} select split, count(*) as n, round(count(*) * 4 / 1048576.0::double, 9) as mb from done group by split")
_add("split_summary", lambda spark, d: ds.split_summary(ds.center_split(_recordings(spark, d), ["task"])), f"with {_REC}, {_split_sql(0.2, 0.2)} select split, count(distinct task) as tasks, max(t) + 1 as longest, count(*) as n from done group by split")
_add("sample_shapes", lambda spark, d: ds.sample_shapes(_joints(spark, d).df, ("batch", "joint", "xyz")), f"with {EMB} select max(t) + 1 as batch, 21::bigint as joint, 3::bigint as xyz from em")
_add("label_groups", lambda spark, d: ds.label_groups(_recordings(spark, d), text=True), f"with {_REC}, names as (select distinct task from rec) select task, row_number() over (order by task) - 1 as label, repeat('0', (row_number() over (order by task) - 1)::int) || '1' || repeat('0', ((select count(*) from names) - row_number() over (order by task))::int) as one_hot from names")
# Along the first axis, channels: in the SQL they take the place of t.
_add("split_axis0", lambda spark, d: ds.split_axis(events(spark, d), test_ratio=0.3, val_ratio=0.5).withColumn("value", F.round("value", 6)), f"with {EV}, rec as (select 0 as task, channel as t, value, t as own from ev), {_split_sql(0.3, 0.5).replace('select task, value,', 'select task, value, own,')} select split, seam, t as channel, own as t, round(value, 6) as value from done")


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, x = _scratch(spark), events(spark, sf_dir).df
    for run in ("a", "b"):
        ds.log_predictions(x.select("channel", "t", (F.col("value") * (2.0 if run == "a" else 0.5)).alias("pred"), F.col("value").alias("truth")), path, run, "test")
    return ds.load_predictions(spark, path, "b", "test").select("channel", "t", F.round("pred", 6).alias("pred"), F.round("truth", 6).alias("truth"))


_add("predictions_roundtrip", _predictions, f"with {EV} select channel, t, round(value * 0.5::double, 6) as pred, round(value, 6) as truth from ev")


def _four(spark: SparkSession, sf_dir: str) -> SignalFrame:
    """All events as four tasks."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.row_number().over(Window.partitionBy(F.col("user_id") % 4).orderBy("event_id")) - 1
    return signal(df.select((F.col("user_id") % 4).alias("task"), t.alias("t"), "value"), ("task", "t"))


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    ds.DatasetCreator({"emg": _four(spark, sf_dir).df}, path).create()
    parts = [ds.read_split(spark, path, "emg", split) for split in ds.SPLITS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("split", "task", "seam", "t", F.round(F.col("value").cast("double"), 3).alias("value"))


_FOUR = "rec as (select user_id % 4 as task, row_number() over (partition by user_id % 4 order by event_id) - 1 as t, value::double as value from events)"
_add("store_roundtrip", _store, f"with {_FOUR}, {_split_sql(0.2, 0.2)} select split, task::varchar as task, seam, t, round(value::float::double, 3) as value from done")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, rows = ds.GroupStore(spark, _scratch(spark)), spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("sample"), "value")
    store.add("emg", "data", rows)
    store.add("emg", "data", rows)
    return store.read("emg").select("sample", F.round("value", 6).alias("value"))


_add("group_store_append", _groups, "select event_id + again * (select max(event_id) + 1 from events) as sample, round(value, 6) as value from events, (values (0), (1)) v(again)")


def _doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ds.GroupStore(spark, _scratch(spark))
    store.add("emg", "training", spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("sample"), "value"))
    store.augment("training", {"emg": lambda df, turn: df.withColumn("value", F.col("value") * 1.1 + turn)})
    return store.read("emg", "training").select("sample", F.round("value", 6).alias("value"))


_add("group_store_augmented", _doubled, "select event_id + again * (select max(event_id) + 1 from events) as sample, round(case again when 0 then value else value * 1.1::double + 1 end, 6) as value from events, (values (0), (1)) v(again)")


def _saved(spark: SparkSession, sf_dir: str) -> SignalFrame:
    path = _scratch(spark)
    Recording.of("emg", events(spark, sf_dir)).with_result("abs", Lambda("value * 2")(events(spark, sf_dir))).with_result("gone", events(spark, sf_dir)).without("Last").save(path)
    return Recording.load(spark, path)["abs"]


_add("recording_roundtrip", _saved, f"with {EV} select channel, t, round(value * 2, 6) + 0.0::double as value from ev")
_add("latest_order_run", lambda spark, d: ds.latest_run(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("run_id"), F.lit("FINISHED").alias("status"), F.col("o_orderdate").alias("start_time"))).select("run_id", "status"), "select o_orderkey as run_id, 'FINISHED' as status from orders order by o_orderdate desc, o_orderkey limit 1")

# Pipelines.
_FEATURES = Compose([e.Rectify(), s.Stack({"rms": w.RMS(16, 8), "mav": w.MAV(16, 8), "var": w.VAR(16, 8)}), n.ZScore("t")])
_ev(
    "emg_features", _FEATURES, "(value - avg(value) over p) / (stddev_samp(value) over p + 1e-8)", "from feat window p as (partition by representation, channel)", "representation, channel, t",
    more=_windowed(16, 8) + """, agg as (select channel, win as t, sqrt(avg(value * value)) as f0, avg(abs(value)) as f1, var_samp(abs(value)) as f2 from win group by channel, win),
        feat as (select r::bigint as representation, channel, t, case r when 0 then f0 when 1 then f1 else f2 end as value from agg, (values (0), (1), (2)) v(r))""",
)
_passes, _out = _iir(fl.bandpass(20.0, 450.0, 2048.0).sections, True)
_ev(
    "filtered_features", Compose([fl.bandpass(20.0, 450.0, 2048.0), _FEATURES]), "(value - avg(value) over p) / (stddev_samp(value) over p + 1e-8)", "from feat window p as (partition by representation, channel)", "representation, channel, t", scale=0.002,
    more=f"{_passes}, fx as (select channel, t, abs(value) as value from {_out}), " + _windowed(16, 8).replace("ev e", "fx e") + """, agg as (select channel, win as t, sqrt(avg(value * value)) as f0, avg(value) as f1, var_samp(value) as f2 from win group by channel, win),
        feat as (select r::bigint as representation, channel, t, case r when 0 then f0 when 1 then f1 else f2 end as value from agg, (values (0), (1), (2)) v(r))""",
)
_passes, _out = _iir(fl.lowpass(20.0, 2048.0).sections, True)
_ev("embc_eval", presets.evaluation(), "value", f"from (select 0::bigint as representation, * from ev union all select 1, channel, t, value from {_out})", "representation, channel, t", scale=0.002, more=_passes)
_ev("embc_train", presets.training(seed=3), f"value + 0.1::double * {_normal_sql(3, ('representation', 'channel', 't'))}", f"from (select 0::bigint as representation, * from ev union all select 1, channel, t, value from {_out})", "representation, channel, t", scale=0.002, more=_passes)
_add("raw_ndd_rms", lambda spark, d: Compose([sp.SpatialFilter("NDD"), w.RMS(50, 25)])(grid_signal(spark, d)), f"select channel, k.k as t, round(sqrt(avg(value * value)), 6) + 0.0::double as value from ({_spatial_sql(sp.KERNELS['NDD']).replace('round(sum(em.value * weight), 6) + 0.0::double', 'sum(em.value * weight)')}) x, range(0, (select (max(vec_id) + 1 - 50) // 25 + 1 from embeddings)) k(k) where x.t between k.k * 25 and k.k * 25 + 49 group by channel, k.k")
_add("kinematics_flatten", lambda spark, d: Compose([s.Flatten(1, 2, [3], "channel"), s.Index(slice(3, None), "channel"), n.Mean("batch")])(_joints(spark, d)), f"with {EMB} select channel - 3 as channel, round(avg(value), 6) + 0.0::double as value from em where channel >= 3 and channel < 63 group by channel")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
