"""Electrode grids and 3x3 spatial filters.

A grid's cells are numbered in row-major order over its valid cells, and those numbers are the channels. A
filter is a table of (source channel, target channel, weight), at most nine rows per electrode, that signals join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..frame import SignalFrame, Transform

# The kernels of the filters' names.
KERNELS = {
    "NDD": [[0, -0.25, 0], [-0.25, 1, -0.25], [0, -0.25, 0]],
    "LSD": [[0, -1, 0], [0, 1, 0], [0, 0, 0]],
    "TSD": [[0, 0, 0], [-1, 1, 0], [0, 0, 0]],
    "IB2": [[0.25, -0.5, 0.25], [-0.5, 1, -0.5], [0.25, -0.5, 0.25]],
    "IR": [[-0.125, -0.125, -0.125], [-0.125, 1, -0.125], [-0.125, -0.125, -0.125]],
    "LDD": [[0, -1, 0], [0, 2, 0], [0, -1, 0]],
    "identity": [[0, 0, 0], [0, 1, 0], [0, 0, 0]],
}


def create_grid_layout(spark: SparkSession, rows: int, cols: int, n_electrodes: int | None = None, fill_pattern: str = "row", missing: list[tuple[int, int]] | None = None, grid: int = 0) -> DataFrame:
    """(grid, row, col, electrode): valid cells numbered by row or column up to n_electrodes; the rest and the missing ones are -1."""
    if fill_pattern not in ("row", "column"):
        raise ValueError("fill_pattern is 'row' or 'column'")
    gaps = [(r, c) for r, c in missing or [] if 0 <= r < rows and 0 <= c < cols]
    valid = rows * cols - len(set(gaps))
    n = valid if n_electrodes is None else n_electrodes
    if n > valid:
        raise ValueError(f"{n} electrodes don't fit {valid} cells")
    cells = spark.range(rows * cols).select(F.lit(grid).alias("grid"), F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    gap = spark.createDataFrame(gaps, "row int, col int").distinct().withColumn("gap", F.lit(True))
    order = ("row", "col") if fill_pattern == "row" else ("col", "row")
    at = F.sum(F.when(F.col("gap").isNull(), 1).otherwise(0)).over(Window.partitionBy("grid").orderBy(*order)) - 1
    return cells.join(gap, ["row", "col"], "left").withColumn("at", at).select("grid", "row", "col", F.when(F.col("gap").isNull() & (F.col("at") < n), F.col("at")).otherwise(-1).cast("int").alias("electrode"))


def grid_layouts(sizes: DataFrame, gaps: DataFrame | None = None, fill_pattern: str = "row") -> DataFrame:
    """``create_grid_layout`` of many grids at once, from tables: ``sizes`` (grid, n_rows, n_cols, n_electrodes), ``gaps`` (grid, row, col). It is an error if electrodes don't fit.

    Cells are counted per line of a grid first, so a task numbers one line and sees one row per line.
    """
    if fill_pattern not in ("row", "column"):
        raise ValueError("fill_pattern is 'row' or 'column'")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    cells = sizes.withColumn("row", every("n_rows")).withColumn("col", every("n_cols")).select("grid", "row", "col", "n_electrodes")
    cells = cells.withColumn("gap", F.lit(False)) if gaps is None else cells.join(gaps.select("grid", "row", "col").distinct().withColumn("gap", F.lit(True)), ["grid", "row", "col"], "left").fillna(False, ["gap"])
    line, within = ("row", "col") if fill_pattern == "row" else ("col", "row")
    valid = F.when(F.col("gap"), 0).otherwise(1)
    lines = cells.groupBy("grid", line).agg(F.sum(valid).alias("n"), F.first("n_electrodes").alias("asked"))
    of_grid = Window.partitionBy("grid").orderBy(line)
    lines = lines.withColumns({"before": F.sum("n").over(of_grid) - F.col("n"), "fit": F.sum("n").over(Window.partitionBy("grid")) >= F.col("asked")})
    at = F.col("before") + F.sum(valid).over(Window.partitionBy("grid", line).orderBy(within)) - 1
    numbered = cells.join(lines.select("grid", line, "before", "fit"), ["grid", line]).withColumn("at", at)
    right = F.when(~F.col("fit"), F.raise_error(F.lit("more electrodes than cells")).cast("int")).when(~F.col("gap") & (F.col("at") < F.col("n_electrodes")), F.col("at")).otherwise(-1)
    return numbered.select("grid", "row", "col", right.cast("int").alias("electrode"))


def check_grids(grids: DataFrame) -> None:
    """Every grid has an electrode and none twice."""
    valid = F.when(F.col("electrode") >= 0, F.col("electrode"))
    bad = grids.groupBy("grid").agg(F.count(valid).alias("n"), F.count_distinct(valid).alias("d")).where("n = 0 or n <> d").first()
    if bad:
        raise ValueError(f"grid {bad['grid']} has no electrodes" if not bad["n"] else f"grid {bad['grid']} has an electrode twice")


def grid_dimensions(grids: DataFrame) -> DataFrame:
    return grids.groupBy("grid").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), F.sum((F.col("electrode") >= 0).cast("int")).alias("n_electrodes"))


def channels(grids: DataFrame) -> DataFrame:
    """(grid, row, col, channel) of the valid cells: the running number over (grid, row, col), whatever the electrode numbers.

    Counted per grid and row first, so only one row per grid row meets in one task.
    """
    valid = grids.where("electrode >= 0")
    lines = valid.groupBy("grid", "row").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("grid", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("grid", "row").orderBy("col")) - 1
    return valid.withColumn("i", within).join(lines.withColumn("first", before), ["grid", "row"]).select("grid", "row", "col", (F.col("first") + F.col("i")).cast("long").alias("channel"))


@dataclass
class SpatialFilter(Transform):
    """Cross-correlation with a 3x3 kernel, zero outside the grid and at gaps. Grids not listed pass through; channels past all grids go.

    With ``valid`` only cells all of whose neighbours are there stay, numbered anew in row-major order.
    """

    kernel: str | list[list[float]]
    grids: list[int] | None = None
    valid: bool = False

    def apply(self, x: SignalFrame) -> SignalFrame:
        k = KERNELS[self.kernel] if isinstance(self.kernel, str) else self.kernel
        if len(k) != 3 or any(len(r) != 3 for r in k):
            raise ValueError("the kernel must be 3x3")
        if x.grids is None:
            raise ValueError("the signal has no grids")
        cells = channels(x.grids)

        def steps(kernel):
            return F.array(*[F.struct(F.lit(i - 1).alias("dr"), F.lit(j - 1).alias("dc"), F.lit(float(w)).alias("w")) for i, r in enumerate(kernel) for j, w in enumerate(r) if w])

        moves = steps(k) if self.grids is None else F.when(F.col("grid").isin(self.grids), steps(k)).otherwise(steps(KERNELS["identity"]))
        asks = cells.withColumn("m", F.explode(moves)).select("grid", F.col("channel").alias("to"), (F.col("row") + F.col("m.dr")).alias("row"), (F.col("col") + F.col("m.dc")).alias("col"), F.col("m.w").alias("w"))
        weights = asks.join(cells, ["grid", "row", "col"]).select("channel", "to", "w")
        if self.valid:
            near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
            around = cells.withColumnRenamed("channel", "to").withColumn("dr", near).withColumn("dc", near)
            around = around.select("to", "grid", F.col("row").alias("r"), F.col("col").alias("c"), (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"))
            whole = around.join(cells, ["grid", "row", "col"]).groupBy("to", "grid", "r", "c").agg(F.count("*").alias("n")).where("n = 9")
            whole = whole.select("to", "grid", F.col("r").alias("row"), F.col("c").alias("col"), F.lit(0).alias("electrode"))
            number = channels(whole).join(whole, ["grid", "row", "col"]).select("to", F.col("channel").alias("number"))
            weights = weights.join(number, "to").drop("to").withColumnRenamed("number", "to")
        out = x.df.join(weights, "channel").groupBy(*x.keys("channel"), "to").agg(F.sum(F.col("value") * F.col("w")).alias("value"))
        return x.to(out.withColumnRenamed("to", "channel"))


def channels_to_grid(x: SignalFrame) -> SignalFrame:
    """The channel axis as grid, row and col; gaps hold 0."""
    cells = channels(x.grids)
    all_cells = x.grids.select("grid", "row", "col").join(cells, ["grid", "row", "col"], "left")
    keys = x.keys("channel")
    filled = x.df.join(cells, "channel").select(*keys, "grid", "row", "col", "value")
    gaps = x.df.select(*keys).distinct().join(F.broadcast(all_cells.where("channel is null").drop("channel"))).withColumn("value", F.lit(0.0))
    axes = [c for a in x.axes for c in (("grid", "row", "col") if a == "channel" else (a,))]
    return x.to(filled.unionByName(gaps), axes)


def grid_to_channels(x: SignalFrame, grids: DataFrame) -> SignalFrame:
    axes = [a for a in x.axes if a not in ("row", "col")]
    axes[axes.index("grid")] = "channel"
    return SignalFrame(x.df.join(channels(grids), ["grid", "row", "col"]).select(*axes, "value"), tuple(axes), x.fs, grids)
