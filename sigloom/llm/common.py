"""Helpers shared by the training-data operators.

``scratch_path`` and ``materialise`` put intermediate tables in the folder named by
``spark.checkpoint.dir`` (shared by all executors). A written table cuts the lineage: a lost
executor costs its running tasks only, never the stages before the table. The tables stay as long as results may be read
again: ``scratch_scope`` deletes those of an operator at its end, ``clear_scratch`` those of the session's application.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words of the result contracts: runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words for matching prose: letters, digits and underscore, whatever the punctuation.
PLAIN_WORD = re.compile(r"\w+")
#: A key with at least this share of all rows is hot; so there are at most HOT_SHARE of them.
HOT_SHARE = 256

#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1_000

_own_folder: str | None = None


def _scratch_root(spark: SparkSession) -> str:
    """The application's scratch folder. Where none is configured a local one is made, but only in local mode (tests): no executor of a cluster would see it."""
    global _own_folder
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_folder = _own_folder or tempfile.mkdtemp(prefix="sigloom-")
        base = f"file://{_own_folder}"
    return f"{base.rstrip('/')}/sigloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared scratch folder."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that are still to be computed can't be afterwards."""
    root = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


#: The tables written in each open scope, the innermost last.
_scopes: list[list[str]] = []


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes within the scope are deleted at its end, but for lasting ones: what is to stay must not read them any more."""
    _scopes.append([])
    try:
        yield
    finally:
        _delete(spark, _scopes.pop())


def materialise(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write a table to the shared scratch folder as Parquet and read it back with the same schema. A ``lasting`` one outlives the innermost scope."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if _scopes and not lasting:
        _scopes[-1].append(path)
    elif len(_scopes) > 1:
        _scopes[-2].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, sorted({f.rsplit("/", 1)[0] for f in t.inputFiles()}))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop the columns whose names clash with an operator's own (case-insensitive, as Spark resolves names)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same table; Arrow batches of the session hold BATCH_ROWS rows at most from here on, as texts are long and each is held by the JVM and by Python."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def append_columns(df: DataFrame, inputs: list[str], fields: str, fn: Callable[..., list]) -> DataFrame:
    """Add columns computed in Arrow batches: ``fn`` gets a Python list per input column and returns a list per field.

    All other columns pass through untouched; columns with the new names are replaced.
    """
    new = T._parse_datatype_string(fields)
    kept = without(df, new.names)
    n, place, more = len(kept.columns), [], []
    for c in inputs:  # a column that stays is read where it is
        if c in kept.columns:
            place.append(kept.columns.index(c))
        else:
            place.append(n + len(more))
            more.append(df[c].alias(f"__in_{len(more)}"))
    work = kept.select(*kept.columns, *more) if more else kept
    schema = T.StructType([*kept.schema.fields, *new.fields])
    types = [f.type for f in to_arrow_schema(new)]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = fn(*[b.column(i).to_pylist() for i in place])
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *[pa.array(v, t) for v, t in zip(made, types, strict=True)]], names=names)

    return in_small_batches(work).mapInArrow(run, schema)


def keep_rows(df: DataFrame, column: str, fn: Callable[[list], list]) -> DataFrame:
    """The rows for which ``fn`` of the column's values (a list per Arrow batch) gives true; all columns stay as they are."""
    at = [c.lower() for c in df.columns].index(column.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(fn(b.column(at).to_pylist()), pa.bool_()))

    return in_small_batches(df).mapInArrow(run, df.schema)


def join_unique(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, total: int) -> DataFrame:
    """Left-join ``right`` (one row per key, no null key) to ``left`` without piling a hot key onto one task.

    ``counts`` holds (key, n) of ``left``. Keys with at least ``total / HOT_SHARE`` rows number at most
    HOT_SHARE, so their rows of ``right`` are broadcast; all other keys meet in an ordinary join.
    """
    spark = left.sparkSession
    hot = [r[0] for r in counts.where(F.col("n") >= max(2, total / HOT_SHARE)).select(key).limit(HOT_SHARE + 1).collect()]
    if not hot:
        return left.join(right, key, "left")
    keys = spark.createDataFrame([(k,) for k in hot], T.StructType([left.schema[key]]))
    of_hot = right.join(F.broadcast(keys), key, "left_semi")
    warm = left.join(F.broadcast(keys), key, "left_semi").join(F.broadcast(of_hot), key, "left")
    return warm.unionByName(left.join(F.broadcast(keys), key, "left_anti").join(right, key, "left"))
