"""Recursive filters over streams: a series' filter state goes on from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.filters import Section, cascade

#: The state store that ``transformWithState`` needs, to be set before a query starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Filter(StatefulProcessor):
    """Keeps two numbers per section, the next place, and samples that came before their turn."""

    def __init__(self, sections: Sequence[Section], clamp: bool, keys: Sequence[str], dim: str):
        self.sections, self.clamp, self.keys, self.dim = list(sections), clamp, list(keys), dim

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "next long, held array<double>")
        self.early = handle.getListState("early", "t long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat([pd.DataFrame({"t": r[self.dim], "value": r["value"]}) for r in rows])
        if early := list(self.early.get()):
            new = pd.concat([new, pd.DataFrame(early, columns=["t", "value"])])
        known = self.state.get() if self.state.exists() else None
        first, held = (known[0], np.array(known[1])) if known else (0, np.zeros(2 * len(self.sections)))
        new = new[new["t"] >= first].sort_values("t", kind="stable").drop_duplicates("t")
        t = new["t"].to_numpy()
        ready = int((t == first + np.arange(len(t))).sum())  # up to the first gap
        self.early.clear()
        if ready < len(t):
            self.early.put([(int(a), float(v)) for a, v in zip(t[ready:], new["value"].to_numpy()[ready:], strict=True)])
        if ready:
            y, held = cascade(new["value"].to_numpy(float)[:ready], self.sections, held, self.clamp)
            self.state.update((int(first + ready), held.tolist()))
            yield pd.DataFrame({**{k: [v] * ready for k, v in zip(self.keys, key, strict=True)}, self.dim: t[:ready], "value": y})

    def close(self) -> None:
        pass


def filtered_stream(df: DataFrame, sections: Sequence[Section], keys: Sequence[str] = ("channel",), dim: str = "t", clamp: bool = True) -> DataFrame:
    """A stream of (keys, dim, value) filtered as the whole series would be: samples of a series may come in chunks of any size.

    A sample behind a gap waits, in the state, for those before it; one that comes again is left out.
    """
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(dim, T.LongType()), T.StructField("value", T.DoubleType())])
    return df.groupBy(*keys).transformWithStateInPandas(statefulProcessor=_Filter(sections, clamp, keys, dim), outputStructType=schema, outputMode="Append", timeMode="None")
