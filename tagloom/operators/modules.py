"""User-defined aggregations as classes: partial states where the rows are, merged in groups, finished once."""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 64


class Aggregation(ABC):
    """What a module's task does over all containers: ``zero``, ``add`` a frame of rows, ``merge`` two states, ``finish``.

    ``merge`` must be associative and commutative; states travel pickled and should stay small.
    """

    @abstractmethod
    def zero(self) -> Any: ...

    @abstractmethod
    def add(self, state: Any, rows: pd.DataFrame) -> Any: ...

    @abstractmethod
    def merge(self, a: Any, b: Any) -> Any: ...

    def finish(self, state: Any) -> Any:
        return state


def aggregate(rows: DataFrame, task: Aggregation) -> Any:
    """The task's result over all rows: a state per partition, merged by FAN_IN at a time until few enough are left for the driver."""

    def partial(frames):
        state = task.zero()
        for df in frames:
            state = task.add(state, df)
        yield pd.DataFrame({"s": [pickle.dumps(state)]})

    def merged(df: pd.DataFrame) -> pd.DataFrame:
        state = task.zero()
        for s in df["s"]:
            state = task.merge(state, pickle.loads(s))
        return pd.DataFrame({"s": [pickle.dumps(state)]})

    n = rows.rdd.getNumPartitions()
    states = rows.mapInPandas(partial, "s binary")
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        states = states.groupBy(F.pmod(F.xxhash64("s", F.monotonically_increasing_id()), F.lit(n)).alias("g")).applyInPandas(merged, "s binary")
    out = task.zero()
    for r in states.toLocalIterator():
        out = task.merge(out, pickle.loads(r["s"]))
    return task.finish(out)
