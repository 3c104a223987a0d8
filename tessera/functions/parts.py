"""Rows as pandas frames, handed to functions of users in tasks."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Bytes of the rows that a task gets at once, unless the session says otherwise; Spark's own 64 MB is held several times over.
BATCH, BYTES = "2m", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that are handed on before what earlier rows left behind is freed.
HELD = 16 << 20


def freed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same parts, whose memory doesn't add up: a column whose ``str`` or another accessor was used and the accessor refer to each other,
    so its values stay until Python looks for such circles, which it does after many objects, however large those are."""
    n = 0
    for p in parts:
        n += int(p.memory_usage(index=False, deep=True).sum())
        yield p
        if n >= HELD:
            gc.collect()
            n = 0


def map_parts(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema) -> DataFrame:
    """mapInPandas over small parts that don't stay in memory once the next ones are there."""
    conf = df.sparkSession.conf
    if conf.get(BYTES, None) is None:
        conf.set(BYTES, BATCH)
    return df.mapInPandas(lambda parts: fn(freed(parts)), schema)
