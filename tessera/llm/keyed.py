"""Rows of one key that several documents hold, found by streaming over rows sorted by key: no key's rows are held in memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def shared_keys(df: DataFrame, with_first: bool, salted: bool = False) -> DataFrame:
    """For df (key long, doc_id long, ...): its rows whose key two or more documents hold, with first, the key's smallest doc_id;
    without ``with_first`` only those of other documents than the first. One shuffle. Keys and ids must not be null.

    If ``salted``, df is (key, doc_id, salt): rows of a salt other than 0 have keys that are known to be shared by many; they are
    dealt by the salt, too, and all are returned, with a first that means nothing.

    The rows of the first document of the key at hand are all that is kept back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = known = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            key, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.append(True, key[1:] != key[:-1])
            start = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            first = doc[start]
            if known is not None and known[0] == key[0]:
                first[0] = known[1]
            many = doc[np.append(start[1:], len(doc)) - 1] != first
            if known is not None and known[0] == key[0]:
                many[0] = True
            take = many[run_of]
            if salted:
                take = take | (batch.column(2).to_numpy() != 0)
            if not with_first:
                take &= doc != first[run_of]
            if many[-1]:
                held, known = None, (key[-1], first[-1])
            else:
                held, known = batch.slice(start[-1]), None
            rows = np.flatnonzero(take)
            if len(rows):
                out = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(first[run_of[rows]])], [*out.schema.names, "first"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", first long"
    by = ["key", "salt"] if salted else ["key"]
    return df.repartition(*by).sortWithinPartitions("key", "doc_id").mapInArrow(run, schema)
