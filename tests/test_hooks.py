"""Users' functions over parts of rows."""

from __future__ import annotations

import weakref

from pyspark.sql import functions as F

from tessera.plans import frame


def test_earlier_parts_are_freed(spark):
    """A column whose ``str`` was used refers to itself: without a collection all 48 parts of 1 MB are held at once."""
    rows = spark.range(0, 48, 1, 1).select("id", F.repeat(F.lit("é "), 1 << 19).alias("text"))

    def count(parts):
        seen = []
        for p in parts:
            column = p["text"]
            out = p.assign(title=column.str[:1])
            seen.append(weakref.ref(column))
            yield out.assign(held=sum(x() is not None for x in seen))[["id", "title", "held"]]

    rows_a_batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows_a_batch)
    spark.conf.set(rows_a_batch, "1")
    try:
        got = frame.generate(rows, count, "id long, title string, held int", rows.select("id"), "id").collect()
    finally:
        spark.conf.set(rows_a_batch, before)
    assert sorted((r.id, r.title) for r in got) == [(i, "é") for i in range(48)]
    assert max(r.held for r in got) <= 24
