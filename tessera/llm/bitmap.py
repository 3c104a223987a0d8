"""A bitmap of fixed size over hashed ids: rows that cannot have a partner go before a shuffle; the exact join still follows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap: 2 MB, whatever the number of ids; with very many ids it only lets more rows pass.
BITS = 1 << 24


def _place(col: str):
    return F.pmod(F.xxhash64(F.col(col).cast("long")), F.lit(BITS))


def maybe(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """The rows whose id may be among ids, and perhaps others; rows with a null id go. The driver gets at most BITS / 64 numbers."""
    word = ids.select(_place(col).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63L as int))")).alias("bits"))
    got = word.toArrow()
    bitmap = np.zeros(BITS // 64, np.int64)
    bitmap[got["w"].to_numpy()] = got["bits"].to_numpy()
    words = F.broadcast(_table(rows.sparkSession, bitmap))
    place = _place(col)
    word = F.get("_words", F.shiftright(place, 6).bitwiseAND(F.lit(255).cast("long")).cast("int"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return rows.withColumn("_block", F.shiftright(place, 14)).join(words, "_block").where(word.bitwiseAND(bit) != 0).drop("_block", "_words")


def _table(spark, bitmap: np.ndarray) -> DataFrame:
    """Blocks of 256 words: 1024 rows at most."""
    import pyarrow as pa

    blocks = bitmap.reshape(-1, 256)
    full = np.flatnonzero(blocks.any(axis=1))
    words = pa.ListArray.from_arrays(pa.array(np.arange(0, 256 * len(full) + 1, 256, dtype=np.int32)), pa.array(blocks[full].ravel()))
    return spark.createDataFrame(pa.table({"_block": pa.array(full.astype(np.int64)), "_words": words}))
