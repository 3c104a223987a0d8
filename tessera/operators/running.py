"""Running sums and ranks along groups of any size: no group is one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.stored import stored


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with a column for each of ``sums``: its running sum along the rows of a group in the given order, the row included; null counts 0.

    What a window over the whole group gives, in two levels: rows are dealt by ranges of (group, order), so that a large group lies in many
    parts; sums run within each part, and what the group has in earlier parts, one number a part, is added. Rows of equal order stand in one
    part, in no fixed order among themselves: name a unique column last. Without a group all rows are one."""
    names = list(sums)
    keys = [*(F.col(f"`{c}`") for c in by), *order]
    dealt = df.withColumns({f"_v_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    here = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({n: F.sum(f"_v_{n}").over(here) for n in names})
    parts = dealt.groupBy("_part", *by).agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a part
    # groups that lie in one part have nothing before: only the others are added
    earlier = parts.select("_part", *by, *(F.sum(f"_t_{n}").over(before).alias(f"_b_{n}") for n in names)).where(f"`_b_{names[0]}` is not null")
    earlier = earlier.select(F.col("_part").alias("_p"), *(F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(by)), *(f"_b_{n}" for n in names))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_g{i}"))
    out = local.join(earlier, same, "left").withColumns({n: F.col(n) + F.coalesce(f"_b_{n}", F.lit(0)) for n in names})
    return out.drop("_at", "_part", "_p", *(f"_v_{n}" for n in names), *(f"_b_{n}" for n in names), *(f"_g{i}" for i in range(len(by))))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with the 1-based place of each row in its group, as ``running`` counts it."""
    return running(df, by, order, {name: F.lit(1).cast("long")})
