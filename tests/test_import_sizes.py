"""Imports that mean one place are tried once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import traverse as X


def test_imports_of_one_place_are_tried_once(spark):
    imports = spark.range(2000).select(F.concat(F.lit("src/a/f"), F.col("id") % 1000, F.lit(".ts")).alias("file"), F.concat(F.lit("../m"), F.col("id") % 2, F.lit(".js")).alias("module"))
    files = spark.createDataFrame([("src/m0.ts",), ("src/m1.js/index.ts",), ("src/m1.js",)], "path string")
    out = X.resolve_imports(imports, files)
    got = out.collect()
    assert len(got) == 1000 and {(r.module, r.target) for r in got} == {("../m0.js", "src/m0.ts"), ("../m1.js", "src/m1.js")}
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "Generate explode" in line)
    assert "Aggregate [base" in lines[at + 1]
