"""Stored tables whose rows lie in buckets by the hash of a key. A merge rewrites only the buckets that its changes touch.

``root/data/<version>/bucket=<b>`` holds rows, ``root/versions/<version>`` says which version's folder each bucket is read from. A version
exists once its folder under ``versions`` has its final name, which a rename gives it in one step: readers see the old table or the new one,
and of two writers that build on the same version one fails. Old folders stay readable until ``expire`` removes them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


Unpack = Callable[[DataFrame], DataFrame]


def bucket_of(keys: list[str] | list[Column], buckets: int) -> Column:
    """The bucket of a key; of literals it is a constant, which prunes folders. It is the partition that ``repartition(buckets, *keys)`` deals to."""
    return F.pmod(F.hash(*keys), F.lit(buckets))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions, oldest first."""
    fs, p = _fs(spark, f"{root}/versions")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n) for n in names if n.isdigit())


class Bucketed:
    """One version of a bucketed table."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        known = versions(spark, self.root)
        if not known:
            raise FileNotFoundError(f"{root} holds no bucketed table")
        self.version = known[-1] if version is None else version
        rows = spark.read.parquet(f"{self.root}/versions/{self.version:08d}").collect()  # one row a bucket
        self.keys, self.buckets, self.batch = list(rows[0].keys), rows[0].buckets, rows[0].batch
        self.place = {r.bucket: r.version for r in rows if r.bucket >= 0}
        self.schema = rows[0].schema

    def read(self, only: Iterable[int] | None = None) -> DataFrame:
        """The rows, with their bucket; of some buckets only, if named. Folders of other buckets are not even listed."""
        wanted = self.place if only is None else {b: self.place[b] for b in only if b in self.place}
        out = None
        for v in sorted(set(wanted.values())):
            here = sorted(b for b, x in wanted.items() if x == v)
            base = f"{self.root}/data/{v:08d}"
            part = self.spark.read.schema(self.schema + ", bucket int").option("basePath", base).parquet(*(f"{base}/bucket={b}" for b in here)).where(F.col("bucket").isin(here))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], self.schema + ", bucket int")

    def where_key(self, *values) -> DataFrame:
        """Rows whose (single) key is one of the values: their buckets only, and within them the row groups that can hold them."""
        kind = self.spark.createDataFrame([], self.schema).schema[self.keys[0]].dataType
        hit = self.spark.range(1).select(F.array_distinct(F.array(*(bucket_of([F.lit(v).cast(kind)], self.buckets) for v in values))).alias("b")).first().b if values else []
        return self.read(hit).where(F.col(self.keys[0]).isin(*values)) if values else self.read([])


def _schema_text(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "bucket")


def _commit(spark: SparkSession, root: str, version: int, place: dict[int, int], keys: list[str], buckets: int, schema: str, batch: int) -> None:
    rows = [(b, v, keys, buckets, schema, batch) for b, v in {-1: version, **place}.items()]
    temp = f"{root}/versions/.{uuid.uuid4().hex}"
    spark.createDataFrame(rows, "bucket int, version int, keys array<string>, buckets int, schema string, batch long").coalesce(1).write.parquet(temp)
    fs, source = _fs(spark, temp)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/versions/{version:08d}")
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
        raise RuntimeError(f"version {version} of {root} was committed by another writer")


def by_bucket(rows: DataFrame, others: list[str], items: Column, sep: str, buckets: int, numbers: str | None = None) -> DataFrame:
    """Rows with the strings of ``items`` dealt to their buckets: for each row and bucket the columns ``others``, ``bucket``, the strings of that
    bucket as ``packed``, joined by sep, which none holds, and of the array of ints ``numbers``, if named, those that belong to them."""
    more = [numbers] if numbers else []
    # the strings are the one element of an array, so that they are made once a row
    one = rows.select(*others, *more, F.explode(F.array(items)).alias("packed")).where(F.size("packed") > 0)
    held = one.select(*others, *more, F.concat_ws(sep, "packed").alias("packed"), F.transform("packed", lambda x: bucket_of([x], buckets)).alias("bucket"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*others).schema), "bucket int, packed string", *(f"`{n}` array<int>" for n in more)])

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        place = batch.column("bucket")
        row = np.repeat(np.arange(len(batch)), np.diff(place.offsets.to_numpy()))
        run = row * buckets + place.flatten().to_numpy()
        order = np.argsort(run, kind="stable")
        run = run[order]
        starts = np.flatnonzero(np.diff(run, prepend=-1))
        ends = pa.array(np.append(starts, len(run)).astype(np.int32))
        part = lambda flat: pa.ListArray.from_arrays(ends, flat.take(pa.array(order)))
        whose = pa.array(row[order][starts])
        strings = pc.binary_join(part(pc.split_pattern(batch.column("packed"), sep).flatten()), sep)
        out = [*(batch.column(c).take(whose) for c in others), pa.array((run[starts] % buckets).astype(np.int32)), strings]
        return pa.RecordBatch.from_arrays(out + [part(batch.column(n).flatten()) for n in more], names=[*others, "bucket", "packed", *more])

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 500):
                yield deal(batch.slice(lo, 500))

    return held.mapInArrow(run, schema)


def _put(rows: DataFrame, root: str, version: int, keys: list[str], buckets: int, sort: list[str] | None, unpack: Unpack | None = None) -> None:
    """A bucket's rows go to as many tasks as its size asks for, each sorted for row-group pruning."""
    dealt = (rows if "bucket" in rows.columns else rows.select("*", bucket_of(keys, buckets).alias("bucket"))).hint("rebalance", "bucket")
    (unpack(dealt) if unpack else dealt).sortWithinPartitions("bucket", *(sort or keys)).write.partitionBy("bucket").mode("overwrite").parquet(f"{root}/data/{version:08d}")


def _present(spark: SparkSession, root: str, version: int) -> set[int]:
    fs, p = _fs(spark, f"{root}/data/{version:08d}")
    return {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if "=" in s.getPath().getName()} if fs.exists(p) else set()


def create(df: DataFrame, root: str, keys: list[str], buckets: int, sort: list[str] | None = None, unpack: Unpack | None = None) -> Bucketed:
    """Write df as version 0 of a bucketed table. df must not have a column bucket; a null key has a bucket like any other.

    With unpack, df's rows are a smaller form that is dealt to the buckets: unpack makes the table's rows of them there and keeps their
    column bucket. If a row of df stands for several rows, which must be of one bucket, df has that column already."""
    spark, root = df.sparkSession, root.rstrip("/")
    if versions(spark, root):
        raise FileExistsError(f"{root} already holds a bucketed table")
    _put(df, root, 0, keys, buckets, sort, unpack)
    rows = unpack(df if "bucket" in df.columns else df.withColumn("bucket", F.lit(0))) if unpack else df
    _commit(spark, root, 0, dict.fromkeys(_present(spark, root, 0), 0), keys, buckets, _schema_text(rows), -1)
    return Bucketed(spark, root)


def merge(spark: SparkSession, root: str, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None, sort: list[str] | None = None, unpack: Unpack | None = None) -> Bucketed:
    """The next version: combine(stored rows, changes) for the buckets that hold a key of the changes; the other buckets keep their files.

    combine must give rows of those keys only by rows of the same keys, as upserts and deletes do. With a batch number, one that was
    merged before changes nothing, so a repeated micro-batch counts once. No changes make no version. With unpack, combine gives packed
    rows, as in ``create``; of rows of buckets that no change touches nothing is written."""
    now = Bucketed(spark, root)
    if batch is not None and batch <= now.batch:
        return now
    hit = sorted(r.b for r in changes.select(bucket_of(now.keys, now.buckets).alias("b")).distinct().collect())  # at most one row a bucket
    if not hit:
        return now
    after = combine(now.read(hit).drop("bucket"), changes)
    version = now.version + 1
    after = after.where(F.col("bucket").isin(hit)) if "bucket" in after.columns else after if unpack else after.select(spark.createDataFrame([], now.schema).columns)
    _put(after, now.root, version, now.keys, now.buckets, sort, unpack)
    place = {b: v for b, v in now.place.items() if b not in hit} | dict.fromkeys(_present(spark, now.root, version), version)
    _commit(spark, now.root, version, place, now.keys, now.buckets, now.schema, now.batch if batch is None else batch)
    return Bucketed(spark, root)


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Forget all but the last versions, and remove the data folders that none of these reads; returns the removed data versions."""
    known = versions(spark, root)
    old, live = known[:-keep], known[-keep:]
    used = {v for k in live for v in Bucketed(spark, root, k).place.values()}
    gone = []
    for v in old:
        fs, p = _fs(spark, f"{root}/versions/{v:08d}")
        fs.delete(p, True)
    for v in known:
        if v not in used and v not in live:
            fs, p = _fs(spark, f"{root}/data/{v:08d}")
            if fs.exists(p) and fs.delete(p, True):
                gone.append(v)
    return gone
