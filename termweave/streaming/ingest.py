"""Streaming ingestion: an extension beside the batch operators, with the same semantics per batch."""

from __future__ import annotations

import functools
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from termweave.operators import control


def read_files(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder, so many a batch."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def daily_counts(events: DataFrame, at: str = "ts", by: Sequence[str] = (), late: str = "2 days") -> DataFrame:
    """Rows by day (and more) with a watermark: a day closes when events are so much later."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), *by, "n")


def sessions(events: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a key: rows without a longer gap."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_each(events: DataFrame, keys: Sequence[str], at: str = "ts", late: str = "2 days") -> DataFrame:
    """Rows without repeats of their key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


#: Parts that a table of upserts is kept in, by hash of the key: a batch rewrites the parts that it touches.
BUCKETS = 64


def _files(spark: SparkSession, path: str):
    """(file system, Path class) of a path."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark._jsc.hadoopConfiguration()), kind


def _manifest(spark: SparkSession, path: str) -> dict | None:
    """The last committed manifest: number, batch of each checkpoint, and version of each bucket."""
    files, at = _files(spark, path)
    if not files.exists(at(f"{path}/_manifests")):
        return None
    names = [f.getPath().getName() for f in files.listStatus(at(f"{path}/_manifests"))]
    done = sorted(n for n in names if n.removesuffix(".json").isdigit())
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/_manifests/{done[-1]}").collect())) if done else None


def _commit(spark: SparkSession, path: str, manifest: dict) -> None:
    """A manifest becomes the last one by a rename: readers see the whole of it or the one before."""
    files, at = _files(spark, path)
    name = f"{manifest['number']:012d}.json"
    hidden = at(f"{path}/_manifests/.{name}")
    out = files.create(hidden, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not files.rename(hidden, at(f"{path}/_manifests/{name}")):
        raise RuntimeError(f"{path}: version {manifest['number']} was committed by another writer")


def _read(spark: SparkSession, path: str, versions: Mapping[str, int], only: Sequence[int] | None = None) -> DataFrame | None:
    of: dict[int, list[int]] = {}
    for bucket, version in versions.items():
        if only is None or int(bucket) in only:
            of.setdefault(version, []).append(int(bucket))
    parts = [spark.read.option("basePath", f"{path}/v={v}").parquet(f"{path}/v={v}").where(F.col("_bucket").isin(b)) for v, b in sorted(of.items())]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).drop("_bucket") if parts else None


def upsert_batch(batch: DataFrame, number: int, path: str, checkpoint: str, keys: Sequence[str]) -> None:
    """One batch upserted: the buckets that it touches get a new version, then a manifest names all buckets' versions.

    A batch that the manifest has is left out, so a batch that is run again after a lost driver changes nothing twice."""
    spark = batch.sparkSession
    last = _manifest(spark, path) or {"number": -1, "batches": {}, "versions": {}}
    if last["batches"].get(checkpoint, -1) >= number:
        return
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    batch = batch.dropDuplicates(list(keys))
    touched = [r.b for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most BUCKETS
    if not touched:
        return
    before = _read(spark, path, last["versions"], touched)
    version = last["number"] + 1
    out = batch if before is None else control.upsert(before, batch, keys)
    out.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/v={version}")
    _commit(spark, path, {"number": version, "batches": last["batches"] | {checkpoint: number}, "versions": last["versions"] | {str(b): version for b in touched}})


def upsert_into(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str]) -> StreamingQuery:
    """Each batch upserted into a parquet table of versioned buckets; one writer a table."""
    return stream.writeStream.foreachBatch(lambda batch, number: upsert_batch(batch, number, path, checkpoint, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as it is, or None."""
    last = _manifest(spark, path)
    return _read(spark, path, last["versions"]) if last else None
