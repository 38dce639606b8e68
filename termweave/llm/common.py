"""What the training-data operators share: cut points, word hashes, text blocks and packed hash lists."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the polynomial window hashes.
BASE = 0x9E3779B97F4A7C15
#: Distinct words a worker remembers before it starts its memo anew.
MEMO = 200_000
MEMO_BYTES = 64
#: Documents that one step of a Python worker handles at a time.
SLICE_BYTES = 4 << 20

_TEST_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or a temporary one where that is unset and all runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    if not _TEST_DIR:
        _TEST_DIR.append("file://" + tempfile.mkdtemp(prefix="termweave-"))
    return _TEST_DIR[0]


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver did; clusters use --py-files."""
    root, environment = str(Path(__file__).parents[2]), spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone at exit
        pass


def _forget(spark: SparkSession, table: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:  # the session may be gone at exit
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/termweave/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def ship(spark: SparkSession, data: bytes, name: str) -> str:
    """Bytes as a file of the shared folder that every executor fetches once; SparkFiles.get() finds it there by the name returned."""
    path = fresh_path(spark, name)
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file, True)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def cut(df: DataFrame, name: str, row_group_mb: int = 16) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.block.size", row_group_mb << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """cut() as a table of files by hash of a key: what is grouped or joined by the key later is not shuffled again."""
    spark, path, table = df.sparkSession, fresh_path(df.sparkSession, name), f"termweave_{uuid.uuid4().hex}"
    buckets = max(1, min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))))
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(table)
    atexit.register(_forget, spark, table)
    return spark.table(table)


def hash_sample(keys: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows of keys, those with the smallest hash of the key. A threshold on the hash leaves about 2 n rows to sort."""
    total = keys.count()
    rank = F.xxhash64(key)
    if total > 2 * n:
        keys = keys.where(rank < int(-(1 << 63) + (1 << 64) * (2 * n / total)))
    return keys.orderBy(rank, key).limit(n)


class WordHash(dict):
    """bytes -> 64-bit hash, remembered for up to MEMO words that are not longer than MEMO_BYTES."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: The memo of a worker process, for whichever operators run in it.
WORDS = WordHash()
#: What operators remember from task to task, by name. Workers live on, so one that turns to another operator forgets the rest.
KEPT: dict[str, list[dict]] = {"words": [WORDS]}


def hashes(words: list[bytes]) -> np.ndarray:
    """Word hashes by the memo of this process."""
    return WORDS.array(words)


def relieve() -> None:
    """Gives what a finished task held back to the system: idle workers stay, and an executor's memory is bounded."""
    WORDS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of a task's batches that is followed by relieve()."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            relieve()

    return task


def keep_only(name: str | None = None) -> None:
    """Called where a task's Python begins: empties what other operators keep in this process."""
    for other, memos in KEPT.items():
        if other != name:
            for memo in memos:
                memo.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hash(x: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
    """Hash of every n consecutive values of x, by doubling: O(len(x) log n). Empty where x is shorter."""
    if len(x) < n:
        return np.zeros(0, np.uint64)
    total, have, done = len(x) - n + 1, None, 0
    power, size = x, 1  # power[i]: hash of the size values from i on
    while done < n:
        if n & size:
            part = power[done : done + total]
            have = part if have is None else have * np.uint64(pow(base, size, 1 << 64)) + part
            done += size
        if done < n:
            power = power[:-size] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
            size *= 2
    return mix(have)


def slices(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], size_of: str, limit: int = SLICE_BYTES) -> Iterator[list[list]]:
    """Python columns of at most limit bytes of size_of at a time (or one row, if that is longer)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(size_of)).to_pylist()
        others = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns if c != size_of}
        start, held = 0, 0
        for i, value in enumerate(values):
            n = len(value) if value is not None else 0
            if held and held + n > limit:
                yield [values[start:i] if c == size_of else others[c][start:i] for c in columns]
                start, held = i, 0
            held += n
        yield [values[start:] if c == size_of else others[c][start:] for c in columns]


def batch_slices(batches: Iterator[pa.RecordBatch], size_of: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of batches of at most limit bytes of the text column size_of (or one row, if that is longer)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(size_of))), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows:
            yield batch.slice(start)


def block_number() -> int:
    """Where this task's own numbers start."""
    return TaskContext.get().partitionId() << 32
