"""Exact token counts without ids: pieces are counted once per distinct pre-token.

A block of documents is cut into pre-tokens; it keeps, per document, how often each pre-token of the block's vocabulary
occurs. Distinct pre-tokens are counted by the tokenizer's own library, joined back to the blocks' vocabularies, and
each document sums frequency times pieces. A block sends each distinct pre-token once, however often it occurs, in lists
dealt out by ranges of its hash, so a frequent pre-token costs one entry a block.

Defined results: null text is empty (0 bytes, 0 tokens); special strings inside texts count as one token each, as the
library's default has it; rows that repeat a doc_id are counted one by one; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabularies
from .common import block_number, cut_by, slices

VOCABULARY = "byte_bpe_50k.json"
BLOCK_BYTES = 8 << 20
#: Bytes of pre-tokens that meet in one bucket: buckets follow the volume of the vocabularies and not the number of blocks.
BUCKET_BYTES = 8 << 20
LIMIT = 1024

_BLOCK = pa.schema([("block_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("specials", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("frequencies", pa.binary()), ("vocabulary", pa.list_(pa.string())), ("size", pa.int64())])
_BLOCK_DDL = "block_id bigint, ids array<bigint>, n_bytes array<bigint>, specials array<int>, sizes array<int>, frequencies binary, vocabulary array<string>, size bigint"


def _one(values, kind: pa.DataType) -> pa.Array:
    """A list column of one row."""
    flat = pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def _hashes(pieces: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(p.encode()) for p in pieces), np.uint64, len(pieces))


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _packed(at: np.ndarray, times: np.ndarray) -> bytes:
    """Places (as differences) and frequencies, bytes of equal weight together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(_planes(np.diff(at, prepend=0)) + _planes(times))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(2, 4, -1)
    step, times = (np.ascontiguousarray(p.T).view("<i4").ravel() for p in planes)
    return np.cumsum(step, dtype=np.int64), times


def count_tokens(docs: DataFrame, path: str | None = None, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of docs(doc_id, text); path: the vocabulary file, there on all executors."""
    path = path or vocabularies.default_path(VOCABULARY)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = list(vocabularies.specials(path))
        mark = regex.compile("|".join(map(regex.escape, marks))) if marks else None
        for number, (ids, texts) in enumerate(slices(batches, ("doc_id", "text"), "text", block_bytes), block_number()):
            vocabulary: dict[str, int] = {}
            n_bytes, found, at, times = [], [], [], []
            for text in texts:
                text = text or ""
                parts = mark.split(text) if mark and any(m in text for m in marks) else [text]
                counts = Counter(vocabularies.byte_pieces(parts[0], path))
                for part in parts[1:]:
                    counts.update(vocabularies.byte_pieces(part, path))
                n_bytes.append(len(text.encode()))
                found.append(len(parts) - 1)
                at.append(np.fromiter((vocabulary.setdefault(p, len(vocabulary)) for p in counts), np.int64, len(counts)))
                times.append(np.fromiter(counts.values(), np.int64, len(counts)))
            pieces = list(vocabulary)
            order = np.argsort(_hashes(pieces), kind="stable")  # the vocabulary in the order of its hashes
            place = np.empty(len(pieces), np.int64)
            place[order] = np.arange(len(pieces))
            for k, a in enumerate(at):
                a = place[a]
                up = np.argsort(a)
                at[k], times[k] = a[up], times[k][up]
            blob = _packed(np.concatenate(at), np.concatenate(times))
            columns = [pa.array([number], pa.int64()), _one(ids, pa.int64()), _one(n_bytes, pa.int64()), _one(found, pa.int32()), _one([len(a) for a in at], pa.int32()), pa.array([blob], pa.binary()), _one([pieces[i] for i in order], pa.string()), pa.array([sum(map(len, pieces)) + 8 * len(pieces)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=_BLOCK)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, pieces = batch.column("block_id")[i].as_py(), batch.column("vocabulary")[i].values
                bucket = (_hashes(pieces.to_pylist()) >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)
                at = np.flatnonzero(np.diff(bucket, prepend=-1))
                if len(at):
                    ends = pa.array([*at.tolist(), len(pieces)], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array([number] * len(at), pa.int64()), pa.ListArray.from_arrays(ends, pieces)], names=["bucket", "block_id", "pieces"])

    def count(table: pa.Table) -> pa.Table:
        """Pieces of each distinct pre-token of a bucket, joined to its blocks' lists."""
        lists = table.column("pieces").combine_chunks()
        coded = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        n = np.zeros(len(distinct), np.int64)
        for a in range(0, len(distinct), 50_000):
            n[a : a + 50_000] = [len(e.ids) for e in vocabularies.load(path).encode_batch_fast(distinct[a : a + 50_000], add_special_tokens=False)]
        joined = pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py(), pa.int32()), pa.array(n[coded.indices.to_numpy()].astype(np.int32)))
        return pa.table({"bucket": table.column("bucket"), "block_id": table.column("block_id"), "counts": joined})

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, n_bytes, tokens = [], [], []
        for row in left.to_pylist():
            parts = sorted(zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist()))
            pieces = np.array([n for _, part in parts for n in part], np.int64)
            at, times = _unpacked_rows(row["frequencies"], row["sizes"])
            sums = np.concatenate([[0], np.cumsum(pieces[at] * times)])
            ends = np.cumsum(row["sizes"], dtype=np.int64)
            ids += row["ids"]
            n_bytes += row["n_bytes"]
            tokens += (sums[ends] - sums[ends - np.array(row["sizes"], np.int64)] + np.array(row["specials"], np.int64)).tolist()
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n_bytes, pa.int64()), "n_tokens": pa.array(tokens, pa.int64())})

    def _unpacked_rows(blob: bytes, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        return _unpacked(blob) if sum(sizes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    packed = plain.mapInArrow(split, _BLOCK_DDL)
    blocks = cut_by(packed, "token-blocks", "block_id", 2 * packed.rdd.getNumPartitions())  # frequencies are not shuffled
    bits = max(1, -(-(blocks.agg(F.sum("size")).first()[0] or 0) // bucket_bytes)).bit_length()
    sent = blocks.select("block_id", "vocabulary").mapInArrow(send, "bucket bigint, block_id bigint, pieces array<string>")
    counts = sent.groupBy("bucket").applyInArrow(count, "bucket bigint, block_id bigint, counts array<int>")
    return blocks.drop("vocabulary", "size").groupBy("block_id").cogroup(counts.groupBy("block_id")).applyInArrow(total, "doc_id bigint, n_bytes bigint, n_tokens bigint")


def with_limit(counts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The contract's columns of count_tokens()."""
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
