"""Benchmark decontamination by winnowing.

Words are maximal runs of digits, ASCII letters (lower-cased) and non-ASCII characters. A window is WINDOW consecutive
words of a benchmark item (an item with fewer words, but not none, is one window). Of each WINDOW words only the smallest
of the hashes of its GRAM-word grams is kept, on either side, so two equal windows always share a fingerprint; windows of
short items are fingerprints themselves, looked up at every position of a document.

Fingerprints of documents and items are joined; a shared one is extended to the windows over it, which are joined to the
items' windows by 128-bit hashes of their words; items join last, to the windows that were hit. A bitmap of BITMAP bits,
of one size for any benchmark, marks the items' fingerprints, so that of the documents' only those that may be shared
leave the scan, and with them the texts that have any. No step gathers the windows of an item or the documents of a
window, so a one-word item that most documents hold costs one row for each place.

Defined results: null text has no words and is not contaminated; items without words or without item_id add no item_id
(words of items without item_id still count as hits); repeated rows are judged one by one; empty tables give no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import batch_slices, block_number, cut, hashes, keep_only, lean, mix, window_hash

WINDOW = 10
GRAM = 5
BITMAP = 1 << 25

_TABLE = bytes((c | 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PRINT = pa.struct([("n", pa.int32()), ("h", pa.int64()), ("at", pa.int32())])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def winnow(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints of a word sequence: of each WINDOW words the smallest gram hash."""
    grams = window_hash(mix(x), GRAM)
    span = WINDOW - GRAM + 1
    if len(grams) < span:
        return np.zeros(0, np.int64), grams[:0]
    low = np.lib.stride_tricks.sliding_window_view(grams, span)
    at = np.unique(np.arange(len(low)) + low.argmin(axis=1))
    return at, grams[at]


def prints_of(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints for windows of n words."""
    if n == WINDOW:
        return winnow(x)
    h = window_hash(mix(x), n)
    return np.arange(len(h)), h


def marked(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which hashes the bitmap marks."""
    bit = h % np.uint64(8 * len(bitmap))
    return (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def shared_prints(x: np.ndarray, lengths: list[int], bitmap: np.ndarray) -> list[dict]:
    """The fingerprints of a document's words that items may have too."""
    out = []
    for n in lengths:
        if n > len(x) or n == WINDOW and not marked(window_hash(mix(x), GRAM), bitmap).any():
            continue
        at, h = prints_of(x, n)
        some = np.flatnonzero(marked(h, bitmap))
        out += [{"n": n, "h": v, "at": p} for p, v in zip(at[some].tolist(), h[some].view(np.int64).tolist())]
    return out


def _key(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, n, keys of its windows, fingerprints."""
    for batch in batches:
        ids, out = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            words = words_of(text)
            n = min(WINDOW, len(words))
            if n:
                ids.append(i)
                out.append((n, [_key(words[k : k + n]) for k in range(len(words) - n + 1)], prints_of(hashes(words), n)[1].view(np.int64)))
        if out:
            n, keys, prints = zip(*out)
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(ids)), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.binary())), pa.array(prints, pa.list_(pa.int64()))], names=["item_id", "n", "keys", "prints"])


def _bitmap(prints: DataFrame) -> np.ndarray:
    """One bit for each fingerprint of prints(h): what reaches the driver is BITMAP bits at most."""
    bit = F.col("h").bitwiseAND(BITMAP - 1) + 1  # the function's own numbers start at 1
    parts = prints.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(BITMAP // 8, np.uint8)
    for r in parts.collect():
        at = (r.part - 1) * len(r.bits)
        out[at : at + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def find_overlap(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, n_words, n_hit, n_items, items (ids, sorted as strings, comma-joined), contaminated and hits (spans of
    words) of every row of docs(text, ...) against benchmark(item_id, text)."""
    docs = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    benchmark = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = cut(benchmark.mapInArrow(_item_windows, f"item_id {kind}, n int, keys array<binary>, prints array<bigint>"), "decontaminate-items")
    prints = items.select("n", F.explode("prints").alias("h")).distinct()
    owned = items.select("item_id", "n", F.explode("keys").alias("key")).distinct()
    lengths = sorted(r.n for r in items.select("n").distinct().collect())  # at most WINDOW values
    bitmap = _bitmap(prints)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row with a number and its words counted; texts only of those with fingerprints that items may have."""
        keep_only("words")
        row = block_number()
        for batch in batch_slices(batches, "_text"):
            counts, found, texts = [], [], []
            for text in batch.column("_text").to_pylist():
                words = words_of(text)
                counts.append(len(words))
                found.append(shared_prints(hashes(words), lengths, bitmap) if lengths and len(words) >= lengths[0] else [])
                texts.append(text if found[-1] else None)
            made = [pa.array(range(row, row + len(counts)), pa.int64()), pa.array(counts, pa.int64()), pa.array(found, pa.list_(_PRINT)), pa.array(texts, pa.string())]
            row += len(counts)
            kept = [c for n, c in zip(batch.schema.names, batch.columns) if n != "_text"]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*(n for n in batch.schema.names if n != "_text"), "_row", "n_words", "_prints", "_text"])

    a_print = StructType([StructField("n", IntegerType()), StructField("h", LongType()), StructField("at", IntegerType())])
    added = [StructField("_row", LongType()), StructField("n_words", LongType()), StructField("_prints", ArrayType(a_print)), StructField("_text", StringType())]
    scanned = cut(docs.mapInArrow(lean(scan), StructType([*docs.schema.fields[:-1], *added])), "decontaminate-rows")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows over the shared fingerprints of each text."""
        for batch in batch_slices(batches, "_text"):
            for row, text, shared in zip(*(batch.column(c).to_pylist() for c in ("_row", "_text", "shared"))):
                words = words_of(text)
                starts = {(p["n"], k) for p in shared for k in (range(max(0, p["at"] - WINDOW + GRAM), p["at"] + 1) if p["n"] == WINDOW else [p["at"]])}
                out = [(row, n, k, _key(words[k : k + n])) for n, k in sorted(starts) if k + n <= len(words)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["_row", "n", "start", "key"])

    candidates = scanned.where(F.size("_prints") > 0)
    met = candidates.select("_row", F.explode("_prints").alias("p")).select("_row", "p.*").join(prints, ["n", "h"], "left_semi")
    met = met.groupBy("_row").agg(F.collect_list(F.struct("n", "at")).alias("shared"))  # places of one document
    windows = candidates.select("_row", "_text").join(met, "_row").mapInArrow(lean(extend), "_row bigint, n int, start int, key binary")
    hit = cut(windows.join(owned.select("n", "key").distinct(), ["n", "key"], "left_semi"), "decontaminate-hits")

    end = F.col("start") + F.col("n")
    in_order = Window.partitionBy("_row").orderBy("start", "n")
    reached = F.coalesce(F.max(end).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    spans = hit.withColumns({"end": end, "first": (F.col("start") > reached).cast("int")}).withColumn("span", F.sum("first").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("_row", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    covered = spans.groupBy("_row").agg(F.sum(F.col("end") - F.col("start")).cast("bigint").alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("hits"))
    named = hit.select("_row", "n", "key").distinct().join(owned.where("item_id IS NOT NULL"), ["n", "key"]).groupBy("_row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("_items"))

    joined = scanned.drop("_prints", "_text").join(covered, "_row", "left").join(named, "_row", "left")
    no_items, no_hits = F.array().cast("array<string>"), F.array().cast("array<struct<start:int,end:int>>")
    return joined.select(
        *keep, "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.size(F.coalesce("_items", no_items)).cast("bigint").alias("n_items"),
        F.array_join(F.coalesce("_items", no_items), ",").alias("items"), F.col("n_hit").isNotNull().alias("contaminated"), F.coalesce("hits", no_hits).alias("hits"),
    )


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of find_overlap()."""
    return result.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


def brute_force(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = split(text)
        n = min(WINDOW, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = sorted({len(w) for w in windows})
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (owners := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= owners
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out
