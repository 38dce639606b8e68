"""Removal of repeated passages: difference-cover anchors find candidate windows, extension to whole windows decides.

A window is WINDOW consecutive words of one document. A word goes if a window over it also starts earlier (smaller
doc_id, or same document and earlier start). Anchors are ANCHOR words long and stand only at positions that are, modulo
PERIOD, in the difference cover COVER: any two positions reach cover positions by one common shift below PERIOD, so any
two equal windows hold an equal anchor at the same offset, for ANCHOR + PERIOD - 1 = WINDOW.

Texts are packed into blocks of bounded size, written once to the shared folder. A block sends each distinct anchor hash
once, however often it occurs, and each distinct candidate window once, with its first place; so a passage that a third
of all documents hold costs one entry a block and not one a document, and no task gathers a group of documents.

Defined results: null text has no words; an empty table gives no rows; rows that repeat a doc_id are judged one by one,
and a window at the same (doc_id, start) in another of them is not earlier; a null doc_id comes after all others; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, block_number, cut_by, slices, window_hash

WINDOW = 20
PERIOD = 13
#: A perfect difference set modulo 13.
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
BLOCK_BYTES = 8 << 20
#: Bytes of text whose anchors and windows meet in one bucket: hashes are dealt out by volume, so that what a block sends to a
#: bucket does not become small with the number of blocks.
BUCKET_BYTES = 32 << 20
SECOND_BASE = 0xD1342543DE82EF95
LAST = np.iinfo(np.int64).max



def text_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block_id, ids, texts, size): neighbouring rows packed to about block_bytes; a longer text has a block of its own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, held = block_number(), [], [], 0

        def row() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            return pa.RecordBatch.from_pydict(
                {"block_id": [number], "ids": [[ids[i] for i in order]], "texts": [[texts[i] for i in order]], "size": [held]},
                schema=pa.schema([("block_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.string())), ("size", pa.int64())]),
            )

        for some_ids, some_texts in slices(batches, ("doc_id", "text"), "text"):
            for i, text in zip(some_ids, some_texts):
                n = len(text or "")
                if ids and held + n > block_bytes:
                    yield row()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(i)
                texts.append(text)
                held += n
        if ids:
            yield row()

    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return plain.mapInArrow(pack, "block_id bigint, ids array<bigint>, texts array<string>, size bigint")


class Block:
    """Words of a block's documents in (doc_id, position) order, as one array of hashes."""

    def __init__(self, ids: list, texts: list) -> None:
        self.ids = ids
        self.words = [(t or "").encode().split() for t in texts]
        counts = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        total = int(self.starts[-1])
        self.x = np.empty(total, np.uint64)
        for words, a in zip(self.words, self.starts):
            self.x[a : a + len(words)] = WORDS.array(words)
        self.doc = np.repeat(np.array([LAST if i is None else i for i in ids], np.int64), counts)
        self.pos = np.arange(total, dtype=np.int64) - np.repeat(self.starts[:-1], counts)
        self.left = np.repeat(counts, counts) - self.pos  # words from here to the document's end

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the cover's anchors."""
        h = window_hash(self.x, ANCHOR)
        at = np.flatnonzero(np.isin(self.pos[: len(h)] % PERIOD, COVER) & (self.left[: len(h)] >= ANCHOR))
        return at, h[at]

    def candidates(self, foreign: np.ndarray) -> np.ndarray:
        """Starts of the windows over an anchor that occurs again, here or in another block (foreign, sorted)."""
        at, h = self.anchors()
        if not len(at):
            return at
        _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        if len(foreign):
            place = np.minimum(np.searchsorted(foreign, h), len(foreign) - 1)
            again |= foreign[place] == h
        hit = np.zeros(len(self.x) + PERIOD + 1, np.int64)
        hit[at[again]] = 1
        sums = np.concatenate([[0], np.cumsum(hit)])
        n = len(self.x)
        near = sums[PERIOD : n + PERIOD] - sums[:n] > 0
        return np.flatnonzero(near & (self.left >= WINDOW))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of the window at each place, meant only where it fits."""
        return window_hash(self.x, WINDOW), (window_hash(self.x, WINDOW, SECOND_BASE) >> np.uint64(32)).astype(np.uint32)

    def firsts(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of hashes in order of place: index of the first of each, and for each hash that index."""
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return first, first[inverse]


def _of(table: pa.Table) -> tuple[int, Block] | None:
    if not table.num_rows:
        return None
    row = table.to_pylist()[0]
    return row["block_id"], Block(row["ids"], row["texts"])


def _gathered(table: pa.Table, column: str, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _by_bucket(h: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices) of each bucket that has any."""
    of = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=buckets))
    for b, end in enumerate(ends):
        start = ends[b - 1] if b else 0
        if end > start:
            yield b, order[start:end]


#: What is sent of a window: two hashes, and document and position of its first place in the block.
WINDOW_ROW = np.dtype([("h", "<u8"), ("g", "<u4"), ("pos", "<i4"), ("doc", "<i8")])
WINDOW_KEY = np.dtype([("h", "<u8"), ("g", "<u4")])


def _packed(rows: np.ndarray) -> bytes:
    """Field after field, bytes of equal weight together and integers as differences, so that shuffles compress them."""
    doc, pos = np.diff(rows["doc"], prepend=0), np.diff(rows["pos"], prepend=0).astype("<i4")
    planes = [np.ascontiguousarray(v.view(np.uint8).reshape(len(rows), -1).T) for v in (doc.astype("<i8"), pos)]
    return rows["h"].tobytes() + rows["g"].tobytes() + b"".join(p.tobytes() for p in planes)


def _unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // WINDOW_ROW.itemsize
    rows = np.empty(n, WINDOW_ROW)
    rows["h"] = np.frombuffer(blob, "<u8", n)
    rows["g"] = np.frombuffer(blob, "<u4", n, 8 * n)
    plane = lambda at, width: np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T)
    rows["doc"] = np.cumsum(plane(12 * n, 8).view("<i8").ravel())
    rows["pos"] = np.cumsum(plane(20 * n, 4).view("<i4").ravel())
    return rows


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row of docs(doc_id, text)."""
    packed = text_blocks(docs, block_bytes)
    # blocks are written by their number, two files' worth a partition read, and stay where they are: only hashes are shuffled
    written = cut_by(packed, "substring-blocks", "block_id", 2 * packed.rdd.getNumPartitions())
    buckets = max(1, -(-(written.agg(F.sum("size")).first()[0] or 0) // bucket_bytes))
    blocks = written.drop("size")

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, block = _of(pa.Table.from_batches([batch.slice(i, 1)]))
                h = np.unique(block.anchors()[1])
                out = [(b, number, h[at].tobytes()) for b, at in _by_bucket(h, buckets)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["bucket", "block_id", "anchors"])

    def shared_anchors(table: pa.Table) -> pa.Table:
        """For each block of a bucket, the hashes that another block has too."""
        numbers, blobs = table.column("block_id").to_pylist(), table.column("anchors").to_pylist()
        h = np.frombuffer(b"".join(blobs), "<u8")
        _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        again, ends = counts[inverse] > 1, np.cumsum([len(b) // 8 for b in blobs])
        out = [(n, h[e - len(b) // 8 : e][again[e - len(b) // 8 : e]].tobytes()) for n, b, e in zip(numbers, blobs, ends)]
        return pa.table({"block_id": pa.array([n for n, _ in out], pa.int64()), "anchors": pa.array([b for _, b in out], pa.binary())})

    def send_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if found := _of(left):
            number, block = found
            at = block.candidates(np.sort(_gathered(right, "anchors", "<u8")))
            h, g = block.windows()
            if len(at):
                first, _ = block.firsts(h[at])
                at = at[np.sort(first)]
                rows = np.empty(len(at), WINDOW_ROW)
                rows["h"], rows["g"], rows["doc"], rows["pos"] = h[at], g[at], block.doc[at], block.pos[at]
                out = [(b, number, _packed(rows[i])) for b, i in _by_bucket(h[at], buckets)]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("bucket", "block_id", "windows"), columns, (pa.int64(), pa.int64(), pa.binary()))})

    def earlier_elsewhere(table: pa.Table) -> pa.Table:
        """For each block of a bucket, its windows that another block has earlier."""
        numbers = table.column("block_id").to_pylist()
        parts = [_unpacked(b) for b in table.column("windows").to_pylist()]
        rows = np.concatenate(parts)
        order = np.lexsort((rows["pos"], rows["doc"], rows["g"], rows["h"]))
        s = rows[order]
        new = np.ones(len(s), bool)
        new[1:] = (s["h"][1:] != s["h"][:-1]) | (s["g"][1:] != s["g"][:-1])
        first = s[np.flatnonzero(new)[np.cumsum(new) - 1]]
        late = np.empty(len(s), bool)
        late[order] = (s["doc"] != first["doc"]) | (s["pos"] != first["pos"])
        keys = np.empty(len(rows), WINDOW_KEY)
        keys["h"], keys["g"] = rows["h"], rows["g"]
        ends = np.cumsum([len(p) for p in parts])
        out = [keys[e - len(p) : e][late[e - len(p) : e]].tobytes() for p, e in zip(parts, ends)]
        return pa.table({"block_id": pa.array(numbers, pa.int64()), "windows": pa.array(out, pa.binary())})

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, counts, removed, kept = [], [], [], []
        if found := _of(left):
            _, block = found
            n = len(block.x)
            fits = np.flatnonzero(block.left >= WINDOW)
            h, g = block.windows()
            cover = np.zeros(n + WINDOW + 1, np.int64)
            if len(fits):
                h, g = h[fits], g[fits]
                _, first = block.firsts(h)
                late = (block.doc[fits] != block.doc[fits[first]]) | (block.pos[fits] != block.pos[fits[first]])
                keys = np.sort(_gathered(right, "windows", WINDOW_KEY), order=("h", "g"))
                if len(keys):
                    place = np.minimum(np.searchsorted(keys["h"], h), len(keys) - 1)
                    late |= (keys["h"][place] == h) & (keys["g"][place] == g)
                cover[fits[late]] += 1
                cover[fits[late] + WINDOW] -= 1
            gone = np.cumsum(cover)[:n] > 0
            for i, words, a in zip(block.ids, block.words, block.starts):
                out = gone[a : a + len(words)]
                ids.append(i)
                counts.append(len(words))
                removed.append(int(out.sum()))
                kept.append(b" ".join(compress(words, ~out) if removed[-1] else words).decode())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    anchors = blocks.mapInArrow(send_anchors, "bucket bigint, block_id bigint, anchors binary")
    shared = anchors.groupBy("bucket").applyInArrow(shared_anchors, "block_id bigint, anchors binary")
    windows = blocks.groupBy("block_id").cogroup(shared.groupBy("block_id")).applyInArrow(send_windows, "bucket bigint, block_id bigint, windows binary")
    late = windows.groupBy("bucket").applyInArrow(earlier_elsewhere, "block_id bigint, windows binary")
    return blocks.groupBy("block_id").cogroup(late.groupBy("block_id")).applyInArrow(keep, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of remove_repeats()."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256), by a table of all windows."""
    words = [(i, [w.decode() for w in (t or "").encode().split()]) for i, t in rows]
    first: dict[tuple, tuple] = {}
    for i, w in words:
        for k in range(len(w) - WINDOW + 1):
            key, place = tuple(w[k : k + WINDOW]), (LAST if i is None else i, k)
            first[key] = min(first.get(key, place), place)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - WINDOW + 1):
            if first[tuple(w[k : k + WINDOW])] != (LAST if i is None else i, k):
                gone.update(range(k, k + WINDOW))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
