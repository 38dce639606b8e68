"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

A document's set: the distinct SHINGLE-word shingles of its text (A-Z lower-cased; with fewer words the whole sequence is
one shingle). Documents with equal sets are one class. One permutation scatters shingles over UNIVERSE slots; a second
one, shifted circularly by k, gives signature coordinate k as its minimum over the set, so COORDINATES of them need two
permutations. BANDS of ROWS coordinates each put classes into buckets; every bucket with two classes is looked at.

No step emits all pairs of a group. Within a bucket, classes that may be linked (100 * intersection >= 80 * union) are
joined by a spanning forest. Two may be linked unless their parity sketches rule it out: a shingle flips one bit of a
sketch, so the bits in which two sketches differ are never more than the shingles that the sets do not share, and a pair
that is dropped is certainly no link. The components of those forests are units; every pair of a bucket that is a link
lies within one unit. Each unit's whole sets are compared exactly, and a spanning forest of its links leaves the task.
Buckets and units above a size in bytes are dealt out as pairs of blocks, so that none is held by one task as a whole.
What is lost is a link whose sets share no bucket: probability 1.2e-7 at similarity 0.8, less above. Components come from
alternating large-star and small-star steps, so hubs are never gathered either.

Defined results: a null or wordless text has an empty set and is linked with nothing; a null doc_id is linked with
nothing (component_id null, kept); rows that repeat a doc_id take part one by one and share a component if their texts
are linked; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MEMO, WORDS, cut, keep_only, lean, mix, slices

SHINGLE = 2
PERCENT = 80
BANDS = 40
ROWS = 5
COORDINATES = BANDS * ROWS
UNIVERSE = 1 << 20
#: Bits of a parity sketch: at least this many a shingle, as a power of two between least and most.
SKETCH_BITS = (4, 512, 1 << 18)
#: What one task compares at a time: bytes of a bucket's sketches, shingles of a unit (each set counts OVERHEAD more).
BUCKET_BYTES = 4 << 20
UNIT_SHINGLES = 2 << 20
OVERHEAD = 512
#: Row numbers that are broadcast at most, to pick their texts without a shuffle.
SMALL_ROWS = 1_000_000
#: Rows of a class from which on it may be joined by broadcast, and how many such classes there are at most.
HOT_ROWS, HOT_CLASSES = 10_000, 100_000

_TABLES: list[np.ndarray] = []


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The two permutations; the second is extended, so that its shifts are views."""
    if not _TABLES:
        random = np.random.default_rng(20)
        scatter = random.permutation(UNIVERSE).astype(np.uint32)
        circle = random.permutation(UNIVERSE).astype(np.uint32)
        _TABLES.extend([scatter, np.concatenate([circle, circle[:COORDINATES]])])
    return _TABLES[0], _TABLES[1]


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    x = WORDS.array(words)
    n = min(size, len(x))
    if not n:
        return x
    h = np.full(len(x) - n + 1, np.uint64(n))
    for k in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x[k : len(x) - n + 1 + k])
    return np.unique(h)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima over the set of the second permutation's shifts."""
    scatter, circle = permutations()
    shifted = np.lib.stride_tricks.sliding_window_view(circle, COORDINATES)
    slots = scatter[(hashes % np.uint64(UNIVERSE)).astype(np.int64)]
    low = np.full(COORDINATES, UNIVERSE, np.uint32)
    for a in range(0, len(slots), 256):
        np.minimum(low, shifted[slots[a : a + 256]].min(axis=0), out=low)
    return low


def parity(hashes: np.ndarray) -> np.ndarray:
    """The parity sketch of a set, as 64-bit words."""
    each, least, most = SKETCH_BITS
    bits = min(most, max(least, 1 << (each * len(hashes) - 1).bit_length()))
    flips = np.bincount(((hashes >> np.uint64(24)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.uint64)


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches of that many words, of the same sets: halves are added without carry."""
    while sketches.shape[-1] > words:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def spanning(n: np.ndarray, sketches: list[np.ndarray], percent: int, linked: Callable[[int, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, int]]:
    """A spanning forest, as index pairs, of the pairs that sizes and sketches do not rule out and linked(i, js) confirms.

    Each tree grows breadth-first: a set is compared only with those that no tree has reached yet.
    """
    words = np.array([len(x) for x in sketches])
    kinds = {w: np.flatnonzero(words == w) for w in np.unique(words).tolist()}
    stacked = {w: np.stack([sketches[i] for i in at]) for w, at in kinds.items()}
    place = np.empty(len(n), np.int64)
    for at in kinds.values():
        place[at] = np.arange(len(at))
    left = np.argsort(n, kind="stable")
    while len(left) > 1:
        queue, left = deque([left[0]]), left[1:]
        while queue and len(left):
            i = queue.popleft()
            sizes = n[left]
            low, high = np.searchsorted(sizes, [-(-percent * n[i] // 100), 100 * n[i] // percent + 1])
            near = left[low:high]
            if not len(near):
                continue
            keep = np.zeros(len(near), bool)
            for w in np.unique(words[near]).tolist() if len(kinds) > 1 else kinds:
                some = np.flatnonzero(words[near] == w)
                at = near[some]
                least = min(w, words[i])
                differ = np.bitwise_count(folded(stacked[w][place[at]], least) ^ folded(sketches[i], least)).sum(axis=1, dtype=np.int64)
                keep[some] = differ * (100 + percent) <= (100 - percent) * (n[i] + n[at])
            if linked and keep.any():
                some = np.flatnonzero(keep)
                keep[some] = linked(i, near[some])
            if keep.any():
                found = near[keep]
                yield from ((int(i), int(j)) for j in found)
                queue.extend(found)
                left = np.concatenate([left[:low], near[~keep], left[high:]])


def bands(low: np.ndarray) -> np.ndarray:
    """One key for each band."""
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """row, id, n, key of the set, band keys, parity sketch, and the text, of docs(row, id, text)."""
    names = ["row", "id", "n", "set_key", "bands", "sketch", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("words")
        for rows, ids, texts in slices(batches, ("row", "id", "text"), "text"):
            out = []
            for text in texts:
                h = shingles(text, size)
                if len(h):
                    out.append((len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), bands(signature(h)).view(np.int64), parity(h).tobytes()))
                else:
                    out.append((0, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((rows, ids, *zip(*out), texts), kinds)], names=names)

    return cut(docs.select("row", "id", "text").mapInArrow(lean(run), "row bigint, id bigint, n bigint, set_key binary, bands array<bigint>, sketch binary, text string"), "near-signatures")


def components(links: DataFrame) -> DataFrame:
    """(node, root): of every node of links(a, b), the smallest node that it reaches."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        rest = star.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _dealt(members: DataFrame, group: str, weight: Column, most: int) -> DataFrame:
    """members with part: groups heavier than most are split into blocks, and each pair of blocks is a part."""
    blocks = members.groupBy(group).agg(F.sum(weight).alias("weight")).where(F.col("weight") > most).select(group, F.ceil(F.col("weight") / most).cast("int").alias("blocks"))
    split = members.join(blocks, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("row"), "blocks").cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != block)
    pairs = F.transform(others, lambda j: F.least(block, j).cast("bigint") * F.col("blocks") + F.greatest(block, j))
    parts = F.when(F.col("blocks") > 1, pairs).otherwise(F.array(F.lit(0).cast("bigint")))
    return split.withColumn("part", F.explode(parts)).drop("blocks")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each (group, part), which are the first two columns of sorted batches; without those two."""
    held, key = [], None
    for batch in batches:
        for group, part, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if (group, part) != key:
                if len(held) > 1:
                    yield held
                key, held = (group, part), []
            held.append(tuple(rest))
    if len(held) > 1:
        yield held


class _Forest(dict):
    """Union-find over the rows that a task has seen, forgotten above MEMO rows."""

    def root(self, x: int) -> int:
        while (up := self.setdefault(x, x)) != x:
            self[x] = self[up]
            x = self[x]
        return x

    def joins(self, a: int, b: int) -> bool:
        """Whether a and b were apart so far."""
        if len(self) > MEMO:
            self.clear()
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)
        return a != b


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): forests of what may be linked, of each bucket in rows(key, part, row, n, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Forest()
        for held in _groups(batches):
            row, n, sketch = zip(*held)
            pairs = [(row[i], row[j]) for i, j in spanning(np.array(n), [np.frombuffer(x, np.uint64) for x in sketch], percent) if seen.joins(row[i], row[j])]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], names=["a", "b"])

    ordered = rows.repartition(F.col("key"), F.col("part")).sortWithinPartitions("key", "part", "row")
    return ordered.select("key", "part", "row", "n", "sketch").mapInArrow(lean(run), "a bigint, b bigint")


def _links(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b), as structs of id and row: forests of the links of each unit in rows(unit, part, row, id, text), by whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Forest()
        for held in _groups(batches):
            sets = [shingles(text, size) for *_, text in held]
            n = np.array([len(h) for h in sets])
            _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
            members = np.split(inverse.astype(np.int32), np.cumsum(n)[:-1])
            mark = np.zeros(int(inverse.max()) + 1, bool)

            def linked(i: int, js: np.ndarray) -> np.ndarray:
                mark[members[i]] = True
                both = np.array([np.count_nonzero(mark[members[j]]) for j in js])
                mark[members[i]] = False
                return 100 * both >= percent * (n[i] + n[js] - both)

            pairs = [held[i][:2] + held[j][:2] for i, j in spanning(n, [parity(h) for h in sets], percent, linked) if seen.joins(held[i][0], held[j][0])]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], names=["a", "id_a", "b", "id_b"])

    ordered = rows.repartition(F.col("unit"), F.col("part")).sortWithinPartitions("unit", "part", "row")
    found = ordered.select("unit", "part", "row", "id", "text").mapInArrow(lean(run), "a bigint, id_a bigint, b bigint, id_b bigint")
    return found.select(F.struct(F.col("id_a").alias("id"), F.col("a").alias("row")).alias("a"), F.struct(F.col("id_b").alias("id"), F.col("b").alias("row")).alias("b"))


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(row, id, n, root) of docs(row, id, text): root is the smallest (id, row) of the component, null without one."""
    signed = _signatures(docs, size)
    node = F.struct("id", "row")
    classes = signed.where("n > 0 AND id IS NOT NULL").groupBy("set_key").agg(F.min(node).alias("node"), F.count("*").alias("n_rows"))
    classes = cut(classes, "near-classes")
    # joins whose sides grow with the corpus are sorted shuffles at every size, so that small runs tell what large ones do
    keyed = signed.where("n > 0").select("row", "n", "bands").join(classes.select(F.col("node.row").alias("row")).hint("merge"), "row", "left_semi").select("row", "n", F.explode("bands").alias("key"))
    # one shuffle for counts and members, as both read the same columns
    keyed, each = keyed.repartition(F.col("key")), F.struct("row", "n")
    shared = keyed.groupBy("key").agg(F.min(each).alias("low"), F.max(each).alias("high")).where("low < high").select("key")
    members = cut(keyed.join(shared.hint("merge"), "key"), "near-buckets")
    # buckets of the same classes are looked at once
    content = members.groupBy("key").agg(F.struct(F.bit_xor(F.xxhash64("row")), F.bit_xor(F.xxhash64("row", F.lit(1))), F.count("*")).alias("content"))
    once = content.groupBy("content").agg(F.min("key").alias("key")).select("key")
    sketches = signed.select("row", "id", "sketch", "text")
    rows = cut(members.select("row").distinct(), "near-rows")
    sketches = cut(sketches.join(F.broadcast(rows) if rows.count() <= SMALL_ROWS else rows, "row", "left_semi"), "near-texts")
    dealt = _dealt(members.join(once, "key", "left_semi"), "key", F.col("n") / 2 + OVERHEAD, BUCKET_BYTES)
    candidates = cut(_candidates(dealt.join(sketches.select("row", "sketch").hint("merge"), "row"), percent), "near-candidates")

    units = components(candidates).select(F.col("node").alias("row"), F.col("root").alias("unit"))
    of_unit = _dealt(units.join(signed.select("row", "n"), "row"), "unit", F.col("n") + OVERHEAD, UNIT_SHINGLES)
    links = cut(_links(of_unit.join(sketches.select("row", "id", "text").hint("merge"), "row"), size, percent), "near-links")
    roots = components(links)

    of_set = classes.join(roots, "node", "left").select("set_key", "n_rows", "node", F.coalesce("root", "node").alias("root"))
    of_set = cut(of_set.where("n_rows > 1 OR root != node").drop("node"), "near-sets")
    placed = signed.select("row", "id", "n", F.when(F.col("id").isNotNull(), F.col("set_key")).alias("set_key"))
    # classes of many rows are few, whatever the corpus: those join by broadcast, so that no task holds all rows of one
    hot = of_set.where(F.col("n_rows") > max(HOT_ROWS, signed.count() // HOT_CLASSES)).select("set_key", F.col("root").alias("hot_root"))
    placed = placed.join(F.broadcast(hot), "set_key", "left")
    rest = F.col("hot_root").isNull() & F.col("set_key").isNotNull()
    joined = placed.where(rest).join(of_set.select("set_key", "root").hint("merge"), "set_key", "left")
    return joined.select("row", "id", "n", "root").unionByName(placed.where(~rest).select("row", "id", "n", F.col("hot_root").alias("root")))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs(doc_id, text)."""
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    found = _grouped(plain, size, percent).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root.id", "id").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, size: int, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id, ties by row; ids that are no integers or null come last."""
    numbered = cut(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row")), "near-numbered")
    last = F.lit((1 << 63) - 1)
    plain = numbered.select(F.col("_row").alias("row"), F.coalesce(F.col("_doc.doc_id").try_cast("bigint"), last).alias("id"), F.col("_doc.text").cast("string").alias("text"))
    dropped = _grouped(plain, size, percent).where("root.row != row").select(F.col("row").alias("_row"))
    return numbered.join(dropped, "_row", "left_anti").select("_doc.*")


def brute_force(rows: list[tuple], size: int = SHINGLE, percent: int = PERCENT) -> list[tuple]:
    """near_duplicates() by an inverted index over all shingles and union-find."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        n = min(size, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set())
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    index: dict[tuple, list[int]] = {}
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        common: dict[int, int] = {}
        for x in s:
            for j in index.get(x, ()):
                common[j] = common.get(j, 0) + 1
            index.setdefault(x, []).append(i)
        for j, both in common.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return [(doc, len(sets[i]), low[find(i)] if doc is not None else None, doc is None or low[find(i)] == doc) for i, (doc, _) in enumerate(rows)]
