"""Copies in media columns by local image descriptors.

Corners (Harris) of every part of a picture, on several scales, get an orientation (intensity centroid) and 256 binary brightness tests that turn
with it. Descriptors meet in TABLES hash tables of 16 bits each, a join that keeps pairs within FAR bits; image pairs
with enough of them must agree on one similarity transform (shift, turn, scale), which finds cropped, turned, scaled and
brightened copies.

Images with equal pixels form one class (class_id: its smallest image_id) and take part once, so a picture that a third
of all rows hold costs one. Query classes are matched against all classes; the result has one row for each image.

Images are binary PGM, PPM, 8-bit PNG or sequential JPEG (of which the brightness is read). Defined results: null, broken or other bytes are an image without pixels (a
class of its own bytes, no matches); an image without corners matches nothing; repeated image_ids take part one by one
and share their class if their pixels are equal; a null image_id is no query; empty tables give no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALES = (1.0, 0.75, 0.5)
#: Corners that are kept of each square of TILE pixels of every scale: their number grows with the area.
POINTS = 3
TILE = 16
TESTS = 256
WORDS = TESTS // 64
REACH = 9
MARGIN = 14
TABLES = 8
FAR = 28
LEAST_MATCHES = 4
INLIERS = 5
SIDE = 96
EVERY = 100
#: Edited copies that the query adds of each picture that it searches for.
EDITS = 3
#: Descriptors of queries, with their table keys, that are broadcast at most (about 64 bytes each); beyond, tables are joined by shuffles.
SMALL = 500_000
#: Corners that are described at a time, and pixels of pictures of one shape.
STEP = 4096
STEP_PIXELS = 1 << 21
#: Rows that a task renders and describes.
TASK_ROWS = 1000

_PATTERN = np.clip(np.random.default_rng(11).normal(0, REACH / 2, (TESTS, 2, 2)), -REACH, REACH)
_FIELDS = ("x", "y", "scale", "angle", *(f"d{k}" for k in range(WORDS)))
_POINT = "array<struct<" + ",".join(f"{n}:{'bigint' if n[0] == 'd' else 'float'}" for n in _FIELDS) + ">>"


def _png(data: bytes) -> np.ndarray | None:
    at, head, packed = 8, None, []
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
    if not head or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        return None
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    before = np.zeros(width * channels, np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].copy()
        if kind == 2:
            line += before
        elif kind in (1, 3, 4):
            for x in range(len(line)):
                a = int(line[x - channels]) if x >= channels else 0
                b, c = int(before[x]), int(before[x - channels]) if x >= channels else 0
                if kind == 1:
                    add = a
                elif kind == 3:
                    add = (a + b) // 2
                else:
                    p = a + b - c
                    add = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (int(line[x]) + add) & 255
        out[y] = before = line
    pixels = out.reshape(height, width, channels)
    return pixels[..., :3].mean(axis=2) if channels > 2 else pixels[..., 0].astype(float)


def _zigzag() -> np.ndarray:
    """Places in a block of 8 by 8, row by row, in the order of a JPEG scan: along diagonals, in turns."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


_ZIGZAG = _zigzag()
_COSINES = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8)[None, :] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)


class _Bits:
    """Bits of an entropy-coded segment, and the symbols of Huffman tables."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            self.at += 1
            self.held, self.n = (self.held << 8 | byte) & 0xFFFFFFFF, self.n + 8
        self.n -= n
        return self.held >> self.n & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (found := table.get((length, code))) is not None:
                return found
        raise ValueError("no such code")

    def number(self, size: int) -> int:
        """A coefficient of so many bits; those that start with 0 are negative."""
        value = self.take(size) if size else 0
        return value if not size or value >> size - 1 else value - (1 << size) + 1


def _block(bits: _Bits, dc: dict, ac: dict) -> np.ndarray:
    """Coefficients in the order of the scan; the first is a difference."""
    out = np.zeros(64)
    out[0] = bits.number(bits.symbol(dc))
    k = 1
    while k < 64:
        run, size = divmod(bits.symbol(ac), 16)
        if not size:
            if run < 15:
                break
            k += 16
            continue
        k += run
        out[k] = bits.number(size)
        k += 1
    return out


def _jpeg(data: bytes) -> np.ndarray | None:
    """Brightness of a sequential JPEG with Huffman codes; None for other kinds."""
    at, quants, codes, frame, interval = 2, {}, {}, None, 0
    while at + 4 <= len(data):
        mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(float)
                body = body[1 + 64 * (1 + wide) :]
        elif mark == 0xC4:
            while body:
                counts, code, place, table = body[1:17], 0, 17, {}
                for length, n in enumerate(counts, 1):
                    for _ in range(n):
                        table[length, code] = body[place]
                        code, place = code + 1, place + 1
                    code <<= 1
                codes[body[0]] = table
                body = body[place:]
        elif mark in (0xC0, 0xC1):
            frame = body
        elif 0xC2 <= mark <= 0xCF:
            return None
        elif mark == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif mark == 0xDA:
            break
        at += 2 + size
    if frame is None or frame[0] != 8:
        return None
    height, width = int.from_bytes(frame[1:3], "big"), int.from_bytes(frame[3:5], "big")
    parts = [(frame[6 + 3 * k], frame[7 + 3 * k] >> 4, frame[7 + 3 * k] & 15, frame[8 + 3 * k]) for k in range(frame[5])]
    scan = {body[1 + 2 * k]: (codes[body[2 + 2 * k] >> 4], codes[16 | body[2 + 2 * k] & 15]) for k in range(body[0])}
    if len(scan) != len(parts):
        return None
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    h, v = parts[0][1:3]
    grey = np.zeros((down * v * 8, across * h * 8))
    # restart marks part the segments; a stuffed zero follows each byte of ones
    segments = re.split(rb"\xff[\xd0-\xd7]", re.split(rb"\xff[\x01-\xcf\xd8-\xfe]", data[at + 2 + size :], maxsplit=1)[0])
    step = interval or across * down
    for s, segment in enumerate(segments):
        bits, last = _Bits(segment.replace(b"\xff\x00", b"\xff")), dict.fromkeys(scan, 0.0)
        for unit in range(s * step, min((s + 1) * step, across * down)):
            for k, (name, ph, pv, quant) in enumerate(parts):
                for j in range(pv):
                    for i in range(ph):
                        block = _block(bits, *scan[name])
                        block[0] = last[name] = last[name] + block[0]
                        if k == 0:
                            flat = np.zeros(64)
                            flat[_ZIGZAG] = block * quants[quant]
                            y, x = 8 * (unit // across * v + j), 8 * (unit % across * h + i)
                            grey[y : y + 8, x : x + 8] = _COSINES @ flat.reshape(8, 8) @ _COSINES.T
    return np.clip(grey[: -(-height * v // most_v), : -(-width * h // most_h)] + 128, 0, 255)


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey pixels, or None."""
    try:
        if data and data.startswith(b"\x89PNG\r\n\x1a\n"):
            return _png(data)
        if data and data.startswith(b"\xff\xd8\xff"):
            return _jpeg(data)
        if data and (m := re.match(rb"P([56])\s+(?:#.*\s)*(\d+)\s+(\d+)\s+255\s", data)):
            depth = 1 if m[1] == b"5" else 3
            width, height = int(m[2]), int(m[3])
            return np.frombuffer(data, np.uint8, width * height * depth, m.end()).reshape(height, width, depth).mean(axis=2)
    except (ValueError, KeyError, IndexError, struct.error, zlib.error):
        pass
    return None


def encode(pixels: np.ndarray) -> bytes:
    """A PGM file."""
    grey = np.clip(np.rint(pixels), 0, 255).astype(np.uint8)
    return b"P5\n%d %d\n255\n" % grey.shape[::-1] + grey.tobytes()


def resize(images: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear, of a stack of images."""
    _, h, w = images.shape
    ys, xs = (np.clip((np.arange(max(1, round(n * scale))) + 0.5) / scale - 0.5, 0, n - 1) for n in (h, w))
    y, x = ys.astype(int), xs.astype(int)
    fy, fx = (ys - y)[:, None], (xs - x)[None, :]
    y1, x1 = np.minimum(y + 1, h - 1), np.minimum(x + 1, w - 1)
    top = images[:, y][:, :, x] * (1 - fx) + images[:, y][:, :, x1] * fx
    low = images[:, y1][:, :, x] * (1 - fx) + images[:, y1][:, :, x1] * fx
    return top * (1 - fy) + low * fy


def _blur(x: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        for axis in (1, 2):
            p = np.concatenate([x.take([0], axis), x, x.take([-1], axis)], axis)
            n = x.shape[axis]
            x = (p.take(range(n), axis) + 2 * p.take(range(1, n + 1), axis) + p.take(range(2, n + 2), axis)) / 4
    return x


def describe(images: np.ndarray) -> list[list[tuple]]:
    """x, y, scale, angle and WORDS words of tests, for the corners of each image of a stack of one shape."""
    out: list[list[tuple]] = [[] for _ in images]
    disc = [(dy, dx) for dy in range(-7, 8) for dx in range(-7, 8) if dy * dy + dx * dx <= 49]
    dy, dx = np.array(disc).T
    for scale in SCALES:
        level = _blur(resize(images.astype(np.float32), scale), 2)
        _, h, w = level.shape
        if min(h, w) <= 2 * MARGIN + 2:
            continue
        gy, gx = np.gradient(level, axis=(1, 2))
        yy, xx, xy = (_blur(g, 2) for g in (gy * gy, gx * gx, gx * gy))
        corner = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = corner[:, MARGIN : h - MARGIN, MARGIN : w - MARGIN]
        near = np.max([corner[:, MARGIN + a : h - MARGIN + a, MARGIN + b : w - MARGIN + b] for a in (-2, -1, 0, 1, 2) for b in (-2, -1, 0, 1, 2)], axis=0)
        value = np.where((inner >= near) & (inner > 1.0), inner, 0)
        images_at, ys, xs = np.nonzero(value)
        # the strongest of each tile, ties by place
        tile = (images_at * (h // TILE + 1) + ys // TILE) * (w // TILE + 1) + xs // TILE
        order = np.lexsort((xs, ys, -value[images_at, ys, xs], tile))
        rank = np.arange(len(order)) - np.searchsorted(tile[order], tile[order])
        chosen = np.sort(order[rank < POINTS])
        for a in range(0, len(chosen), STEP):
            some = chosen[a : a + STEP]
            image, y, x = images_at[some], ys[some] + MARGIN, xs[some] + MARGIN
            patch = level[image[:, None], y[:, None] + dy, x[:, None] + dx]
            patch = patch - patch.mean(axis=1, keepdims=True)
            angle = np.arctan2((patch * dy).sum(axis=1), (patch * dx).sum(axis=1))
            cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            px, py = _PATTERN[..., 0], _PATTERN[..., 1]
            qx, qy = np.rint(cos * px - sin * py).astype(int), np.rint(sin * px + cos * py).astype(int)
            picked = level[image[:, None, None], np.clip(y[:, None, None] + qy, 0, h - 1), np.clip(x[:, None, None] + qx, 0, w - 1)]
            # the slope that gave the orientation would decide most tests alike; what is left of it does not
            slope_x, slope_y = ((patch * d).sum(axis=1)[:, None, None] / (d * d).sum() for d in (dx, dy))
            picked = picked - slope_x * qx - slope_y * qy
            words = np.packbits(picked[..., 0] < picked[..., 1], axis=1).view(np.int64)
            for j, i in enumerate(image.tolist()):
                out[i].append((float((x[j] + 0.5) / scale), float((y[j] + 0.5) / scale), 1 / scale, float(angle[j]), *words[j].tolist()))
    return out


def _described(media: DataFrame) -> DataFrame:
    kind = pa.list_(pa.struct([(n, pa.int64() if n[0] == "d" else pa.float32()) for n in _FIELDS]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                ids, data = (batch.column(c).slice(a, 64).to_pylist() for c in (0, 1))
                images = [decode(d) for d in data]
                digests = [hashlib.sha256(d or b"").hexdigest() if p is None else hashlib.sha256(repr(p.shape).encode() + p.astype("<f4").tobytes()).hexdigest() for d, p in zip(data, images)]
                points: list[list] = [[] for _ in ids]
                for shape in {p.shape for p in images if p is not None}:
                    some = [i for i, p in enumerate(images) if p is not None and p.shape == shape]
                    step = max(1, STEP_PIXELS // max(1, shape[0] * shape[1]))
                    for b in range(0, len(some), step):
                        for i, found in zip(some[b : b + step], describe(np.stack([images[i] for i in some[b : b + step]]))):
                            points[i] = [dict(zip(_FIELDS, f)) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests), pa.array(points, kind)], names=["image_id", "digest", "points"])

    return cut(media.select(F.col("image_id").cast("bigint"), F.col("image").cast("binary")).mapInArrow(run, f"image_id bigint, digest string, points {_POINT}"), "media-points")


def agree(matches: np.ndarray, tolerance: float = 3.0) -> int:
    """How many matches (qx, qy, q scale, q angle, x, y, scale, angle) one similarity transform explains, at best."""
    q, p = matches[:, 0] + 1j * matches[:, 1], matches[:, 4] + 1j * matches[:, 5]
    turn = matches[:, 6] / matches[:, 2] * np.exp(1j * (matches[:, 7] - matches[:, 3]))
    close = lambda m, t, reach: np.abs(m * q + t - p) <= reach * max(1.0, abs(m))
    best = 0
    for m, t in zip(turn, p - turn * q):
        same = close(m, t, 3 * tolerance) & (np.abs(np.angle(turn / m)) < 0.5) & (np.abs(np.log(np.abs(turn / m))) < 0.5)
        for _ in range(2):
            if len(np.unique(q[same])) < 2:
                break
            centre_q, centre_p = q[same].mean(), p[same].mean()
            m = ((p[same] - centre_p) * np.conj(q[same] - centre_q)).sum() / (np.abs(q[same] - centre_q) ** 2).sum()
            t = centre_p - m * centre_q
            same = close(m, t, tolerance)
        if 0.2 < abs(m) < 5:
            best = max(best, min(len(np.unique(np.round(q[same]))), len(np.unique(np.round(p[same])))))
    return best


def find_copies(media: DataFrame, every: int = EVERY, inliers: int = INLIERS) -> DataFrame:
    """(image_id, class_id, is_query, n_points, matches, n_matches) of every row of media(image_id, image)."""
    described = _described(media)
    is_query = F.coalesce(F.col("image_id") % every == 0, F.lit(False))
    classes = cut(described.groupBy("digest").agg(F.min("image_id").alias("class_id"), F.max(is_query).alias("asked"), F.first("points").alias("points")), "media-classes")
    point = classes.where("class_id IS NOT NULL").select("class_id", "asked", F.explode("points").alias("p")).select("class_id", "asked", "p.*")
    lane = lambda word, t: F.shiftrightunsigned(word, 16 * (t % 4)).bitwiseAND(65535)
    keyed = point.withColumn("key", F.explode(F.array(*(F.lit(t) * 65536 + lane(F.col(f"d{t // 4}"), t) for t in range(TABLES)))))
    asked = cut(keyed.where("asked").drop("asked").toDF(*(f"q_{c}" for c in keyed.drop("asked").columns)), "media-queries")
    differ = [F.col(f"d{k}").bitwiseXOR(F.col(f"q_d{k}")) for k in range(WORDS)]
    bits = functools.reduce(lambda a, b: a + b, map(F.bit_count, differ))
    first = F.coalesce(*(F.when(lane(differ[t // 4], t) == 0, t) for t in range(TABLES)))  # a pair is named in the first table that it shares
    side = F.broadcast(asked) if asked.count() <= SMALL else asked
    met = keyed.join(side, (F.col("key") == F.col("q_key")) & (F.col("class_id") != F.col("q_class_id")) & (bits <= FAR) & (first == F.floor(F.col("key") / 65536)))
    fields = ["q_x", "q_y", "q_scale", "q_angle", "x", "y", "scale", "angle"]
    pairs = met.groupBy("q_class_id", "class_id").agg(F.collect_set(F.array(*fields)).alias("matches")).where(F.size("matches") >= LEAST_MATCHES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            counts = [agree(np.array(sorted(r["matches"]), float)) for r in rows]
            kept = [(r["q_class_id"], r["class_id"]) for r, n in zip(rows, counts) if n >= inliers]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept)], names=["q_class_id", "class_id"])

    found = pairs.mapInArrow(run, "q_class_id bigint, class_id bigint").groupBy("q_class_id").agg(F.array_sort(F.collect_list("class_id")).alias("matches"))
    rows = described.select("image_id", "digest", F.size("points").alias("n_points")).join(classes.select("digest", "class_id"), "digest")
    joined = rows.join(found.withColumnRenamed("q_class_id", "class_id"), "class_id", "left").withColumn("is_query", is_query)
    matches = F.when(F.col("is_query"), F.coalesce("matches", F.array().cast("array<bigint>")))
    return joined.select("image_id", "class_id", "is_query", "n_points", matches.alias("matches"), F.when(F.col("is_query"), F.coalesce(F.size("matches"), F.lit(0))).alias("n_matches"))


def picture(vector: list | None, side: int = SIDE) -> np.ndarray:
    """A picture drawn from a vector: random blocks of four sizes, seeded by its bytes. Equal vectors give equal pictures."""
    data = np.array([0 if e is None else e for e in vector or ()], "<f4").tobytes()
    random = np.random.default_rng(int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little"))
    out = np.full((side, side), 128.0)
    for cell in (4, 6, 8, 12):
        blocks = random.integers(-28, 29, (side // cell + 1, side // cell + 1))
        out += np.kron(blocks, np.ones((cell, cell)))[:side, :side]
    return np.clip(out, 0, 255)


def edited(pixels: np.ndarray, how: int) -> np.ndarray:
    """An edited copy: 1 cropped, 2 turned by a quarter and brightened, 3 scaled up with less contrast."""
    if how == 1:
        return pixels[8:88, 4:86]
    if how == 2:
        return np.clip(np.rot90(pixels) * 1.05 + 8, 0, 255)
    return np.clip(resize(pixels[None], 4 / 3)[0] * 0.85 + 10, 0, 255)


def rendered(embeddings: DataFrame, every: int = EVERY, edits: int = EDITS) -> DataFrame:
    """A media table (image_id, image) of embeddings(vec_id, embedding): a picture of each row's vector, and edited copies of those
    of every so many rows. image_id is vec_id * (edits + 1), and that plus the number of the edit for a copy."""
    spread = max(1, -(-embeddings.count() // TASK_ROWS))  # vectors are small and pictures are not
    rows = embeddings.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<float>")).repartition(spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, images = [], []
            for i, vector in zip(*(c.to_pylist() for c in batch.columns)):
                pixels = picture(vector)
                copies = range(1, edits + 1) if i is not None and i % every == 0 else ()
                ids += [None if i is None else i * (edits + 1) + how for how in (0, *copies)]
                images += [encode(pixels), *(encode(edited(pixels, how)) for how in copies)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], names=["image_id", "image"])

    return rows.mapInArrow(run, "image_id bigint, image binary")


def report(embeddings: DataFrame, every: int = EVERY, edits: int = EDITS) -> DataFrame:
    """find_copies() of rendered(), with the rows' vec_id and the number of the edit (0: the picture itself)."""
    found = find_copies(rendered(embeddings, every, edits), every * (edits + 1))
    return found.withColumns({"vec_id": F.floor(F.col("image_id") / (edits + 1)).cast("bigint"), "edit": F.pmod("image_id", F.lit(edits + 1)).cast("int")})
