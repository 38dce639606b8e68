"""WARC archives of zstd frames with a dictionary of their own.

An archive (.warc.zst) opens with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary trained on
records of that archive; each record is a frame of its own, compressed with it, so that one record can be read at its
offset. Of records with equal payloads the one with the smallest page_id is a response, the others revisit it.

Archives are files in the shared folder. A task names them by partition, attempt and number, and only those that its
committed index rows name are ever read: a lost executor's files are ignored. An archive closes at ARCHIVE_BYTES of
records, which bounds a task's memory.

Defined results: null html is the empty payload; a page whose page_id equals the smallest of its payload is a response
(so rows that repeat it are), a null page_id counts as larger than any; equal payloads are found by SHA-1 and length;
control characters and spaces of a url are percent-encoded in the header; an archive of too few records to train on has
no dictionary; empty tables give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path, slices

#: Repeated payloads that are broadcast at most.
HOT_KEYS = 100_000
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20
LEVEL = 3
#: Tasks that read archives, at most.
READERS = 10_000
SKIPPABLE = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, first: tuple[int, str | None] | None, date: str = DATE) -> bytes:
    """A record's bytes; first: page_id and url of the response that it revisits, None for a response."""
    digest = payload_digest(payload)
    quoted = lambda u: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", u)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {date}"]
    head += ([] if url is None else [f"WARC-Target-URI: {quoted(url)}"]) + ([] if page_id is None else [f"WARC-Page-ID: {page_id}"])
    if first:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(first[0], digest)}", f"WARC-Refers-To-Page-ID: {first[0]}", f"WARC-Refers-To-Date: {date}"]
        head += [] if first[1] is None else [f"WARC-Refers-To-Target-URI: {quoted(first[1])}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from at most SAMPLE_BYTES of records, taken evenly; None where there are too few."""
    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    samples = [r[: 64 << 10] for r in records[::step]]
    if len(samples) < 16:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8, f=18, level=LEVEL)
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes]) -> tuple[bytes, list[tuple[int, int]]]:
    """An archive's bytes, and offset and length of each record's frame."""
    dictionary = train(records)
    out, at = io.BytesIO(), []
    if dictionary:
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
        out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        dictionary.precompute_compress(level=LEVEL)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    for r in records:
        start = out.tell()
        at.append((start, out.write(compressor.compress(r))))
    return out.getvalue(), at


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path if re.match(r"[a-z0-9]+:", path) else f"file://{path}"))


def _decompressor(file) -> zstandard.ZstdDecompressor:
    """For an open archive, which is left at its first record."""
    head = file.read(8)
    if len(head) == 8 and struct.unpack("<II", head)[0] == SKIPPABLE:
        packed = file.read(struct.unpack("<II", head)[1])
        return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed)))
    file.seek(0)
    return zstandard.ZstdDecompressor()


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a decompressed stream."""
    stream = io.BufferedReader(stream, 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().partition(":")
            fields[name] = value.strip()
        block = stream.read(int(fields["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record without its end")
        yield fields, block


def read_archive(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    system, name = _filesystem(path)
    with system.open_input_file(name) as file:
        yield from parse(_decompressor(file).stream_reader(file, read_across_frames=True, closefd=False))


def read_record(path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record, by its place in the index."""
    system, name = _filesystem(path)
    with system.open_input_file(name) as file:
        decompressor = _decompressor(file)
        file.seek(offset)
        return next(parse(decompressor.stream_reader(io.BytesIO(file.read(length)))))


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, and first (page_id and url) where another page is the response of an equal payload.

    Payloads that at least one in HOT_KEYS of the pages share (all repeated ones of a small table) are looked up by broadcast,
    so neither they nor, in a small table, any payload is shuffled; the others join by their keys."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), payload.alias("payload"))
    key = F.when(F.octet_length("payload") >= min_bytes, F.concat_ws(":", F.sha1("payload"), F.octet_length("payload")))
    keyed = rows.withColumn("key", key)
    firsts = keyed.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"))
    firsts = cut(firsts.where("n > 1"), "warc-firsts")
    least = max(2, pages.count() // HOT_KEYS)
    out = keyed.join(F.broadcast(firsts.where(F.col("n") >= least).drop("n")), "key", "left")
    if least > 2:
        others = out.where("first IS NULL").drop("first").join(firsts.where(F.col("n") < least).drop("n").hint("merge"), "key", "left")
        out = out.where("first IS NOT NULL").unionByName(others)
    other = F.col("first").isNotNull() & ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    return out.select("page_id", "url", "payload", F.when(other, F.col("first")).alias("first"))


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages(page_id, url, html) and return the index (page_id, archive, offset, length); the write is done on return."""
    folder = folder or fresh_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        ids, records, held, number = [], [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{number}.warc.zst"
            data, at = archive(records)
            with system.open_output_stream(f"{root}/{name}", compression=None) as file:
                file.write(data)
            offsets, lengths = zip(*at)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([f"{folder}/{name}"] * len(ids)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["page_id", "archive", "offset", "length"])

        for rows in slices(batches, ("page_id", "url", "payload", "first"), "payload"):
            for page_id, url, payload, first in zip(*rows):
                r = record(page_id, url, payload, (first["page_id"], first["url"]) if first else None)
                if records and held + len(r) > archive_bytes:
                    yield close()
                    ids, records, held, number = [], [], 0, number + 1
                ids.append(page_id)
                records.append(r)
                held += len(r)
        if records:
            yield close()

    return cut(with_revisits(pages, min_bytes).mapInArrow(write, "page_id bigint, archive string, offset bigint, length bigint"), "warc-index")


def summary(records: Iterable[tuple[dict[str, str], bytes]]) -> Iterator[tuple]:
    """The contract's columns of read records; a payload that differs from its digest raises."""
    number = lambda x: None if x is None else int(x)
    for fields, block in records:
        head, _, payload = block.partition(b"\r\n\r\n")
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and payload_digest(payload) != digest:
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload differs from its digest")
        n = len(payload) if kind == "response" else int(re.search(rb"(?m)^Content-Length: (\d+)", head)[1])
        yield number(fields.get("WARC-Page-ID")), n, digest, kind, number(fields.get("WARC-Refers-To-Page-ID"))


def read_archives(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the archives of an index."""
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                if columns := list(zip(*summary(read_archive(path)))):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=list(names))

    archives = index.select("archive").distinct()
    spread = max(1, min(archives.count(), READERS))  # a number, lest small names of large files meet in one task
    return archives.repartition(spread).mapInArrow(read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
