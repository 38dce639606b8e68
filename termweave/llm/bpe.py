"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

Word counts over the whole corpus give the FREQUENT most frequent words (a fixed bound on what reaches the driver and
its executors; it changes speed, never results). They are compiled into a minimal acyclic automaton: words share
prefixes and suffixes, and arcs carry integer outputs whose sum along a word's path numbers the word's id sequence.
Each executor fetches the compiled file once, and all its workers map it. A word outside it is merged exactly by the vocabulary's own merges.

Defined results: null text is empty (no tokens; it decodes to the empty text); special strings in texts get their ids, as
the library's default has it; repeated rows are encoded one by one; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import struct
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from . import vocabularies
from .common import KEPT, MEMO_BYTES, batch_slices, cut, keep_only, ship, slices

VOCABULARY = "word_bpe_49k.json"
FREQUENT = 1 << 15
#: Words whose ids a process remembers, and distinct words that it counts before it hands the counts on.
_MEMO = 400_000
_FLUSH = 200_000


class _Node:
    __slots__ = ("arcs", "final", "number", "words")

    def __init__(self) -> None:
        self.arcs: dict[int, _Node] = {}
        self.final = False
        self.number = -1
        self.words = 0

    def key(self) -> tuple:
        return (self.final, *((c, id(n)) for c, n in self.arcs.items()))


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The automaton of entries as one file: states, arcs with outputs, and the id sequences they number."""
    words = sorted(entries)
    root, register, path = _Node(), {}, []  # path: (parent, label, child) not yet minimised

    def minimise(depth: int) -> None:
        while len(path) > depth:
            parent, label, child = path.pop()
            parent.arcs[label] = register.setdefault(child.key(), child)

    last = b""
    for word in words:
        same = len(os.path.commonprefix([last, word]))
        minimise(same)
        node = path[-1][2] if path else root
        for label in word[same:]:
            child = node.arcs[label] = _Node()
            path.append((node, label, child))
            node = child
        node.final = True
        last = word
    minimise(0)

    order, stack = [], [(root, iter(()))]  # states in post-order, so that words below a state are known
    stack = [(root, iter(root.arcs.values()))]
    root.number = -2
    while stack:
        node, rest = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            node.words = node.final + sum(n.words for n in node.arcs.values())
            node.number = len(order)
            order.append(node)
        elif child.number == -1:
            child.number = -2
            stack.append((child, iter(child.arcs.values())))
    first, labels, target, output = [0], bytearray(), [], []
    for node in order:
        below = int(node.final)
        for label, child in node.arcs.items():
            labels.append(label)
            target.append(child.number)
            output.append(below)
            below += child.words
        first.append(len(target))
    ids = [entries[w] for w in words]
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype("<i4")
    arrays = [np.array(first, "<i4"), np.array(target, "<i4"), np.array(output, "<i4"), starts, np.array([i for s in ids for i in s], "<i4")]
    finals = bytes(n.final for n in order)
    head = struct.pack("<8i", len(order) - 1, *(len(a) for a in arrays), len(finals), len(labels))
    return head + b"".join(a.tobytes() for a in arrays) + finals + bytes(labels)


class Lexicon:
    """A compiled lexicon in a file, memory-mapped: the workers of an executor share its pages."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, *sizes = struct.unpack_from("<8i", self.map)
        at = 32
        arrays = []
        for n in sizes[:5]:
            arrays.append(memoryview(self.map)[at : at + 4 * n].cast("i"))
            at += 4 * n
        self.first, self.target, self.output, self.starts, self.ids = arrays
        self.finals, self.labels = at, at + sizes[5]

    def get(self, word: bytes) -> list[int] | None:
        """The ids of a word, or None if it is not in here."""
        state, number, find = self.root, 0, self.map.find
        first, labels = self.first, self.labels
        for i in range(len(word)):
            arc = find(word[i : i + 1], labels + first[state], labels + first[state + 1]) - labels
            if arc < 0:
                return None
            number += self.output[arc]
            state = self.target[arc]
        if not self.map[self.finals + state]:
            return None
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()


def _byte_letters() -> list[str]:
    """The printable letter of each byte: itself if printable, else the next of those from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


_LETTERS = _byte_letters()


class Codec:
    """Encoder and decoder of one process."""

    def __init__(self, path: str, lexicon: str | None) -> None:
        self.path, self.lexicon = path, Lexicon(lexicon) if lexicon else None
        tokenizer = vocabularies.load(path)
        self.model = tokenizer.model
        self.marks = vocabularies.specials(path)
        self.mark = regex.compile("(" + "|".join(map(regex.escape, self.marks)) + ")") if self.marks else None
        self.tokens = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
        self.numbers = list(range(len(self.tokens)))  # ids in the memo are these very objects
        self.memo: dict[str, tuple[int, ...]] = {}

    def merged(self, word: str) -> list[int]:
        """Ids of a word by the vocabulary's merges."""
        return [t.id for t in self.model.tokenize("".join([_LETTERS[b] for b in word.encode()]))]

    def word(self, word: str) -> tuple[int, ...]:
        ids = self.lexicon.get(word.encode()) if self.lexicon else None
        ids = tuple(map(self.numbers.__getitem__, self.merged(word) if ids is None else ids))
        if len(word) <= MEMO_BYTES:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            self.memo[word] = ids
        return ids

    def parts(self, text: str | None) -> list[str]:
        text = text or ""
        return self.mark.split(text) if self.mark and any(m in text for m in self.marks) else [text]

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        memo, word = self.memo.get, self.word
        for k, part in enumerate(self.parts(text)):
            if k % 2:
                ids.append(self.marks[part])
            else:
                for w in vocabularies.word_pieces(part, self.path):
                    ids += memo(w) or word(w)
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """As the library decodes without a decoder: the tokens, joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple, Codec] = {}
KEPT["bpe"] = [_CODECS, vocabularies.LOADED]


def _codec(path: str, shipped: str | None) -> Codec:
    """The codec of this process, with the lexicon of that name among the files that executors have fetched."""
    keep_only("bpe")
    key = (path, shipped)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(path, SparkFiles.get(shipped) if shipped else None)
    return _CODECS[key]


def frequent_words(docs: DataFrame, path: str, n: int = FREQUENT) -> list[str]:
    """At most n of the most frequent words of all texts: whole classes of about equal counts, while they fit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("bpe")
        codec, counts = Codec(path, None), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for (texts,) in slices(batches, ("text",), "text"):
            for text in texts:
                for part in codec.parts(text)[::2]:
                    counts.update(vocabularies.word_pieces(part, path))
                if len(counts) > _FLUSH:
                    yield flush()
        if counts:
            yield flush()

    words = docs.select(F.col("text").cast("string")).mapInArrow(count, "word string, n bigint")
    total = words.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    total = cut(total.withColumn("class", F.floor(8 * F.log2("n"))), "bpe-words")
    left, least = n, None
    for r in total.groupBy("class").agg(F.count("*").alias("words")).orderBy(F.desc("class")).collect():  # a few hundred classes
        left -= r.words
        if left < 0:
            break
        least = r["class"]
    return [] if least is None else [r.word for r in total.where(F.col("class") >= least).select("word").collect()]


def lexicon_of(docs: DataFrame, path: str, n: int = FREQUENT) -> bytes:
    """The compiled lexicon of the frequent words of docs."""
    codec = Codec(path, None)
    return compile_lexicon({w.encode(): codec.merged(w) for w in frequent_words(docs, path, n)})


def _mapped(docs: DataFrame, path: str | None, row, schema: list[tuple], ddl: str, n: int) -> DataFrame:
    path = path or vocabularies.default_path(VOCABULARY)
    shipped = ship(docs.sparkSession, lexicon_of(docs, path, n), "lexicon")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, shipped)
        for ids, texts in slices(batches, ("doc_id", "text"), "text"):
            columns = zip(*(row(codec, t) for t in texts))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, t) for c, (_, t) in zip(columns, schema))], names=["doc_id", *(k for k, _ in schema)])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, f"doc_id bigint, {ddl}")


def encode(docs: DataFrame, path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, ids) of every row of docs(doc_id, text)."""
    return _mapped(docs, path, lambda codec, t: (codec.encode(t),), [("ids", pa.list_(pa.int32()))], "ids array<int>", frequent)


def with_ids(docs: DataFrame, path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """docs with ids and n_tokens beside its columns, which replace clashing ones."""
    path = path or vocabularies.default_path(VOCABULARY)
    shipped = ship(docs.sparkSession, lexicon_of(docs, path, frequent), "lexicon")
    packed = docs.select(F.struct("*").alias("_doc"), F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, shipped)
        for batch in batch_slices(batches, "_text"):
            ids = [codec.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["_doc", "ids"])

    schema = StructType([packed.schema["_doc"], StructField("ids", ArrayType(IntegerType()))])
    found = packed.mapInArrow(run, schema)
    kept = [F.col("_doc")[c].alias(c) for c in docs.columns if c not in ("ids", "n_tokens")]
    return found.select(*kept, "ids", F.size("ids").cast("bigint").alias("n_tokens"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded(ids array<int>, ...) with the decoded text beside it."""
    path = path or vocabularies.default_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, None)
        for batch in batches:
            texts = [codec.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, decoded string")


def round_trip(docs: DataFrame, path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """The contract's columns: texts are encoded, the ids decoded, and both digested where they are, in one pass."""

    def row(codec: Codec, text: str | None) -> tuple:
        ids = codec.encode(text)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return len(ids), sha(" ".join(map(str, ids))), sha(codec.decode(ids))

    return _mapped(docs, path, row, [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())], "n_tokens bigint, ids_sha256 string, decoded_sha256 string", frequent)
