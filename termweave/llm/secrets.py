"""Secret scans with DataFrame functions only: fixed patterns, and character Markov models.

Two first-order models over ASCII characters, one of random strings and one of ordinary identifiers, are fitted on
labelled samples(token, random): by default RANDOM_SAMPLE generated strings (hexadecimal, base64, base32 and lower-case
alphanumerics of hashes) against the identifiers of at most DOCUMENT_SAMPLE documents, those with the smallest hash of
doc_id, without what the fixed patterns find. What reaches the driver is the counts of character pairs, at most the square
of the alphabet. Runs of at least LEAST_RUN characters are looked for where no fixed pattern matches. A run is a span of
kind markov if its log-likelihood ratio exceeds RATIO per pair; else its windows of LEAST_RUN characters that exceed it
are, joined and carried on to the next of / - _ on either side.

Positions come from splitting a text at the matches: lengths of parts and matches add up to the starts (code points).
Everything is linear in a text but for a small factor: arrays are bound to lambda variables, so that no expression over a
text is evaluated again for an element, running totals go by blocks, and pieces are cut from blocks of the text.

Defined results: null text is empty and has no spans; empty tables give no rows; repeated rows are scanned one by one;
without any document to learn from, the identifier model is uniform; other columns are kept by scan() (its own column
names start with an underscore and replace clashing ones).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

#: The patterns of the base kinds, in the order in which spans at one start are listed.
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
LEAST_VALUE = 6
MARKOV = "markov"
LEAST_RUN = 16
RATIO = 1.2
#: Weight, in pairs, of a character's own frequency.
FALLBACK = 200
DOCUMENT_SAMPLE = 2000
RANDOM_SAMPLE = 20000
FIRST, LAST = ord("+"), ord("z")
WIDTH = LAST - FIRST + 1
#: What fixed patterns find, and runs that stop where one of those begins (possessive: no recursion on long runs; the
#: lookahead spares short words the slower part).
BASE = "|".join([PATTERNS["assign"][:-1].removesuffix("+") + "{%d,})" % LEAST_VALUE, PATTERNS["access"], PATTERNS["hex"]])
RUN = rf"(?=[A-Za-z0-9+/_-]{{{LEAST_RUN}}})(?:(?!{BASE})[A-Za-z0-9+/_-]){{{LEAST_RUN},}}+"
#: Elements of a block of a running total, and characters of a block of text.
BLOCK, TEXT_BLOCK = 128, 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, most: bool = False) -> Column:
    """For each of some integers the total, or the maximum, of those before it (0 at first); by blocks, so nearly linear."""
    add = F.greatest if most else lambda a, b: a + b
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def by_blocks(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(BLOCK)), lambda i: F.aggregate(F.slice(v, i + 1, BLOCK), zero, step))
        return _let(blocks, lambda done: F.flatten(F.zip_with(done, F.aggregate(F.transform(done, lambda x: x["at"]), zero, step)["out"], lambda x, o: F.transform(x["out"], lambda y: add(y, o)))))

    return _let(values, lambda v: F.when(F.size(v) > 0, by_blocks(v)).otherwise(F.array().cast("array<int>")))


def _matches(text: Column, pattern: str) -> Column:
    """(s, m): start and text of each match."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def placed(zipped: Column) -> Column:
        before = _before(F.transform(zipped, lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))))
        return F.filter(F.zip_with(zipped, before, lambda x, at: F.struct((at + F.length(x["p"])).alias("s"), x["m"].alias("m"))), lambda x: x["m"].isNotNull())

    return F.when(text.rlike(pattern), _let(parts, placed)).otherwise(F.array().cast("array<struct<s:int,m:string>>"))


def _span(start: Column, end: Column, order: int, kind: str) -> Column:
    return F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(kind).alias("kind"))


def _spans(text: Column, order: int, kind: str) -> Column:
    """Sorted spans of a base kind: start, order, end, kind."""
    found = _matches(text, PATTERNS[kind])
    if kind == "assign":
        found = F.filter(found, lambda x: F.length(F.regexp_extract(x["m"], PATTERNS[kind], 2)) >= LEAST_VALUE)
    return F.transform(found, lambda x: _span(x["s"], x["s"] + F.length(x["m"]), order, kind))


def identifiers(docs: DataFrame, documents: int = DOCUMENT_SAMPLE) -> DataFrame:
    """Labelled ordinary: (token) of at most that many documents, without the runs that the base patterns find."""
    chosen = hash_sample(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", documents)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    for pattern in PATTERNS.values():
        texts = texts.withColumn("text", F.regexp_replace("text", pattern, " "))
    return texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_-]{4,}"), F.lit(0))).alias("token"))


def random_strings(docs: DataFrame, n: int = RANDOM_SAMPLE) -> DataFrame:
    """Labelled random: (token), generated."""
    ids = docs.sparkSession.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("h"), "id")
    digits = lambda alphabet: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(63), F.lit(2)), lambda i: F.substr(F.lit(alphabet), (F.conv(F.substr("h", i, F.lit(2)), 16, 10).cast("int") % len(alphabet)) + 1, F.lit(1))), "")
    kind = F.col("id") % 6
    coded = F.when(kind == 0, F.col("h")).when(kind == 1, F.upper(F.substring("h", 1, 40))).when(kind == 2, digits("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")).when(kind == 3, digits("abcdefghijklmnopqrstuvwxyz0123456789"))
    coded = coded.otherwise(F.regexp_replace(F.base64(F.unhex("h")), "=", ""))
    return ids.select(coded.alias("token"))


def pair_counts(tokens: DataFrame) -> dict[str, int]:
    """How often each pair of adjacent characters occurs: bounded by the square of the alphabet."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substr("token", i, F.lit(2)))
    return {r["pair"]: r["n"] for r in tokens.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).collect()}


def log_ratios(random: dict[str, int], ordinary: dict[str, int]) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) for characters a and b from FIRST to LAST; each model falls back on
    how often b occurs at all."""

    def conditional(counts: dict[str, int]) -> list[list[float]]:
        rows = [[0.0] * WIDTH for _ in range(WIDTH)]
        for pair, n in counts.items():
            rows[ord(pair[0]) - FIRST][ord(pair[1]) - FIRST] += n
        alone = [sum(row[b] for row in rows) + 0.5 for b in range(WIDTH)]
        share = [x / sum(alone) for x in alone]
        return [[(x + FALLBACK * p) / (sum(row) + FALLBACK) for x, p in zip(row, share)] for row in rows]

    pairs = zip(conditional(random), conditional(ordinary))
    return [max(-6.0, min(6.0, math.log(r / o))) for a, b in pairs for r, o in zip(a, b)]


def samples(docs: DataFrame, documents: int = DOCUMENT_SAMPLE, strings: int = RANDOM_SAMPLE) -> DataFrame:
    """The labelled samples (token, random) that train() takes by default."""
    return random_strings(docs, strings).withColumn("random", F.lit(True)).unionByName(identifiers(docs, documents).withColumn("random", F.lit(False)))


def train(labelled: DataFrame) -> list[float]:
    """The models' log-likelihood ratios, from samples(token, random)."""
    tokens = labelled.where("length(token) > 1")
    return log_ratios(pair_counts(tokens.where("random")), pair_counts(tokens.where("NOT random")))


def _scores(chars: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of each pair of adjacent characters."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")
    codes = F.transform(chars, lambda c: F.ascii(c) - FIRST)
    return _let(codes, lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda x, y: F.get(table, x * WIDTH + y)))


def random_parts(token: Column, model: list[float]) -> Column:
    """Spans (a, b) of a run that are random."""
    pairs = LEAST_RUN - 1
    span = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    none = F.array().cast("array<struct<a:int,b:int>>")

    def of_windows(chars: Column, windows: Column) -> Column:
        """A mask of the run: x for what windows cover, / for other separators; its parts with an x are the spans."""
        covered = lambda i: F.greatest(*(F.get(windows, i - k) for k in range(LEAST_RUN))) > RATIO * pairs
        mask = F.transform(chars, lambda c, i: F.when(covered(i), "x").when(c.isin("/", "-", "_"), "/").otherwise("."))
        return _let(F.array_join(mask, ""), lambda m: F.transform(_matches(m, "(?<![^/])[^/x]*+x[^/]*+"), lambda x: span(x["s"], x["s"] + F.length(x["m"]))))

    def of_scores(chars: Column, s: Column) -> Column:
        total = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x)
        windows = F.transform(F.sequence(F.lit(0), F.size(s) - pairs), lambda i: sum((F.get(s, i + k) for k in range(1, pairs)), F.get(s, i)))
        parts = _let(windows, lambda w: F.when(F.array_max(w) > RATIO * pairs, of_windows(chars, w)).otherwise(none))
        return F.when(total > RATIO * F.size(s), F.array(span(F.lit(0), F.size(chars)))).otherwise(parts)

    return _let(F.split(token, ""), lambda chars: _let(_scores(chars, model), lambda s: of_scores(chars, s)))


def scan(docs: DataFrame, model: list[float] | None = None, text: str = "text") -> DataFrame:
    """docs with _assign, _access, _hex (spans of the base kinds), _base (those by start) and _spans (with markov ones)."""
    model = model or train(samples(docs))
    docs = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    docs = docs.withColumns({f"_{kind}": _spans(F.col("_text"), k, kind) for k, kind in enumerate(PATTERNS)})
    docs = docs.withColumn("_base", F.array_sort(F.concat(*(F.col(f"_{kind}") for kind in PATTERNS))))
    runs = F.filter(_matches(F.col("_text"), f"{BASE}|{RUN}"), lambda x: ~x["m"].rlike(f"^(?:{BASE})"))
    of_run = lambda x: F.transform(random_parts(x["m"], model), lambda w: _span(x["s"] + w["a"], x["s"] + w["b"], len(PATTERNS), MARKOV))
    found = F.when(F.col("_text").rlike(RUN), F.flatten(F.transform(runs, of_run)))
    docs = docs.withColumn("_markov", found)
    return docs.withColumn("_spans", F.when(F.size("_markov") > 0, F.array_sort(F.concat("_base", "_markov"))).otherwise(F.col("_base"))).drop("_markov")


def joined(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """The contract's columns of scan()."""
    found = scan(docs.select("doc_id", "text"), model)
    return found.select("doc_id", *(F.size(f"_{kind}").cast("bigint").alias(f"n_{kind}") for kind in PATTERNS), F.sha2(joined("_base"), 256).alias("base_sha256"), joined("_spans").alias("spans"))


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    """Characters from start to end of a text in blocks of TEXT_BLOCK characters."""
    at = lambda k: F.greatest(start - k * TEXT_BLOCK, F.lit(0))
    cut = lambda k: F.substr(F.get(blocks, k), at(k) + 1, F.least(end - k * TEXT_BLOCK, F.lit(TEXT_BLOCK)) - at(k))
    inside = F.sequence(F.floor(start / TEXT_BLOCK).cast("int"), F.floor((end - 1) / TEXT_BLOCK).cast("int"))
    return F.when(end > start, F.array_join(F.transform(inside, cut), "")).otherwise("")


def _masked(text: Column, spans: Column, by: str) -> Column:
    """text with spans replaced; those that begin within an earlier one go with it."""

    def replaced(blocks: Column, s: Column, reached: Column) -> Column:
        first = F.filter(F.zip_with(reached, s, lambda at, x: F.struct(at.alias("at"), x["start"].alias("start"))), lambda x: x["start"] >= x["at"])
        body = F.array_join(F.transform(first, lambda x: F.concat(_piece(blocks, x["at"], x["start"]), F.lit(by))), "")
        return F.concat(body, _piece(blocks, F.array_max(F.transform(s, lambda x: x["end"])), F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))
    return _let(blocks, lambda b: _let(spans, lambda s: _let(_before(F.transform(s, lambda x: x["end"]), most=True), lambda reached: replaced(b, s, reached))))


def mask(docs: DataFrame, model: list[float] | None = None, by: str = "[secret]") -> DataFrame:
    """docs with every span of text replaced; all other columns and rows as they are."""
    model = model or train(samples(docs))
    found = scan(docs.select(F.struct("*").alias("_doc"), F.col("text").alias("_in")), model, "_in")
    masked = F.when(F.size("_spans") > 0, _masked(F.col("_text"), F.col("_spans"), by)).otherwise(F.col("_in"))
    return found.select(*(masked.alias("text") if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns))


def brute_force(text: str | None) -> list[tuple[int, int, int, str]]:
    """Base spans of a text: start, order, end, kind."""
    text = text or ""
    raw = {"assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    least = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    return sorted((m.start(), k, m.end(), kind) for k, kind in enumerate(raw) for m in re.finditer(raw[kind], text, re.ASCII) if least[kind](m))
