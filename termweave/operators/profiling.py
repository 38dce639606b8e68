"""Profiles of unknown tables: columns, keys, grain."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations, islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import constants as K

from . import duplicates

EVALUATIONS = 3000


def profile(df: DataFrame, tokens: Sequence[str] = K.NULL_TOKENS) -> DataFrame:
    """(column, n, null_share, token_null_share, n_unique) of all columns, by one aggregate."""
    made = []
    for i, c in enumerate(df.columns):
        x = F.col(f"`{c}`").cast("string")
        token = x.isNull() | F.upper(F.trim(x)).isin(list(tokens))
        made.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.round(F.avg(x.isNull().cast("int")), 6).alias("null_share"), F.round(F.avg(token.cast("int")), 6).alias("token_null_share"), F.countDistinct(x).alias("n_unique")).alias(f"_{i}"))
    return df.agg(*made).select(F.explode(F.array(*(F.col(f"_{i}") for i in range(len(made))))).alias("r")).select("r.*")


def frequent_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = K.PROFILE_TOP) -> DataFrame:
    """(column, value, n, rank) of each column's k most frequent values, by one pass over unpivoted columns."""
    columns = list(columns or df.columns)
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "value")
    counts = long.where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value")))
    return ranked.where(F.col("rank") <= k)


def distinct_values(df: DataFrame, columns: Sequence[str], most: int = K.PROFILE_VALUES) -> DataFrame:
    """(column, values) of columns with at most that many distinct values, sorted and joined."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], list(columns), "column", "value")
    known = long.where("value IS NOT NULL").distinct()
    few = known.groupBy("column").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("column")
    return known.join(F.broadcast(few), "column").groupBy("column").agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("values"))


def uniqueness(columns: Sequence[str]) -> Column:
    """Share of distinct keys; null is a value in a key of several columns, and none in a single one."""
    key = F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)
    return F.countDistinct(key) / F.count("*")


def uniqueness_scores(df: DataFrame, keys: Sequence[Sequence[str]], approximate: bool = False) -> DataFrame:
    """(key, uniqueness) of several keys. Each key is one hash column, so that all of them take one pass."""
    hashed = df.select(*((F.col(k[0]) if len(k) == 1 else F.xxhash64(*k)).alias(f"_{i}") for i, k in enumerate(keys)))
    count = F.approx_count_distinct if approximate else F.countDistinct
    made = [F.struct(F.lit("+".join(k)).alias("key"), (count(f"_{i}") / F.count("*")).alias("uniqueness")).alias(f"_{i}") for i, k in enumerate(keys)]
    return hashed.agg(*made).select(F.explode(F.array(*(F.col(f"_{i}") for i in range(len(keys))))).alias("r")).select("r.*")


def candidate_keys(df: DataFrame, columns: Sequence[str], most: int = 3, least: float = 0.98, batch: int = 16) -> list[tuple[tuple[str, ...], float]]:
    """Keys of up to most columns that are that unique, none holding a smaller one, best first. Many combinations are
    counted by each pass, over all rows whatever their number."""
    found: list[tuple[tuple[str, ...], float]] = []
    done = 0
    for size in range(1, most + 1):
        pool = [c for c in combinations(columns, size) if not any(set(k) <= set(c) for k, _ in found)]
        for a in range(0, len(pool), batch):
            some = pool[a : a + batch][: max(0, EVALUATIONS - done)]
            if not some:
                break
            done += len(some)
            scores = {r.key: r.uniqueness for r in uniqueness_scores(df, some).collect()}
            found += [(c, scores["+".join(c)]) for c in some if scores["+".join(c)] >= least]
    return sorted(found, key=lambda x: (len(x[0]), -x[1], x[0]))


#: Fixed values of the tiered key search: distinct values and null rates of anchors and of discriminators, sizes and stops.
ANCHOR_VALUES, LEAST_VALUES, ANCHOR_NULLS, TIER_NULLS = 50, 2, 0.05, 0.30
UNIQUE_ENOUGH, NEARLY = 0.995, 0.003
POOL, KEY_SIZE, TOP_KEYS, TIER_EVALUATIONS = 8, 6, 10, 3000
ANCHOR_NAMES = re.compile(r"(?:student|learner|person|enrollment|sis|member|participant)[_\s]?id", re.IGNORECASE)


@dataclass
class CandidateKey:
    columns: tuple[str, ...]
    uniqueness: float
    null_rate: float
    rank: int = 0


def key_tiers(df: DataFrame) -> tuple[list[str], list[str], dict[str, float]]:
    """Anchors (many distinct values, few nulls), discriminators (the rest that tell rows apart), and null rates; by one aggregate.

    Columns of fractions are neither. Without an anchor under the strict null rate the looser one of discriminators holds."""
    kinds = dict(df.dtypes)
    columns = [c for c in df.columns if kinds[c] not in ("float", "double") and not kinds[c].startswith(("array", "map", "struct"))]
    row = df.agg(F.count("*").alias("_n"), *(F.countDistinct(c).alias(f"{c}|u") for c in columns), *(F.avg(F.col(c).isNull().cast("int")).alias(f"{c}|z") for c in columns)).first()
    nulls = {c: row[f"{c}|z"] or 0.0 for c in columns}
    pool = lambda least, most, out=(): sorted((c for c in columns if c not in out and row[f"{c}|u"] >= least and nulls[c] <= most), key=lambda c: (-row[f"{c}|u"], c))[:POOL]
    least = max(LEAST_VALUES, min(ANCHOR_VALUES, row["_n"]))
    anchors = pool(least, ANCHOR_NULLS) or pool(least, TIER_NULLS)
    return anchors, pool(LEAST_VALUES, TIER_NULLS, anchors), nulls


def ranked_keys(df: DataFrame, batch: int = 16) -> list[CandidateKey]:
    """The TOP_KEYS most unique keys: anchors alone, then combinations that hold an anchor, smaller ones first, until enough
    are as unique as the best. Every figure is counted over all rows, a batch of combinations a pass. Where columns are named
    as ids of persons, keys of several columns hold one of them, and such keys win ties."""
    anchors, others, nulls = key_tiers(df)
    if not anchors:
        return []

    def scored(keys: Iterable[tuple[str, ...]]) -> Iterator[CandidateKey]:
        keys = iter(keys)
        while some := list(islice(keys, batch)):
            scores = {r.key: r.uniqueness for r in uniqueness_scores(df, some).collect()}
            yield from (CandidateKey(k, round(scores["+".join(k)] or 0.0, 4), round(max(nulls[c] for c in k), 4)) for k in some)

    found = list(scored((c,) for c in anchors))
    unique = [set(k.columns) for k in found if k.uniqueness >= UNIQUE_ENOUGH]
    pool = [*anchors, *others]
    wanted = (k for size in range(2, min(KEY_SIZE, len(pool)) + 1) for k in combinations(pool, size) if set(k) & set(anchors) and not any(u <= set(k) for u in unique))
    for key in scored(islice(wanted, TIER_EVALUATIONS)):
        found.append(key)
        best = max(k.uniqueness for k in found)
        as_good = sum(k.uniqueness >= best for k in found)
        nearly = sum(k.uniqueness >= best - NEARLY for k in found)
        if best >= UNIQUE_ENOUGH and (as_good >= TOP_KEYS or nearly >= 2 * TOP_KEYS) or as_good >= TOP_KEYS and key.uniqueness < best:
            break
    persons = {c for c in df.columns if ANCHOR_NAMES.search(c)}
    kept = [k for k in found if len(k.columns) == 1 or not persons or persons & set(k.columns)]
    kept.sort(key=lambda k: (-k.uniqueness, bool(persons) and not persons & set(k.columns), len(k.columns)))
    for rank, key in enumerate(kept[:TOP_KEYS], 1):
        key.rank = rank
    return kept[:TOP_KEYS]


def within_key_variance(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(column, pct) of duplicated keys within which the column varies."""
    return duplicates.conflicts(df, keys, columns)
