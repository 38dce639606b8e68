"""From labelled checkpoints to modelling tables: merge, masks, splits, weights, imputation, feature selection."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import columns as C
from termweave.functions import constants as K

LOGGER = logging.getLogger(__name__)


def merge_labelled(checkpoint: DataFrame, selected: DataFrame, target: DataFrame | None = None, student: Sequence[str] = ("student_id",)) -> DataFrame:
    """Checkpoint rows of selected students, with their target if there is one."""
    out = checkpoint.join(selected.select(*student).distinct(), list(student), "left_semi")
    return out.join(target, list(student)) if target is not None else out


def mask_leakage(df: DataFrame, credits: str = "cumsum_num_credits_earned", check: int = K.CREDIT_CHECK, year: str = "year_of_enrollment_at_cohort_inst", terms: str = "cumnum_terms_enrolled", drop: Sequence[str] = ()) -> DataFrame:
    """df with values of the time after the checkpoint as null: courses within credits not yet earned, certificates of this
    year or later, and columns of later years or terms; then without the columns to drop and the year."""
    made = {}
    for c in df.columns:
        if f"in_{check}_creds" in c and credits in df.columns:
            made[c] = F.when(~C.truthy(F.col(credits) < check), F.col(f"`{c}`"))
        elif re.match(r"first_year_to_certificate|years_to_latest_certificate", c):
            made[c] = F.when(~C.truthy(F.col(c) >= F.col(year)), F.col(c))
        elif (m := re.search(r"_year_(\d)$", c)) and year in df.columns:
            made[c] = F.when(~C.truthy(F.col(year) <= int(m[1])), F.col(c))
        elif (m := re.search(r"_term_(\d)$", c)) and terms in df.columns:
            made[c] = F.when(~C.truthy(F.col(terms) < int(m[1])), F.col(c))
    return (df.withColumns(made) if made else df).drop(*(c for c in [*drop, year] if c in df.columns))


def split(df: DataFrame, key: str = "student_id", stratify: str | None = "target", shares: Mapping[str, float] = K.SPLIT, seed: int = 0, to: str = "split") -> DataFrame:
    """df with its split: within each stratum, rows in the order of a seeded hash of the key take exact shares.

    Rows are ranked within 256 ranges of the hash; the sizes of ranges, a few hundred a stratum, say how many lie before."""
    strata = [stratify] if stratify else []
    hashed = df.withColumn("_hash", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))).withColumn("_range", F.substring("_hash", 1, 2))
    sizes = hashed.groupBy(*strata, "_range").agg(F.count("*").alias("_n"))
    up, whole = Window.partitionBy(*strata or [F.lit(1)]).orderBy("_range"), Window.partitionBy(*strata or [F.lit(1)])
    before = sizes.select(*(F.col(c).alias(f"_{c}") for c in strata), F.col("_range").alias("_of"), (F.sum("_n").over(up) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_size"))
    on = F.col("_range") == F.col("_of")
    for c in strata:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = hashed.withColumn("_place", F.row_number().over(Window.partitionBy(*strata, "_range").orderBy("_hash"))).join(F.broadcast(before), on)
    out, total = None, 0.0
    for name, share in shares.items():
        total += share
        hit = F.col("_before") + F.col("_place") <= F.round(F.col("_size") * F.lit(total))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return placed.withColumn(to, out.otherwise(list(shares)[-1])).drop("_hash", "_range", "_of", "_before", "_size", "_place", *(f"_{c}" for c in strata))


def hash_split(df: DataFrame, key: str = "student_id", shares: Mapping[str, float] = K.SPLIT, seed: int = 0, to: str = "split") -> DataFrame:
    """df with its split by the hash alone: shares hold on average, and no row moves. For tables too large to rank."""
    u = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    out, total = None, 0.0
    for name, share in shares.items():
        total += share
        out = F.when(u < total, name) if out is None else out.when(u < total, name)
    return df.withColumn(to, out.otherwise(list(shares)[-1]))


def sample_weights(df: DataFrame, target: str = "target", weights: Mapping | None = None, to: str = "sample_weight") -> DataFrame:
    """df with balanced weights n / (classes * class size), or those given. Class sizes are joined back, by broadcast if they are small."""
    if weights is not None:
        return df.withColumn(to, C.lookup(target, weights).cast("double"))
    sizes = df.groupBy(target).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    of = sizes.join(F.broadcast(total)).select(target, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias(to))
    return df.join(of, target)


def null_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, null_share), by one aggregate."""
    row = df.agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns))
    return row.unpivot([], list(columns), "feature", "null_share")


def incomplete_features(df: DataFrame, columns: Sequence[str], share: float = K.NULL_SHARE) -> list[str]:
    """Columns with at least that share of nulls; the share is capped."""
    share = min(share, K.NULL_SHARE)
    return [r.feature for r in null_shares(df, columns).where(F.col("null_share") >= share).collect()]


def low_variance_features(df: DataFrame, columns: Sequence[str], least: float = K.VARIANCE) -> list[str]:
    """Numeric columns of no more variance than that, and others with a single value."""
    kinds = dict(df.dtypes)
    numeric = [c for c in columns if kinds[c] not in ("string", "boolean")]
    made = [F.var_pop(c).alias(c) if c in numeric else F.countDistinct(c).cast("double").alias(c) for c in columns]
    row = df.agg(*made).first()
    return [c for c in columns if row[c] is None or row[c] <= (least if c in numeric else 1)]


def gram_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """X'X over rows without nulls in columns, by one aggregate; its size is the square of the number of features."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    value = lambda c: F.col(c).cast("double")
    row = df.dropna(subset=list(columns)).agg(*(F.sum(value(columns[i]) * value(columns[j])).alias(f"_{i}_{j}") for i, j in pairs)).first()
    out = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"_{i}_{j}"] or 0.0
    return out


def vifs(gram: np.ndarray) -> np.ndarray:
    """Uncentred variance inflation factors; infinite for columns that others give exactly."""
    out = np.full(len(gram), np.inf)
    for i in range(len(gram)):
        rest = [j for j in range(len(gram)) if j != i]
        if not rest:
            return np.ones(1)
        beta = np.linalg.lstsq(gram[np.ix_(rest, rest)], gram[rest, i], rcond=None)[0]
        left = gram[i, i] - gram[i, rest] @ beta
        if left > 1e-9 * max(gram[i, i], 1e-300):
            out[i] = gram[i, i] / left
    return out


def collinear_features(df: DataFrame, columns: Sequence[str], most: float = K.VIF, keep: Sequence[str] = ()) -> list[str]:
    """Columns to drop, one round after the other those of the largest factor (ties all), until none reaches the limit."""
    gram, left, dropped = gram_matrix(df, columns), list(range(len(columns))), []
    while len(left) > 1:
        found = vifs(gram[np.ix_(left, left)])
        may = [f if columns[i] not in keep else -1.0 for i, f in zip(left, found)]
        if max(may) < most:
            break
        worst = [i for i, f in zip(left, may) if f == max(may)]
        if len(worst) == len(left):
            worst = worst[1:]
        dropped += [columns[i] for i in worst]
        left = [i for i in left if i not in worst]
    return dropped


def imputation_values(df: DataFrame, numeric: Sequence[str], other: Sequence[str], skew: float = 0.5, accuracy: int | None = None) -> dict[str, object]:
    """Fill values, by one aggregate: mean or, where sample skewness is at least skew, median (exact, or with an accuracy); the
    smallest mode of others."""
    median = F.median if accuracy is None else lambda c: F.percentile_approx(c, 0.5, accuracy)
    made = [a for c in numeric for a in (F.avg(c).alias(f"{c}|mean"), median(c).alias(f"{c}|median"), F.skewness(c).alias(f"{c}|skew"), F.count(c).alias(f"{c}|n"))]
    row = df.agg(*made, *(F.mode(c, True).alias(c) for c in other)).first()
    out: dict[str, object] = {c: row[c] for c in other}
    for c in numeric:
        n, s = row[f"{c}|n"], row[f"{c}|skew"]
        corrected = 0.0 if s is None or n < 3 else s * (n * (n - 1)) ** 0.5 / (n - 2)
        out[c] = row[f"{c}|median"] if abs(corrected) >= skew else row[f"{c}|mean"]
    return out


def impute(df: DataFrame, values: Mapping[str, object], flags: bool = True) -> DataFrame:
    """df with nulls filled, and a *_missing_flag beside each column."""
    made = {f"{c}_missing_flag": F.col(c).isNull() for c in values} if flags else {}
    return df.withColumns(made | {c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items() if v is not None})


def newly_missing(train: DataFrame, now: DataFrame, columns: Sequence[str], share: float = 0.5, least: int = 3) -> list[str]:
    """Columns complete in training of which at least that share is null now; empty unless there are so many."""
    before = {r.feature: r.null_share for r in null_shares(train, columns).collect()}
    found = [r.feature for r in null_shares(now, columns).collect() if before[r.feature] == 0 and (r.null_share or 0) >= share]
    return found if len(found) >= least else []


@dataclass
class Imputer:
    """The state of an imputation: fitted on training rows, kept as JSON, applied to any later ones."""

    features: list[str] = field(default_factory=list)
    types: dict[str, str] = field(default_factory=dict)
    values: dict[str, object] = field(default_factory=dict)
    flagged: list[str] = field(default_factory=list)
    on_new_missing: str = "warn"
    least_columns: int = 3
    least_share: float = 0.5

    def fit(self, df: DataFrame, features: Sequence[str] | None = None) -> Imputer:
        """Fill values of every feature (constants where all are null), and which had nulls; two aggregates."""
        self.features = list(features or df.columns)
        self.types = {c: k for c, k in df.dtypes if c in self.features}
        numeric = [c for c in self.features if self.types[c] not in ("string", "boolean")]
        found = imputation_values(df, numeric, [c for c in self.features if c not in numeric])
        constant = lambda c: False if self.types[c] == "boolean" else "missing" if self.types[c] == "string" else 0 if self.types[c] in ("int", "bigint", "smallint", "tinyint") else 0.0
        self.values = {c: constant(c) if found[c] is None else found[c] for c in self.features}
        self.flagged = [r.feature for r in null_shares(df, self.features).where("null_share > 0").collect()]
        return self

    def new_missing(self, df: DataFrame) -> dict[str, float]:
        """Null shares of the features that had no nulls when fitted and have some now."""
        clean = [c for c in self.features if c not in self.flagged]
        return {r.feature: r.null_share for r in null_shares(df, clean).where("null_share > 0").collect()} if clean else {}

    def transform(self, df: DataFrame) -> DataFrame:
        """df with features filled in their own types, a *_missing_flag for each that had nulls when fitted, and its other columns.

        New nulls in columns that had none are reported; if so set, many columns of many nulls raise."""
        if not self.features:
            raise ValueError("fit the imputer first")
        if lost := sorted(set(self.features) - set(df.columns)):
            raise ValueError(f"missing features: {lost}")
        new = self.new_missing(df)
        if new:
            LOGGER.warning("nulls in columns that had none when fitted: %s", new)
        if self.on_new_missing == "error" and sum(s >= self.least_share for s in new.values()) >= self.least_columns:
            raise ValueError(f"nulls in columns that had none when fitted: {new}")
        whole = ("int", "bigint", "smallint", "tinyint")

        def filled(c: str) -> Column:
            x = F.coalesce(F.col(c).cast("double"), F.lit(float(self.values[c]))) if self.types[c] in whole else F.coalesce(F.col(c), F.lit(self.values[c]))
            return F.bround(x).cast(self.types[c]) if self.types[c] in whole else x.cast(self.types[c])

        others = [c for c in df.columns if c not in self.features]
        return df.select(*(filled(c).alias(c) for c in self.features), *(F.col(c).isNull().alias(f"{c}_missing_flag") for c in self.flagged), *others)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, default=str)

    @classmethod
    def from_json(cls, text: str) -> Imputer:
        return cls(**json.loads(text))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a seeded hash of the key: the same ones on every run."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
