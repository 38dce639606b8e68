"""Explanation tables from contributions in long form: (row_id, feature, value, shap)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_long(features: DataFrame, shap: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, feature, value, shap) of two wide tables: one join, then both sides unpivoted at once, with no second join."""
    wide = features.select(key, *columns).join(shap.select(key, *(F.col(c).alias(f"_s_{c}") for c in columns)), key)
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"), F.col(f"_s_{c}").cast("double").alias("shap")) for c in columns))
    return wide.select(key, F.explode(cells).alias("_c")).select(key, "_c.*")


def group_contributions(long: DataFrame, key: str, groups: Mapping[str, str]) -> DataFrame:
    """long with features of one base summed; a base's value is that of its largest contribution."""
    base = F.coalesce(F.create_map(*(F.lit(x) for kv in groups.items() for x in kv))[F.col("feature")], F.col("feature")) if groups else F.col("feature")
    return long.groupBy(key, base.alias("feature")).agg(F.sum("shap").alias("shap"), F.max_by("value", F.struct(F.abs("shap"), "value")).alias("value"))


def missing_as(long: DataFrame, text: str = "Missing") -> DataFrame:
    return long.withColumn("value", F.coalesce("value", F.lit(text)))


def colour_hints(long: DataFrame) -> DataFrame:
    """long with hint: a numeric value's place between its feature's extremes, 0 to 1; null for others."""
    x, of = F.col("value").try_cast("double"), Window.partitionBy("feature")
    return long.withColumn("hint", F.try_divide(x - F.min(x).over(of), F.max(x).over(of) - F.min(x).over(of)))


def top_features(long: DataFrame, k: int) -> DataFrame:
    """rank, feature and mean absolute contribution of the k strongest ones."""
    means = long.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))
    ranked = means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs_shap"), "feature")))  # one row a feature
    return ranked.where(F.col("rank") <= k)


def rows_of_top_features(long: DataFrame, k: int) -> DataFrame:
    return long.join(F.broadcast(top_features(long, k)), "feature")


def top_per_row(long: DataFrame, key: str, k: int) -> DataFrame:
    """One row a key: feature_1, value_1, shap_1 and so on, by absolute contribution, ties by name."""
    cells = F.sort_array(F.collect_list(F.struct((-F.abs("shap")).alias("o"), "feature", "value", "shap")))
    rows = long.groupBy(key).agg(F.slice(cells, 1, k).alias("c"))
    return rows.select(key, *(F.get(F.col("c"), F.lit(i))[n].alias(f"{n}_{i + 1}") for i in range(k) for n in ("feature", "value", "shap")))


def display_names(df: DataFrame, table: DataFrame, feature: str = "feature") -> DataFrame:
    """df with the display name of a lookup table (pattern, name): an equal name, else the first pattern that matches whole."""
    exact = df.join(F.broadcast(table.select(F.col("pattern").alias(feature), F.col("name").alias("_exact"))), feature, "left")
    rules = table.agg(F.sort_array(F.collect_list(F.struct("pattern", "name"))).alias("_rules"))  # one row
    hit = F.filter("_rules", lambda r: F.rlike(F.col(feature), F.concat(F.lit("^(?:"), r["pattern"], F.lit(")$"))))
    return exact.join(F.broadcast(rules)).withColumn("display_name", F.coalesce("_exact", F.get(hit, F.lit(0))["name"], F.col(feature))).drop("_exact", "_rules")


def box_stats(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """feature, min, q1, median, q3, max, count, missing: percentiles (exact, or with an accuracy) of all columns in one grouped aggregate."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], list(columns), "feature", "x")
    at = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    p = F.percentile("x", at) if accuracy is None else F.percentile_approx("x", at, accuracy)
    out = long.groupBy("feature").agg(F.min("x").alias("min"), p.alias("p"), F.max("x").alias("max"), F.count("x").alias("count"), F.sum(F.col("x").isNull().cast("int")).cast("bigint").alias("missing"))
    return out.select("feature", "min", F.col("p")[0].alias("q1"), F.col("p")[1].alias("median"), F.col("p")[2].alias("q3"), "max", "count", "missing")


def score_histogram(df: DataFrame, score: str = "score", bins: int = 25) -> DataFrame:
    """bin, low, high, num and pct over [0, 1]; the last bin is closed, empty bins are listed."""
    place = F.least(F.floor(F.round(F.col(score) * bins, 9)).cast("int"), F.lit(bins - 1))
    counts = df.where(F.col(score).between(0, 1)).groupBy(place.alias("bin")).agg(F.count("*").alias("num"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(F.broadcast(counts), "bin", "left").withColumn("num", F.coalesce("num", F.lit(0)).cast("bigint"))
    total = F.sum("num").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return out.select("bin", F.round(F.col("bin") / bins, 4).alias("low"), F.round((F.col("bin") + 1) / bins, 4).alias("high"), "num", F.round(F.try_divide(100.0 * F.col("num"), total), 2).alias("pct"))
