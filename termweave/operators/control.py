"""Control tables: fingerprints, upserts, queues, runs and their dashboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mapping import latest_per_key


def fingerprint(df: DataFrame, columns: Sequence[str], to: str = "file_fingerprint") -> DataFrame:
    return df.withColumn(to, F.sha2(F.concat_ws("||", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256))


def insert_new(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """table with the rows whose key it lacks; of several with one key, one goes in."""
    new = rows.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti")
    return table.unionByName(new, allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], keep_known: bool = True) -> DataFrame:
    """table with its rows updated and new ones added, by one full join; a null does not replace a known value if so asked."""
    rest = [c for c in table.columns if c not in keys]
    new = rows.select(*keys, *(F.col(c).alias(f"_{c}") for c in rest if c in rows.columns), F.lit(True).alias("_new"))
    joined = table.join(new, list(keys), "full_outer")
    made = {c: F.coalesce(f"_{c}", c) if keep_known else F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in rest if c in rows.columns}
    return joined.withColumns(made).select(*table.columns)


def to_queue(manifest: DataFrame, queue: DataFrame, key: str = "file_fingerprint", status: str = "NEW") -> DataFrame:
    """Manifest rows of a status that the queue lacks."""
    return manifest.where(F.col("status") == status).join(queue.select(key), key, "left_anti")


def expand(files: DataFrame, institutions: DataFrame, plan: DataFrame, keys: Sequence[str] = ("file_fingerprint", "institution_id")) -> DataFrame:
    """(file, institution) pairs that the plan lacks."""
    return files.join(institutions, keys[0]).select(*keys).distinct().join(plan.select(*keys), list(keys), "left_anti")


def institutions_per_file(df: DataFrame, file: str = "file_fingerprint", institution: str = "institution_id") -> DataFrame:
    clean = F.regexp_replace(F.trim(F.col(institution).cast("string")), r"\.0$", "")
    return df.groupBy(file).agg(F.countDistinct(clean).alias("n_institutions"), F.array_join(F.sort_array(F.collect_set(clean)), ",").alias("institutions"))


def latest_runs(runs: DataFrame, models: DataFrame, key: str = "run_id", order: str = "logged_ts") -> DataFrame:
    """Runs with the latest model row of each."""
    return runs.join(latest_per_key(models, [key], [order]), key, "left")


def stale(runs: DataFrame, now, hours: float, final: Sequence[str] = ("DONE", "FAILED")) -> DataFrame:
    """runs with status STALE for unfinished ones that have not changed for so long."""
    old = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("updated_at")) > hours * 3600
    return runs.withColumn("status", F.when(~F.col("status").isin(list(final)) & old, "STALE").otherwise(F.col("status")))


def created_on(runs: DataFrame, day, c: str = "created_at") -> DataFrame:
    return runs.where(F.to_date(c) == F.to_date(F.lit(day))).agg(F.count("*").alias("n"))


def institution_summary(runs: DataFrame, by: str = "institution_id", status: str = "status", seconds: str = "duration", at: str = "ts", good: str = "SUCCESS") -> DataFrame:
    """Runs, successes, rate, median duration and last time of each institution."""
    ok = F.sum((F.col(status) == good).cast("int")).cast("bigint")
    return runs.groupBy(by).agg(F.count("*").alias("n_runs"), ok.alias("n_success"), F.round(ok / F.count("*"), 6).alias("success_rate"), F.round(F.median(seconds), 6).alias("median_duration"), F.max(at).alias("last_ts"))


def day_over_day(df: DataFrame, at: str = "ts") -> DataFrame:
    """day, n, previous present day's n, and change."""
    days = df.groupBy(F.date_trunc("day", at).cast("date").alias("day")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.orderBy("day"))  # one row a day
    return days.withColumns({"n_before": before, "change": F.col("n") - before})


def counts_by(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))
