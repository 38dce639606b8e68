"""Duplicate rows: told apart, dropped, or made distinct by a suffix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import columns as C


def _order(columns: Sequence[str], descending: bool = False) -> list[Column]:
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in columns]


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key in a total order; null is a key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(order, last)))).where("_n = 1").drop("_n")


def classify(df: DataFrame, keys: Sequence[str], material: Sequence[str]) -> DataFrame:
    """df with group_size and must_suffix: whether a material column differs within the key; null is a value."""
    of = Window.partitionBy(*keys)
    differs = F.lit(False)
    for c in material:
        text = F.coalesce(F.col(c).cast("string"), F.lit("\0"))
        differs = differs | (F.min(text).over(of) != F.max(text).over(of))
    return df.withColumns({"group_size": F.count("*").over(of), "must_suffix": differs})


def suffix_after_first(df: DataFrame, keys: Sequence[str], c: str, order: Sequence[str]) -> DataFrame:
    """df with -1, -2 behind the identifier of a key's second, third row; the first, in descending order, stays."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(order, descending=True))) - 1
    return df.withColumn(c, F.when(n > 0, F.concat_ws("-", F.col(c), n.cast("string"))).otherwise(F.col(c)))


def suffix_all(df: DataFrame, keys: Sequence[str], c: str, order: Sequence[str]) -> DataFrame:
    """df with -1 to -n behind the identifiers of keys with several rows."""
    of = Window.partitionBy(*keys)
    n = F.row_number().over(of.orderBy(*_order(order)))
    return df.withColumn(c, F.when(F.count("*").over(of) > 1, F.concat_ws("-", F.col(c), n.cast("string"))).otherwise(F.col(c)))


def resolve_courses(df: DataFrame, keys: Sequence[str], material: Sequence[str], c: str, order: Sequence[str]) -> DataFrame:
    """Rows of keys whose material differs are told apart by a suffix; of others one stays."""
    found = classify(df, keys, material)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(order, descending=True))) - 1
    out = found.withColumn("_n", n).where(F.col("must_suffix") | (F.col("_n") == 0))
    return out.withColumn(c, F.when(F.col("must_suffix") & (F.col("_n") > 0), F.concat_ws("-", F.col(c), F.col("_n").cast("string"))).otherwise(F.col(c))).drop("_n", "group_size", "must_suffix")


def priority(c: str, tokens: Sequence[str]) -> Column:
    """Rank of a value among tokens: an equal one, else the longest that it contains, ties by place; unknown ones last."""
    text = F.lower(F.trim(c))
    out = F.when(F.lit(False), 0)
    for i, t in enumerate(tokens):
        out = out.when(text == t.lower(), i)
    for i, t in sorted(enumerate(tokens), key=lambda x: (-len(x[1]), x[0])):
        out = out.when(text.contains(t.lower()), i)
    return out.otherwise(len(tokens))


def by_priority(df: DataFrame, keys: Sequence[str], c: str, tokens: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """The row of the best token for each key."""
    over = Window.partitionBy(*keys).orderBy(priority(c, tokens), *_order(ties))
    return df.withColumn("_n", F.row_number().over(over)).where("_n = 1").drop("_n")


def resolve(df: DataFrame, policy: dict) -> DataFrame:
    """One grain policy: {'strategy': true_duplicate | first | last | priority | suffix | no_dedup | sequence, ...}."""
    kind = policy["strategy"]
    keys, order = policy.get("keys", df.columns), policy.get("order", policy.get("keys", df.columns))
    if kind == "true_duplicate":
        return df.distinct()
    if kind in ("first", "last"):
        return keep_one(df, keys, order, kind == "last")
    if kind == "priority":
        return by_priority(df, keys, policy["column"], policy["tokens"], order)
    if kind == "suffix":
        return suffix_all(df, keys, policy["column"], order)
    if kind == "sequence":
        for step in policy["steps"]:
            df = resolve(df, step)
        return df
    if kind == "no_dedup":
        return df
    raise ValueError(f"no such strategy: {kind}")


def by_key_groups(df: DataFrame, keys: Sequence[str], hook, many: bool = False) -> DataFrame:
    """df with a function pandas frame -> pandas frame of the same columns applied to each key's rows: the slow, general way.

    With many, the function takes the rows of many keys in one call, each key whole, and its cost is one of rows, not of
    calls: the index numbers the keys (rows with one number are those of one key, null is a key), and columns have Arrow
    types, in which whole numbers beside nulls stay exact.
    """
    if not many:
        return df.groupBy(*keys).applyInPandas(hook, df.schema)
    names = list(df.columns)

    def run(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        def hooked(parts):
            table = pa.Table.from_batches(parts)
            rows = table.select(names).to_pandas(types_mapper=pd.ArrowDtype, ignore_metadata=True)
            rows.index = np.cumsum(table.column("_first").to_numpy())
            return pa.Table.from_pandas(hook(rows), table.select(names).schema, preserve_index=False).to_batches()

        kept = []  # of the last key begun: the next batch may go on with it
        for batch in batches:
            starts = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
            if not len(starts):
                kept.append(batch)
                continue
            if kept or starts[-1]:
                yield from hooked([*kept, batch.slice(0, starts[-1])])
            kept = [batch.slice(starts[-1])]
        if kept:
            yield from hooked(kept)

    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)) == 1  # leaves each key's rows side by side
    return df.withColumn("_first", first).mapInArrow(run, df.schema)


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def conflicts(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(column, pct): share of duplicated keys within which the column differs; null is a value. Two grouped aggregates."""
    distinct = [F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(c) for c in columns]
    groups = df.groupBy(*keys).agg(F.count("*").alias("_n"), *distinct).where("_n > 1")
    row = groups.agg(*(F.round(100 * F.avg((F.col(c) > 1).cast("double")), 4).alias(c) for c in columns))
    return row.unpivot([], list(columns), "column", "pct")


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(n, num_groups): histogram of the sizes of duplicated keys."""
    return duplicate_groups(df, keys).groupBy("n").agg(F.count("*").alias("num_groups"))


def impact(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows before and after one row a key, and the difference."""
    sums = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows_before"), F.count("*").alias("rows_after"))
    return sums.withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after"))


def course_duplicates_truth(c: str) -> Column:
    """Whether an identifier carries a suffix."""
    return C.truthy(F.col(c).rlike(r"-\d+$"))
