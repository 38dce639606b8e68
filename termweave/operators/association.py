"""How features go with a binary target, as aggregates."""

from __future__ import annotations

import math
from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions.names import feature_family

from . import ranks


def _long(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, x, y) of rows where both are known: all features in one pass."""
    return df.select(F.col(target).cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in features)).unpivot(["y"], list(features), "feature", "x").where("x IS NOT NULL AND y IS NOT NULL")


def _ranks(cells: DataFrame, c: str, to: str) -> DataFrame:
    """(feature, c, to): average ranks of c over cells(feature, x, y, n)."""
    counts = cells.groupBy("feature", c).agg(F.sum("n").alias("n"))
    return ranks.running(counts, ["feature"], c, {"n": "_upto"}).select("feature", c, (F.col("_upto") - (F.col("n") - 1) / 2).alias(to))


def spearman(df: DataFrame, features: Sequence[str], target: str = "target") -> DataFrame:
    """(feature, spearman) over rows where both are known. Counted per distinct pair first; ranks are joined to those."""
    cells = _long(df, features, target).groupBy("feature", "x", "y").agg(F.count("*").alias("n"))
    ranked = cells.join(_ranks(cells, "x", "rx"), ["feature", "x"]).join(_ranks(cells, "y", "ry"), ["feature", "y"])
    mean = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    means = ranked.groupBy("feature").agg(mean("rx").alias("mx"), mean("ry").alias("my"))
    dx, dy = F.col("rx") - F.col("mx"), F.col("ry") - F.col("my")
    sums = ranked.join(F.broadcast(means), "feature").groupBy("feature").agg(F.sum(F.col("n") * dx * dy).alias("xy"), F.sum(F.col("n") * dx * dx).alias("xx"), F.sum(F.col("n") * dy * dy).alias("yy"))
    return sums.select("feature", F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy")).alias("spearman"))


def auc(df: DataFrame, features: Sequence[str], target: str = "target", least: int = 10) -> DataFrame:
    """(feature, auc) of each feature alone, turned so that it is at least one half; null for few rows or constants."""
    cells = _long(df, features, target).groupBy("feature", "x").agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    summed = ranks.running(cells, ["feature"], "x", {"n": "_upto"})
    rank = F.col("_upto") - (F.col("n") - 1) / 2
    sums = summed.groupBy("feature").agg(F.sum(F.col("ones") * rank).alias("r"), F.sum("ones").alias("p"), (F.sum("n") - F.sum("ones")).alias("q"), F.count("*").alias("v"))
    area = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q"))
    return sums.select("feature", F.when((F.col("p") + F.col("q") >= least) & (F.col("v") > 1), F.greatest(area, 1 - area)).alias("auc"))


def _family_choice(name: str, corrs: Mapping[str, float], aucs: Mapping[str, float], mis: Mapping[str, float]) -> tuple:
    """What decides which feature speaks for its family: larger is better."""
    kind = next((k for k, start in enumerate(("frac_", "num_")) if name.startswith(start)), 3 if name.startswith("cum") else 2)
    return aucs.get(name, 0.5), mis.get(name, 0.0), abs(corrs.get(name, 0.0)), -kind


def suggest_forced(corrs: Mapping[str, float], aucs: Mapping[str, float], mis: Mapping[str, float] | None = None, assocs: Mapping[str, float] | None = None, exclude: Collection[str] = (), n_each: int = 3, skip_cumulative: bool = False) -> list[str]:
    """Features to keep in any model: of each family the best by AUC, then the n_each strongest that rise with the target
    (not below half way from chance to the best of them) and the n_each strongest that fall. Takes the collected
    figures of spearman(), auc() and the like, one a feature; equal figures are suggested once."""
    mis, assocs, best = mis or {}, assocs or {}, {}
    for name in sorted({*corrs, *aucs, *mis} - set(exclude)):
        family = feature_family(name)
        if not (skip_cumulative and name.startswith("cum")) and (family not in best or _family_choice(name, corrs, aucs, mis) > _family_choice(best[family], corrs, aucs, mis)):
            best[family] = name
    strength = {n: aucs.get(n, 0.5) + 0.01 * mis.get(n, 0.0) + 0.001 * abs(corrs.get(n, 0.0)) + 0.001 * abs(assocs.get(n, 0.0)) for n in best.values()}

    def strongest(names: list[str], floor: float = -math.inf) -> list[str]:
        ordered = sorted((n for n in names if strength[n] >= floor), key=lambda n: -strength[n])
        return list({strength[n]: n for n in reversed(ordered)}.values())[::-1][:n_each]

    rising, falling = ([n for n in strength if sign * corrs.get(n, 0.0) > 0] for sign in (1, -1))
    top = max((strength[n] for n in rising), default=0.5)
    return list(dict.fromkeys(strongest(rising, 0.5 + 0.5 * (top - 0.5)) + strongest(falling)))


def metric_table(named: Mapping[str, Mapping[str, float]], k: int = 10) -> str:
    """The k largest figures of each measure side by side, one line a feature, for logs."""
    tops = {m: dict(sorted(of.items(), key=lambda x: -x[1])[:k]) for m, of in named.items() if of}
    if not tops:
        return "(no metrics)"
    names = list(dict.fromkeys(n for of in tops.values() for n in of))
    width = max(map(len, names))
    rows = [" " * width + "".join(f" {m:>12}" for m in tops)]
    return "\n".join(rows + [n.ljust(width) + "".join(f" {of[n]:12.4f}" if n in of else " " * 13 for of in tops.values()) for n in names])


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cells of a and b with their row and column sums; categories are few."""
    cells = df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().groupBy("a", "b").agg(F.count("*").alias("n"))
    return cells.withColumns({"na": F.sum("n").over(Window.partitionBy("a")), "nb": F.sum("n").over(Window.partitionBy("b"))})


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: cramers_v. Empty cells enter through sum(n^2 / (na nb)) - 1."""
    cells = contingency(df, a, b)
    sums = cells.agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("s"), F.countDistinct("a").alias("ka"), F.countDistinct("b").alias("kb"))
    return sums.select(F.sqrt(F.greatest(F.try_divide(F.col("s") - 1, F.least("ka", "kb") - 1), F.lit(0.0))).alias("cramers_v"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual_information of two category columns, in nats."""
    cells = contingency(df, a, b)
    total = df.select(a, b).dropna().agg(F.count("*").alias("all"))
    p = F.col("n") / F.col("all")
    return cells.join(F.broadcast(total)).agg(F.sum(p * F.log(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))).alias("mutual_information"))


def correlation_ratio(df: DataFrame, category: str, value: str) -> DataFrame:
    """One row: correlation_ratio (eta) of a numeric column over categories."""
    groups = df.select(category, F.col(value).cast("double").alias("v")).dropna().groupBy(category).agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    sums = groups.agg(F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum(F.col("n") * F.col("s")).alias("within"))
    between = F.col("nmm") - F.col("nm") * F.col("nm") / F.col("n")
    return sums.select(F.sqrt(F.greatest(F.try_divide(between, between + F.col("within")), F.lit(0.0))).alias("correlation_ratio"))
