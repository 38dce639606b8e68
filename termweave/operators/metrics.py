"""Tables that judge a classifier: metrics, ROC, calibration, bias, drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import constants as K

from . import ranks


def classification_metrics(df: DataFrame, by: Sequence[str] = (), actual: str = "actual", predicted: str = "predicted", score: str = "score", weight: str | None = None) -> DataFrame:
    """Weighted counts, prevalences, accuracy, precision, recall, F1 and log-loss, by group."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    yes, said = F.col(actual).cast("int") == 1, F.col(predicted).cast("int") == 1
    add = lambda hit: F.sum(F.when(hit, w).otherwise(0.0))
    p = F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = F.sum(w * F.when(yes, -F.log(p)).otherwise(-F.log(1 - p)))
    sums = df.groupBy(*by).agg(F.count("*").alias("num_samples"), F.sum(w).alias("_w"), add(yes & said).alias("tp"), add(~yes & said).alias("fp"), add(yes & ~said).alias("fn"), add(~yes & ~said).alias("tn"), loss.alias("_loss"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return sums.select(
        *by, "num_samples", "tp", "fp", "fn", "tn",
        rate(tp + fn, F.col("_w")).alias("true_positive_prevalence"), rate(tp + fp, F.col("_w")).alias("pred_positive_prevalence"),
        rate(tp + tn, F.col("_w")).alias("accuracy"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"),
        rate(2 * tp, 2 * tp + fp + fn).alias("f1_score"), rate(F.col("_loss"), F.col("_w")).alias("log_loss"),
    )


def roc_curve(df: DataFrame, actual: str = "actual", score: str = "score", places: int = 4) -> DataFrame:
    """Thresholds (scores rounded to that many places, descending) with counts and rounded rates, 0 where a class is absent.

    One task sums them: at most 10,001 thresholds of scores from 0 to 1 with 4 places."""
    y = F.col(actual).cast("int")
    steps = df.groupBy(F.round(score, places).alias("threshold")).agg(F.sum(y).cast("bigint").alias("p"), F.sum(1 - y).cast("bigint").alias("n"))
    down, whole = Window.orderBy(F.desc("threshold")), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = steps.withColumns({"true_positive": F.sum("p").over(down), "false_positives": F.sum("n").over(down), "_p": F.sum("p").over(whole), "_n": F.sum("n").over(whole)})
    rate = lambda a, b: F.coalesce(F.round(F.try_divide(a, b), places), F.lit(0.0))
    return sums.select(
        "threshold", rate("true_positive", "_p").alias("true_positive_rate"), rate("false_positives", "_n").alias("false_positive_rate"),
        "true_positive", "false_positives", (F.col("_n") - F.col("false_positives")).alias("true_negatives"), (F.col("_p") - F.col("true_positive")).alias("false_negatives"),
    )


def calibration_bins(df: DataFrame, bins: int = 10, actual: str = "actual", score: str = "score", accuracy: int | None = None) -> DataFrame:
    """bin, num, mean_score and rate over quantile bins with exact edges, or with an accuracy; equal edges merge."""
    at = F.array(*(F.lit(i / bins) for i in range(bins + 1)))
    edges = F.percentile(score, at) if accuracy is None else F.percentile_approx(score, at, accuracy)
    edge = df.agg(F.array_distinct(edges).alias("_edges"))
    place = F.least(F.size(F.filter("_edges", lambda e: e <= F.col(score))) - 1, F.size("_edges") - 2)
    placed = df.join(F.broadcast(edge)).withColumn("bin", F.greatest(place, F.lit(0)))
    return placed.groupBy("bin").agg(F.count("*").alias("num"), F.avg(score).alias("mean_score"), F.avg(F.col(actual).cast("double")).alias("rate"))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, by a rational approximation of the error function (error below 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def group_bias(df: DataFrame, group: str, by: Sequence[str] = ("split",), actual: str = "actual", predicted: str = "predicted", z: float = 1.96) -> DataFrame:
    """False negative rate of each known subgroup with its confidence interval; positives enter as n + log(1 + n), so that small subgroups count less."""
    yes, said = F.col(actual).cast("int") == 1, F.col(predicted).cast("int") == 1
    known = df.where(F.col(group).isNotNull())
    sums = known.groupBy(*by, F.col(group).cast("string").alias("subgroup")).agg(F.count("*").alias("size"), F.count_if(yes).alias("positives"), F.count_if(yes & ~said).alias("fn"))
    scaled = F.col("positives") + F.log1p("positives")
    out = sums.withColumn("fnr", F.coalesce(F.try_divide(F.col("fn"), scaled), F.lit(0.0)))
    margin = F.coalesce(z * F.sqrt(F.try_divide(F.col("fnr") * (1 - F.col("fnr")), scaled)), F.lit(0.0))
    return out.withColumns({"group": F.lit(group), "ci_low": F.greatest(F.col("fnr") - margin, F.lit(0.0)), "ci_high": F.least(F.col("fnr") + margin, F.lit(1.0))})


def flag_bias(groups: DataFrame, by: Sequence[str] = ("split",), levels: Sequence[tuple[str, float, float, float]] = K.BIAS_LEVELS, positive_share: float = K.POSITIVE_SHARE) -> DataFrame:
    """Pairs of subgroups of one attribute with positive rates, the higher first: difference, test, reason and flag. Attributes have few subgroups."""
    keys = [*by, "group"]
    least = groups.groupBy(*keys).agg(F.least(F.lit(K.POSITIVE_ROWS), F.floor(positive_share * F.sum("positives"))).alias("_least"))
    a, b = (groups.select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in ("subgroup", "size", "positives", "fnr", "ci_low", "ci_high"))) for s in ("a", "b"))
    first = (F.col("fnr_a") > F.col("fnr_b")) | (F.col("fnr_a") == F.col("fnr_b")) & (F.col("subgroup_a") < F.col("subgroup_b"))
    pairs = a.join(b, keys).where((F.col("fnr_b") > 0) & first).join(least, keys)
    error = F.sqrt(sum(F.col(f"fnr_{s}") * (1 - F.col(f"fnr_{s}")) / F.col(f"size_{s}") for s in ("a", "b")))
    difference, enough = F.col("fnr_a") - F.col("fnr_b"), (F.col("size_a") > K.Z_TEST_ROWS) & (F.col("size_b") > K.Z_TEST_ROWS)
    out = pairs.withColumns({"difference": difference, "overlap": (F.col("ci_low_a") <= F.col("ci_high_b")) & (F.col("ci_low_b") <= F.col("ci_high_a")), "p_value": F.when(enough, 2 * (1 - normal_cdf(F.abs(F.try_divide(difference, error)))))})
    few = F.col("p_value").isNull() | (F.col("positives_a") < F.col("_least")) | (F.col("positives_b") < F.col("_least"))
    lowest, loosest = min(x[1] for x in levels), max(x[2] for x in levels)
    none = (F.col("difference") < lowest) | (F.col("p_value") > loosest)
    flag, reason = F.when(few, K.FEW_DATA).when(none, K.NO_BIAS), F.when(few, "insufficient samples for statistical test").when(none, "no significant difference")
    for name, least_gap, p, _ in levels:
        flag = flag.when((F.col("difference") >= least_gap) & (F.col("p_value") <= p), name)
    reason = reason.when(F.col("overlap"), "overlapping confidence intervals").otherwise("non-overlapping confidence intervals")
    said = F.when(F.col("p_value") < 0.001, "less than 0.001").otherwise(F.concat(F.lit("of "), F.format_string("%.3f", F.col("p_value"))))
    return out.withColumns({"flag": flag, "type": F.when(F.col("p_value").isNull(), reason).otherwise(F.concat(reason, F.lit(" with a p-value "), said)), "difference": F.round("difference", 4)}).drop("_least")


def bias_scores(flags: DataFrame, by: Sequence[str] = ("split",), levels: Sequence[tuple[str, float, float, float]] = K.BIAS_LEVELS) -> DataFrame:
    """By split: sum of weighted differences, its mean over valid comparisons, the largest difference, numbers of flags and of valid comparisons."""
    weight = F.when(F.lit(False), 0.0)
    for name, _, _, w in levels:
        weight = weight.when(F.col("flag") == name, w)
    x = flags.withColumn("_w", weight)
    score, valid = F.coalesce(F.round(F.round(F.sum(F.col("_w") * F.col("difference")), 8), 4), F.lit(0.0)), F.count_if(F.col("flag") != K.FEW_DATA)
    return x.groupBy(*by).agg(score.alias("bias_score_sum"), F.coalesce(F.round(F.round(F.try_divide(score, valid), 8), 4), F.lit(0.0)).alias("bias_score_mean"), F.coalesce(F.round(F.max(F.when(F.col("_w").isNotNull(), F.col("difference"))), 4), F.lit(0.0)).alias("bias_score_max"), F.count("_w").alias("num_bias_flags"), valid.alias("num_valid_comparisons"))


def kolmogorov_tail(d: Column, n: Column, m: Column, terms: int = 20) -> Column:
    """Probability of a two-sample statistic of at least d, by the limit distribution with a correction for finite samples."""
    root = F.sqrt(n * m / (n + m))
    x = (root + 0.12 + 0.11 / root) * d
    tail = sum((2 if k % 2 else -2) * F.exp(-2 * k * k * x * x) for k in range(1, terms + 1))
    return F.when(x < 0.3, 1.0).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))


def ks_drift(before: DataFrame, after: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """Per feature both sides' mean, median (exact, or with an accuracy), deviation and null share, their changes, ks_stat and p_value.

    Counts per distinct value, then running sums over ranges of values; the statistic does not depend on scale."""
    long = lambda df, w: df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], list(columns), "feature", "x").withColumn("side", F.lit(w))
    both = long(before, 0).unionAll(long(after, 1))
    known = both.where("x IS NOT NULL AND NOT isnan(x)").groupBy("feature", "x").agg(F.sum(1 - F.col("side")).alias("a"), F.sum("side").alias("b"))
    summed = ranks.running(known, ["feature"], "x", {"a": "upto_a", "b": "upto_b"}, {"a": "all_a", "b": "all_b"})
    gap = F.abs(F.try_divide("upto_a", F.col("all_a").cast("double")) - F.try_divide("upto_b", F.col("all_b").cast("double")))
    ks = summed.withColumn("gap", gap).groupBy("feature").agg(F.max("gap").alias("ks_stat"), F.max("all_a").alias("_a"), F.max("all_b").alias("_b"))
    stats = []
    for side, name in ((0, "train"), (1, "infer")):
        here = F.col("side") == side
        x = F.when(here, F.col("x"))
        median = F.median(x) if accuracy is None else F.percentile_approx(x, 0.5, accuracy)
        stats += [F.avg(x).alias(f"{name}_mean"), median.alias(f"{name}_median"), F.stddev_samp(x).alias(f"{name}_std"), F.avg(F.when(here, F.col("x").isNull().cast("int"))).alias(f"{name}_null_pct")]
    out = both.groupBy("feature").agg(*stats).join(ks, "feature", "left")
    out = out.withColumns({f"{s}_delta": F.col(f"infer_{s}") - F.col(f"train_{s}") for s in ("mean", "median")} | {"p_value": kolmogorov_tail(F.col("ks_stat"), F.col("_a"), F.col("_b"))})
    return out.select("feature", *(f"{x}_{s}" if x != "delta" else f"{s}_delta" for s in ("mean", "median") for x in ("train", "infer", "delta")), "train_std", "infer_std", "train_null_pct", "infer_null_pct", "ks_stat", "p_value").orderBy(F.desc("ks_stat"), "feature")


def balanced_score(df: DataFrame, metrics: dict[str, str], to: str = "balanced_score") -> DataFrame:
    """df with the mean of min-max scaled metrics; 'desc' ones are flipped, so the lowest score is best. For run tables."""
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(0.0)
    for c, direction in metrics.items():
        low, high = F.min(c).over(whole), F.max(c).over(whole)
        scaled = F.coalesce(F.try_divide(F.col(c) - low, high - low), F.lit(0.0))
        total = total + (1 - scaled if direction == "desc" else scaled)
    return df.withColumn(to, total / len(metrics))


def metric_directions(names: Sequence[str]) -> dict[str, str]:
    """asc where lower is better (losses and errors), else desc."""
    return {n: "asc" if any(w in n.lower() for w in ("loss", "error", "bias", "overfit")) else "desc" for n in names}


def top_runs(df: DataFrame, metrics: dict[str, str], k: int = 1) -> DataFrame:
    return balanced_score(df, metrics).orderBy("balanced_score", *df.columns[:1]).limit(k)


def overfit_score(train_loss: float, valid_loss: float, scale: float, cap: float = 1.0) -> float:
    """How much validation loss exceeds training loss, on a scale, between 0 and cap."""
    return 0.0 if scale <= 0 else max(0.0, min(cap, (valid_loss - train_loss) / scale))


def threshold_labels(df: DataFrame, score: str = "score", least: float = 0.5, to: str = "predicted") -> DataFrame:
    return df.withColumn(to, F.col(score) >= least)
