"""Histories of students: everything that looks at a student's earlier terms. One partitioning by student serves all."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import columns as C
from termweave.functions import constants as K

#: Running aggregates of each column.
EXPANDING = {
    "term_id": ("count",),
    "term_in_peak_covid": ("sum",),
    "term_is_core": ("sum",),
    "term_is_noncore": ("sum",),
    "term_is_while_student_enrolled_at_other_inst": ("sum",),
    "term_is_pre_cohort": ("sum",),
    "course_level_mean": ("mean", "min", "std"),
    "course_grade_numeric_mean": ("mean", "min", "std"),
    "num_courses": ("sum", "mean", "min"),
    "num_credits_attempted": ("sum", "mean", "min"),
    "num_credits_earned": ("sum", "mean", "min"),
    "student_pass_rate_above_sections_avg": ("sum",),
    "student_completion_rate_above_sections_avg": ("sum",),
}
RENAMED = {"cumcount_term_id": "cumnum_terms_enrolled", "cumsum_term_is_core": "cumnum_core_terms_enrolled", "cumsum_term_is_noncore": "cumnum_noncore_terms_enrolled"}
_AGGREGATES = {"count": F.count, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}


def _number(df: DataFrame, c: str) -> Column:
    return F.col(f"`{c}`").cast("int") if dict(df.dtypes)[c] == "boolean" else F.col(f"`{c}`")


def expanding_features(df: DataFrame, student: Sequence[str] = ("student_id",), order: Sequence[str] = ("academic_year", "term_ordinal"), credits: int = K.CREDIT_CHECK) -> DataFrame:
    """df with running aggregates, cumfrac_* of the course counts, and flags of courses taken within so many credits.

    The last look at all of a student's terms, as the leakage masks of model preparation expect."""
    so_far = Window.partitionBy(*student).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made: dict[str, Column] = {}
    for c, functions in EXPANDING.items():
        if c in df.columns:
            for f in functions:
                name = f"cum{f}_{c}"
                made[RENAMED.get(name, name)] = _AGGREGATES[f](F.col(c) if f == "count" else _number(df, c)).over(so_far)
    for c in df.columns:
        if c.startswith("num_courses_") and "num_courses" in df.columns:
            made[f"cumfrac_{c}"] = C.ratio(F.sum(f"`{c}`").over(so_far), F.sum("num_courses").over(so_far))
    took = [c for c in df.columns if c.startswith("took_")]
    made |= {f"cummax_{c}": F.max(_number(df, c)).over(so_far) for c in took}
    out = df.withColumns(made)
    if took and "cumsum_num_credits_earned" in out.columns:
        within = C.truthy(F.col("cumsum_num_credits_earned") <= credits)
        whole = Window.partitionBy(*student)
        out = out.withColumns({f"cummax_in_{credits}_creds_{c}": F.max((F.col(f"`cummax_{c}`") >= 1) & within).over(whole) for c in took})
    return out


#: Lists of a student-term and the columns of course rows that they list.
LISTED = {"course_ids": "course_id", "course_subjects": "course_cip", "course_subject_areas": "course_subject_area"}


def first_occurrences(courses: DataFrame, student: Sequence[str] = ("student_id",), order: Sequence[str] = ("academic_year", "term_ordinal")) -> DataFrame:
    """Course rows with _new_{list}: 1 on the row that brings a value to the student for the first time, and _all_{list}: 1 on
    rows that count as an element of their term's list (a course id counts once a term). Summed by term, they give
    unique_and_repeated() its counts without lists, joins or another pass over the courses."""
    made = {}
    for listed, c in LISTED.items():
        if c in courses.columns:
            value = C.catalog_id(c) if listed == "course_ids" else F.col(c)
            over = Window.partitionBy(*student, value).orderBy(*order)
            term = F.struct(*order)
            made[f"_new_{listed}"] = (F.row_number().over(over) == 1).cast("int")
            made[f"_all_{listed}"] = (~F.lag(term).over(over).eqNullSafe(term)).cast("int") if listed == "course_ids" else F.lit(1)
    return courses.withColumns(made)


def _counted(df: DataFrame, columns: Sequence[str], student: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with _new_ and _all_ counts of its lists: elements of all lists are exploded together and flagged by one window."""
    numbered = df.withColumn("_term", F.row_number().over(Window.partitionBy(*student).orderBy(*order)))
    element = lambda c, x: F.struct(F.lit(c).alias("of"), x.cast("string").alias("x"))
    tagged = [F.transform(C.distinct_catalog_ids(c) if c == "course_ids" else F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)), functools.partial(element, c)) for c in columns]
    elements = numbered.select(*student, "_term", F.explode(F.concat(*tagged)).alias("_e"))
    flagged = elements.withColumn("_new", (F.row_number().over(Window.partitionBy(*student, "_e").orderBy("_term")) == 1).cast("int"))
    aggregates = [a for c in columns for a in (F.sum(F.when(F.col("_e.of") == c, F.col("_new"))).alias(f"_new_{c}"), F.count_if(F.col("_e.of") == c).alias(f"_all_{c}"))]
    return numbered.join(flagged.groupBy(*student, "_term").agg(*aggregates), [*student, "_term"], "left").drop("_term")


def unique_and_repeated(df: DataFrame, columns: Sequence[str] = tuple(LISTED), student: Sequence[str] = ("student_id",), order: Sequence[str] = ("academic_year", "term_ordinal")) -> DataFrame:
    """df with the running number of distinct and of repeated list elements; null counts as one element.

    Running sums of new and of all elements a term: from first_occurrences() if their sums are there, else from the lists.
    No list of a whole history is ever built."""
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    if any(f"_new_{c}" not in df.columns for c in columns):
        df = _counted(df, columns, student, order)
    so_far = Window.partitionBy(*student).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = {}
    for c in columns:
        new, every = (F.coalesce(F.sum(f"_{k}_{c}").over(so_far), F.lit(0)) for k in ("new", "all"))
        made |= {f"cumnum_unique_{c}": new, f"cumnum_repeated_{c}": every - new}
    return df.withColumns(made).drop(*(f"_{k}_{c}" for c in columns for k in ("new", "all")))


def enrolled_fractions(df: DataFrame, student: Sequence[str] = ("student_id",)) -> DataFrame:
    """df with the share of terms since the first one that the student was enrolled in: all, core, non-core."""
    whole, made = Window.partitionBy(*student), {}
    for kind, rank in (("", "term_rank"), ("core_", "term_rank_core"), ("noncore_", "term_rank_noncore")):
        made[f"min_student_{rank}"] = F.min(rank).over(whole)
        made[f"cumfrac_{kind}terms_enrolled"] = C.ratio(f"cumnum_{kind}terms_enrolled", F.col(rank) - F.min(rank).over(whole) + 1).cast("float")
    return df.withColumns(made)


def term_differences(df: DataFrame, columns: Sequence[str] = K.TERM_DIFF_COLUMNS, student: Sequence[str] = ("student_id",), order: Sequence[str] = ("academic_year", "term_ordinal"), number: str = "cumnum_terms_enrolled", most: int = 4) -> DataFrame:
    """df with differences to the previous term, and those of the student's terms 2 to most on every row."""
    columns = [c for c in columns if c in df.columns]
    by_order, whole = Window.partitionBy(*student).orderBy(*order), Window.partitionBy(*student)
    out = df.withColumns({f"{c}_diff_prev_term": F.col(c) - F.lag(c).over(by_order) for c in columns})
    return out.withColumns({f"{c}_diff_term_{k - 1}_to_term_{k}": F.max(F.when(F.col(number) == k, F.col(f"{c}_diff_prev_term"))).over(whole) for c in columns for k in range(2, most + 1)})


def cumulative_features(df: DataFrame, student: Sequence[str] = ("student_id",), order: Sequence[str] = ("academic_year", "term_ordinal")) -> DataFrame:
    """All of the above."""
    out = unique_and_repeated(df, student=student, order=order)
    out = expanding_features(out, student, order)
    return term_differences(enrolled_fractions(out, student), student=student, order=order)


# --- histories of schools with calendars of their own -----------------------------------------------------------------


def history(df: DataFrame, student: Sequence[str], order: Sequence[str], sums: Sequence[str] = (), means: Sequence[str] = (), lows: Sequence[str] = (), highs: Sequence[str] = ()) -> DataFrame:
    """df with term_n (from 1), total_*_to_date, avg_*_to_date, min_*_to_date and max_*_to_date."""
    by = Window.partitionBy(*student).orderBy(*order)
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = {"term_n": F.row_number().over(by)}
    for prefix, f, some in (("total", F.sum, sums), ("avg", F.avg, means), ("min", F.min, lows), ("max", F.max, highs)):
        made |= {f"{prefix}_{c}_to_date": f(c).over(so_far) for c in some}
    return df.withColumns(made)


def running_list(df: DataFrame, c: str, student: Sequence[str], order: Sequence[str], to: str) -> DataFrame:
    so_far = Window.partitionBy(*student).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(to, F.collect_list(c).over(so_far))


def running_distinct(df: DataFrame, c: str, student: Sequence[str], order: Sequence[str], to: str) -> DataFrame:
    """df with the number of distinct values so far; null is a value."""
    new = F.row_number().over(Window.partitionBy(*student, c).orderBy(*order)) == 1
    so_far = Window.partitionBy(*student).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_new", new.cast("int")).withColumn(to, F.sum("_new").over(so_far)).drop("_new")


def share_unenrolled(df: DataFrame, student: Sequence[str], rank: str = "term_rank", to: str = "pct_terms_unenrolled") -> DataFrame:
    """df with the share of terms from the student's first to this one without enrolment; one row a student and term."""
    so_far = Window.partitionBy(*student).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    possible = F.col(rank) - F.min(rank).over(so_far) + 1
    return df.withColumn(to, F.try_divide((possible - F.count(rank).over(so_far)).cast("double"), possible))


def rolling_credits(df: DataFrame, student: Sequence[str], date: str, credits: str, days: int) -> DataFrame:
    """df with credits, rows and their ratio over the last days, (t - days, t]."""
    seconds = F.col(date).cast("timestamp").cast("long")
    over = Window.partitionBy(*student).orderBy("_s").rangeBetween(-days * 86400 + 1, 0)
    out = df.withColumn("_s", seconds).withColumns({f"rolling_{credits}_{days}d": F.sum(credits).over(over), f"rolling_n_terms_{days}d": F.count(date).over(over)})
    return out.withColumn(f"avg_{credits}_{days}d", C.ratio(f"rolling_{credits}_{days}d", f"rolling_n_terms_{days}d")).drop("_s")


def shares_of_history(df: DataFrame, prefix: str, denominator: str, old: str, new: str) -> DataFrame:
    """df with each column of a prefix divided by the denominator, under a new prefix."""
    return df.withColumns({c.replace(old, new, 1): C.ratio(c, denominator) for c in df.columns if c.startswith(prefix) and c != denominator})
