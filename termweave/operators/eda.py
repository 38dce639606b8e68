"""Audit reports: counts, crosstabs, consistency of credits and grades."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import columns as C
from termweave.functions import constants as K


def column_uniqueness(df: DataFrame) -> DataFrame:
    """(column, n_unique, n_null, is_unique) of all columns, by one aggregate."""
    made = [F.struct(F.lit(c).alias("column"), F.countDistinct(F.col(f"`{c}`")).alias("n_unique"), F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias("n_null"), F.count("*").alias("n")).alias(f"_{i}") for i, c in enumerate(df.columns)]
    rows = df.agg(*made).select(F.explode(F.array(*(F.col(f"_{i}") for i in range(len(made))))).alias("r")).select("r.*")
    return rows.select("column", "n_unique", "n_null", (F.col("n_unique") == F.col("n")).alias("is_unique"))


def summary_stats(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """column, count, nulls, mean, std, min, quartiles (exact, or with an accuracy) and max of numeric columns, unpivoted and grouped once."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], list(columns), "column", "x")
    at = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    p = F.percentile("x", at) if accuracy is None else F.percentile_approx("x", at, accuracy)
    out = long.groupBy("column").agg(F.count("x").alias("n"), F.count("*").alias("_all"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), p.alias("_p"), F.max("x").alias("max"))
    nulls = F.col("_all") - F.col("n")
    return out.select("column", "n", nulls.alias("null_count"), F.round(100 * nulls / F.col("_all"), 1).alias("null_pct"), "mean", "std", "min", F.col("_p")[0].alias("q1"), F.col("_p")[1].alias("median"), F.col("_p")[2].alias("q3"), "max")


def group_shares(df: DataFrame, columns: Sequence[str], nulls: bool = True, places: int = 1) -> DataFrame:
    """Columns, n and pct of all rows."""
    counts = (df if nulls else df.dropna(subset=list(columns))).groupBy(*columns).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), places))


def crosstab(df: DataFrame, a: str, b: str, normalise: bool = False) -> DataFrame:
    """(a, b, n) with margins, named All, by grouping sets; long form, so that any number of categories fits."""
    name = lambda c: F.when(F.grouping(c) == 1, F.lit("All")).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("null")))
    pairs = df.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    cells = pairs.cube("_a", "_b").agg(name("_a").alias("a"), name("_b").alias("b"), F.count("*").alias("n")).select("a", "b", "n")
    if not normalise:
        return cells
    total = df.agg(F.count("*").alias("_all"))
    return cells.join(F.broadcast(total)).select("a", "b", "n", F.round(100.0 * F.col("n") / F.col("_all"), 1).alias("pct"))


def crosstab_wide(df: DataFrame, a: str, b: str, values: Sequence) -> DataFrame:
    return df.groupBy(a).pivot(b, list(values)).count().na.fill(0)


def high_null_columns(df: DataFrame, share: float = 0.2) -> DataFrame:
    """(column, null_share) of columns above a share of nulls."""
    row = df.agg(*(F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in df.columns))
    return row.unpivot([], list(df.columns), "column", "null_share").where(F.col("null_share") > share)


def gateway_courses(df: DataFrame, c: str = "math_or_english_gateway") -> DataFrame:
    """(course_id, course_subject_area, gateway, n, upper_level) of gateway courses."""
    rows = df.where(F.col(c).isin("M", "E")).withColumns({"course_id": C.course_id("course_prefix", "course_number"), "course_subject_area": C.short_cip("course_cip")})
    upper = F.max(C.truthy(C.course_level("course_number") >= 2))
    return rows.groupBy("course_id", "course_subject_area", F.col(c).alias("gateway")).agg(F.count("*").alias("n"), upper.alias("upper_level"))


def misjoined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, n_keys): keys on the left only, the right only, or both."""
    a, b = (df.select(key).dropna().distinct().withColumn(n, F.lit(1)) for df, n in ((left, "l"), (right, "r")))
    side = F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").otherwise("both")
    return a.join(b, key, "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n_keys"))


def not_in(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of the left that the right lacks; null equals null."""
    a, b = left.select(*keys).distinct(), right.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(b, same, "left_anti")


def earned_over_attempted(df: DataFrame, earned: str = "number_of_credits_earned", attempted: str = "number_of_credits_attempted") -> DataFrame:
    """One row: rows, rows that earn more than they attempt, and earn something of nothing; with percentages."""
    more, nothing = C.truthy(F.col(earned) > F.col(attempted)), C.truthy((F.col(attempted) == 0) & (F.col(earned) > 0))
    n = F.count("*")
    return df.agg(n.alias("n"), F.sum(more.cast("int")).cast("bigint").alias("n_more"), F.sum(nothing.cast("int")).cast("bigint").alias("n_of_nothing"), F.round(100 * F.avg(more.cast("int")), 4).alias("pct_more"), F.round(100 * F.avg(nothing.cast("int")), 4).alias("pct_of_nothing"))


def course_credit_anomalies(df: DataFrame, attempted: str = "number_of_credits_attempted", earned: str = "number_of_credits_earned", tolerance: float = 0.0) -> DataFrame:
    """Course rows that earn more than they attempt, or either below zero, with those flags and the difference."""
    a, e = F.col(attempted).try_cast("double"), F.col(earned).try_cast("double")
    flags = {"earned_exceeds_attempted": C.truthy(e - a > tolerance), "attempted_negative": C.truthy(a < 0), "earned_negative": C.truthy(e < 0)}
    return df.withColumns({"diff": e - a, **flags}).where(" OR ".join(flags))


def share_of_rows(part: DataFrame, whole: DataFrame) -> DataFrame:
    """One row: rows_checked, rows_with_anomalies and their percentage."""
    counts = whole.agg(F.count("*").alias("rows_checked")).join(F.broadcast(part.agg(F.count("*").alias("rows_with_anomalies"))))
    return counts.withColumn("pct_of_data", F.coalesce(F.round(F.try_divide(100 * F.col("rows_with_anomalies"), "rows_checked"), 2), F.lit(0.0)))


#: Measures of a reconciliation: name, then the credits of courses and of terms.
MEASURES = {"attempted": ("number_of_credits_attempted", "number_of_semester_credits_attempted"), "earned": ("number_of_credits_earned", "number_of_semester_credits_earned")}


def reconciled_terms(courses: DataFrame, reported: DataFrame, keys: Sequence[str], measures: Mapping[str, tuple[str, str]] = MEASURES, tolerance: float = 0.0) -> DataFrame:
    """Reported rows with the sums and number of their courses, has_course_rows, and per measure diff_ (courses less reported)
    and match_. Null keys meet each other; a difference that is not known is no match."""
    measures = {m: of for m, of in measures.items() if of[1] in reported.columns}
    number = lambda c: F.col(c).try_cast("double")
    sums = courses.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(*(F.coalesce(F.sum(number(c)), F.lit(0.0)).alias(f"course_sum_{m}") for m, (c, _) in measures.items()), F.count("*").alias("course_count"))
    on = functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    out = reported.join(sums, on, "left").drop(*(f"_{k}" for k in keys)).withColumn("has_course_rows", F.col("course_count").isNotNull())
    for m, (_, c) in measures.items():
        out = out.withColumn(f"diff_{m}", F.col(f"course_sum_{m}") - number(c)).withColumn(f"match_{m}", C.truthy(F.abs(f"diff_{m}") <= tolerance))
    return out


def reconciliation(terms: DataFrame, measures: Sequence[str] = tuple(MEASURES), accuracy: int | None = None) -> DataFrame:
    """One row over reconciled_terms(): total_semester_rows, mismatched_rows, pct_of_data, rows_without_courses and, per measure,
    mismatches, their direction, and median, 90th percentile and maximum of the absolute differences (exact, or with an accuracy)."""
    missed = functools.reduce(lambda a, b: a | b, (~F.col(f"match_{m}") for m in measures))
    aggregates = [F.count("*").alias("total_semester_rows"), F.count_if(missed).alias("mismatched_rows"), F.coalesce(F.round(100 * F.avg(missed.cast("int")), 2), F.lit(0.0)).alias("pct_of_data"), F.count_if(~F.col("has_course_rows")).alias("rows_without_courses")]
    for m in measures:
        d = F.col(f"diff_{m}")
        at = F.array(F.lit(0.5), F.lit(0.9))
        p = F.percentile(F.abs(d), at) if accuracy is None else F.percentile_approx(F.abs(d), at, accuracy)
        aggregates += [F.count_if(~F.col(f"match_{m}")).alias(f"{m}_mismatches"), F.count_if(C.truthy(d < 0)).alias(f"{m}_terms_above"), F.count_if(C.truthy(d > 0)).alias(f"{m}_courses_above"), F.get(p, F.lit(0)).alias(f"{m}_median_gap"), F.get(p, F.lit(1)).alias(f"{m}_p90_gap"), F.max(F.abs(d)).alias(f"{m}_max_gap")]
    return terms.agg(*aggregates)


def pass_fail_anomalies(
    df: DataFrame, grade: str = "grade", flag: str = "pass_fail_flag", earned: str = "number_of_credits_earned", passing: Sequence[str] = K.PASSING_GRADES,
    failing: Sequence[str] = K.FAILING_GRADES, pass_flags: Sequence[str] = K.PASS_FLAGS, fail_flags: Sequence[str] = K.FAIL_FLAGS,
) -> DataFrame:
    """df with three rules broken or not: credits with a failing flag, none with a passing one, grade and flag that disagree."""
    says = lambda c, yes, no: F.when(C.upper_trim(c).isin(*yes), True).when(C.upper_trim(c).isin(*no), False)
    by_grade, by_flag, credits = says(grade, passing, failing), says(flag, pass_flags, fail_flags), F.col(earned).try_cast("double")
    return df.withColumns({"earned_with_failing_grade": C.truthy(~by_flag & (credits > 0)), "no_credits_with_passing_grade": C.truthy(by_flag & (credits == 0)), "grade_pf_disagree": C.truthy(by_grade != by_flag)})


def pass_fail_consistency(df: DataFrame, **options) -> DataFrame:
    """One row: rows and percentage that break each rule of pass_fail_anomalies(), and any."""
    rules = ("earned_with_failing_grade", "no_credits_with_passing_grade", "grade_pf_disagree")
    found = pass_fail_anomalies(df, **options).withColumn("total_anomalous_rows", F.expr(" OR ".join(rules)))
    pct = lambda c: F.coalesce(F.round(100 * F.avg(F.col(c).cast("int")), 2), F.lit(0.0)).alias(f"{c}_pct")
    return found.agg(*(x for c in (*rules, "total_anomalous_rows") for x in (F.count_if(F.col(c)).alias(c), pct(c))))


def unmapped_grades(df: DataFrame, c: str = "grade") -> DataFrame:
    """(grade, n) of grades that are neither numbers from 0 to 4 nor status codes; letters count as unmapped."""
    g = C.upper_trim(c)
    number = C.truthy(g.try_cast("double").between(0, 4))
    return df.where(g.isNotNull() & (g != "") & ~number & ~g.isin(*K.STATUS_GRADES)).groupBy(g.alias("grade")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, c: str, k: int) -> DataFrame:
    """(c, n) of the k most frequent values, ties by value."""
    return df.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(k)


def title(c: Column | str) -> Column:
    """Upper case after every character that is no letter."""
    letters = F.split(F.lower(C.col(c)), "")
    made = F.transform(letters, lambda x, i: F.when((i == 0) | ~F.element_at(letters, F.greatest(i, F.lit(1))).rlike(r"\p{L}"), F.upper(x)).otherwise(x))
    return F.array_join(made, "")


def record_drops(counts: Mapping[str, int]) -> list[tuple[str, int, int]]:
    """(step, rows, lost) of consecutive row counts."""
    out, before = [], None
    for step, n in counts.items():
        out.append((step, n, 0 if before is None else before - n))
        before = n
    return out


class CohortSummary:
    """The measures of a cohort dashboard; each is one lazy table."""

    def __init__(self, cohort: DataFrame, course: DataFrame, student: str = "student_id") -> None:
        self.cohort, self.course, self.student = cohort, course, student

    def totals(self) -> DataFrame:
        of_course = self.course.agg(F.countDistinct(self.student).alias("n_course_students"), F.count("*").alias("n_course_rows"))
        return self.cohort.agg(F.count("*").alias("n_cohort_rows"), F.countDistinct(self.student).alias("n_cohort_students")).join(F.broadcast(of_course))

    def gpa_by_enrollment_type(self) -> DataFrame:
        return self.cohort.groupBy(title("enrollment_type").alias("enrollment_type"), "cohort").agg(F.round(F.avg("gpa_group_year_1"), 4).alias("gpa"))

    def by_term(self) -> DataFrame:
        return group_shares(self.cohort, ["cohort", "cohort_term"])

    def course_enrollments(self) -> DataFrame:
        return self.course.groupBy("academic_year", "academic_term").agg(F.countDistinct(self.student).alias("n_students"), F.count("*").alias("n"))

    def degree_types(self) -> DataFrame:
        return group_shares(self.cohort, ["credential_type_sought_year_1"])

    def intensity_by_type(self) -> DataFrame:
        return crosstab(self.cohort, "enrollment_intensity_first_term", "enrollment_type")

    def pell(self) -> DataFrame:
        return group_shares(self.cohort, ["pell_status_first_year"])

    def age_by_gender(self) -> DataFrame:
        return crosstab(self.cohort, "student_age", "gender")

    def race_by_pell(self) -> DataFrame:
        return crosstab(self.cohort, "race", "pell_status_first_year")

    def retention(self) -> DataFrame:
        rate = lambda c: F.round(100 * F.avg(F.col(c).cast("int")), 2)
        return self.cohort.groupBy("cohort").agg(rate("retention").alias("retention_pct"), rate("persistence").alias("persistence_pct"))

    def grades(self) -> DataFrame:
        return group_shares(self.course, ["grade"])

    def majors(self, k: int = 10) -> DataFrame:
        return top_values(self.cohort, "program_of_study_term_1", k)

    def terms(self) -> DataFrame:
        return self.course.groupBy("academic_year", "academic_term").agg(F.count("*").alias("n"))
