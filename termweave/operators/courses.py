"""Course rows: features, section features, rankings."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import columns as C
from termweave.functions import constants as K

#: Features and the input columns that they need.
FEATURES = {
    "course_id": ("course_prefix", "course_number"),
    "course_subject_area": ("course_cip",),
    "course_passed": ("grade",),
    "course_completed": ("grade",),
    "course_level": ("course_number",),
    "course_grade_numeric": ("grade",),
    "course_grade": ("grade",),
}


def course_features(df: DataFrame, features: Sequence[str] | None = None, min_passing_grade: float = K.MIN_PASSING_GRADE, level_pattern: str = K.COURSE_LEVEL_PATTERN, a_is_audit: bool = True) -> DataFrame:
    """df with the features (default: all whose inputs are there). The letter of a grade reads the numeric one as a column:
    written out in each of its branches, it makes one method too long for the JVM to compile."""
    features = [f for f in features or FEATURES if set(FEATURES[f]) <= set(df.columns)]
    if "course_grade" in features and "course_grade_numeric" not in features:
        raise ValueError("course_grade needs course_grade_numeric")
    made = {
        "course_id": lambda: C.course_id("course_prefix", "course_number"),
        "course_subject_area": lambda: C.short_cip("course_cip"),
        "course_passed": lambda: C.passed("grade", min_passing_grade),
        "course_completed": lambda: C.completed("grade"),
        "course_level": lambda: C.course_level("course_number", level_pattern),
        "course_grade_numeric": lambda: C.grade_numeric("grade"),
    }
    out = df.withColumns({f: made[f]() for f in features if f in made})
    return out.withColumn("course_grade", C.grade_label("grade", "course_grade_numeric", a_is_audit)) if "course_grade" in features else out


def section_features(df: DataFrame, keys: Sequence[str] = ("term_id", "course_id", "section_id"), student: str = "student_id") -> DataFrame:
    """df with counts and mean grade of each row's section, by one window; null where a key is null."""
    over = Window.partitionBy(*keys)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    windowed = {
        "sections_num_students_enrolled": F.count(student).over(over),
        "sections_num_students_passed": F.coalesce(F.sum(F.col("course_passed").cast("int")).over(over), F.lit(0)),
        "sections_num_students_completed": F.coalesce(F.sum(F.col("course_completed").cast("int")).over(over), F.lit(0)),
        "section_course_grade_numeric_mean": F.avg("course_grade_numeric").over(over),
    }
    return df.withColumns({n: F.when(whole, windowed[n]) for n in windowed})


def rank_dfwi(
    df: DataFrame, least: int = 30, keys: Sequence[str] = ("course_prefix", "course_number"), grade: str = "grade",
    kinds: Mapping[str, Sequence[str]] = K.DFWI_GRADES, completed: Sequence[str] = K.COMPLETED_GRADES,
) -> DataFrame:
    """(key, enrollments_den, D, F, W, I, dfwi_count, rate) of courses by their rate of those grades, as they are written.

    The denominator counts completed and withdrawn rows only, so rates may exceed 1."""
    g = C.upper_trim(grade)
    n = lambda hit: F.count_if(C.truthy(hit))
    out = df.groupBy(C.course_id(*keys).alias("key")).agg(n(g.isin(*completed, *kinds["W"])).alias("enrollments_den"), *(n(g.isin(*of)).alias(k) for k, of in kinds.items()))
    total = functools.reduce(lambda a, b: a + b, (F.col(k) for k in kinds))
    out = out.where(F.col("enrollments_den") >= least).withColumn("dfwi_count", total).withColumn("rate", C.ratio("dfwi_count", "enrollments_den"))
    return out.orderBy(F.desc("rate"), F.desc("enrollments_den"), "key")


def count_flags(df: DataFrame, original: str, prefix: str = "term_n_courses_") -> DataFrame:
    """df with the counts of one original column's values replaced by flags taking_course_..._this_term: 1 where positive, else as they were."""
    counts = [c for c in df.columns if c.startswith(prefix + original)]
    return df.withColumns({f"taking_course_{c.removeprefix(prefix)}_this_term": F.when(F.col(c) > 0, F.lit(1).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in counts}).drop(*counts)
