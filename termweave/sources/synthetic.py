"""Generated cohort and course tables: seeded hashes of row numbers, so any number of rows without a driver loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _pick(values: Sequence, salt: str, seed: int) -> Column:
    options = F.array(*(F.lit(v) for v in values))
    return F.element_at(options, (F.pmod(F.xxhash64("id", F.lit(salt), F.lit(seed)), F.lit(len(values))) + 1).cast("int"))


def cohorts(spark: SparkSession, n: int, seed: int = 0, first_year: int = 2015) -> DataFrame:
    rows = spark.range(n)
    year = _pick(list(range(first_year, first_year + 6)), "year", seed)
    return rows.select(
        F.concat(F.lit("S"), F.lpad(F.col("id").cast("string"), 10, "0")).alias("student_id"), F.lit("INST").alias("institution_id"),
        F.concat(year.cast("string"), F.lit("-"), F.lpad(F.pmod(year + 1, F.lit(100)).cast("string"), 2, "0")).alias("cohort"),
        _pick(("FALL", "WINTER", "SPRING", "SUMMER"), "term", seed).alias("cohort_term"), _pick(("FIRST-TIME", "RE-ADMIT", "TRANSFER-IN"), "type", seed).alias("enrollment_type"),
        _pick(("FULL-TIME", "PART-TIME"), "intensity", seed).alias("enrollment_intensity_first_term"), _pick(("Y", "N", None), "pell", seed).alias("pell_status_first_year"),
        _pick((1.0, 2.0, 2.5, 3.0, 3.5, 4.0), "gpa1", seed).alias("gpa_group_term_1"), _pick((1.0, 2.0, 2.5, 3.0, 3.5, 4.0), "gpay", seed).alias("gpa_group_year_1"),
    )


def courses(cohort: DataFrame, per_student: int = 8, seed: int = 0) -> DataFrame:
    rows = cohort.select("student_id", "institution_id", "cohort", "cohort_term", F.explode(F.sequence(F.lit(0), F.lit(per_student - 1))).alias("k")).withColumn("id", F.xxhash64("student_id", "k"))
    year = F.substring("cohort", 1, 4).cast("int") + (F.col("k") / 3).cast("int")
    return rows.select(
        "student_id", "institution_id", "cohort", "cohort_term", F.concat(year.cast("string"), F.lit("-"), F.lpad(F.pmod(year + 1, F.lit(100)).cast("string"), 2, "0")).alias("academic_year"),
        _pick(("FALL", "WINTER", "SPRING", "SUMMER"), "t", seed).alias("academic_term"), _pick(("MATH", "ENGL", "BIOL", "HIST"), "p", seed).alias("course_prefix"),
        _pick(("101", "102", "201", "305"), "n", seed).alias("course_number"), _pick(("01", "02"), "s", seed).alias("section_id"), _pick(("27.0101", "23.1301", "26.0101", "54.0101"), "c", seed).alias("course_cip"),
        _pick(("0", "1", "2", "3", "4", "P", "F", "W", "I"), "g", seed).alias("grade"), _pick((1.0, 3.0, 4.0), "cr", seed).alias("number_of_credits_attempted"),
    )
