"""Checkpoints: one chosen term for each student."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import columns as C


def _ranked(df: DataFrame, keep: Column, student: Sequence[str], order: Sequence[str], descending: bool = False) -> DataFrame:
    by = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in order]
    return df.where(keep).withColumn("_n", F.row_number().over(Window.partitionBy(*student).orderBy(*by)))


def nth_terms(df: DataFrame, n: int = 0, student: Sequence[str] = ("student_id",), order: Sequence[str] = ("term_rank",), columns: Sequence[str] | None = None, pre_cohort: bool = False, noncore: bool = True, enrollment_year: int | None = None) -> DataFrame:
    """Each student's n-th term (from 0), without terms before the cohort or non-core ones if so asked; the year of
    enrolment is looked at after the choice."""
    keep = F.lit(True)
    if not pre_cohort and "term_is_pre_cohort" in df.columns:
        keep = keep & ~C.truthy(F.col("term_is_pre_cohort"))
    if not noncore:
        keep = keep & C.truthy(F.col("term_is_core"))
    out = _ranked(df, keep, student, order).where(F.col("_n") == n + 1).drop("_n")
    if enrollment_year is not None:
        out = out.where(F.col("year_of_enrollment_at_cohort_inst") == enrollment_year)
    return out.select(*columns) if columns else out


def first_terms(df: DataFrame, **options) -> DataFrame:
    return nth_terms(df, 0, pre_cohort=True, **options)


def first_terms_in_cohort(df: DataFrame, **options) -> DataFrame:
    return nth_terms(df, 0, pre_cohort=False, **options)


def first_terms_at_credits(df: DataFrame, credits: float, c: str = "cumsum_num_credits_earned", **options) -> DataFrame:
    """The first term at or above so many credits."""
    return nth_terms(df.where(F.col(c) >= credits), 0, pre_cohort=True, **options)


def last_terms(df: DataFrame, student: Sequence[str] = ("student_id",), order: Sequence[str] = ("term_rank",), columns: Sequence[str] | None = None) -> DataFrame:
    out = _ranked(df, F.lit(True), student, order, descending=True).where("_n = 1").drop("_n")
    return out.select(*columns) if columns else out


def last_terms_in_enrollment_year(df: DataFrame, year: int, **options) -> DataFrame:
    return last_terms(df.where(F.col("year_of_enrollment_at_cohort_inst") == year), **options)
