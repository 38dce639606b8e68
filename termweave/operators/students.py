"""Student rows: cohort features and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions import columns as C
from termweave.functions import constants as K


def student_features(df: DataFrame, first_term: str = K.FIRST_TERM) -> DataFrame:
    """df with cohort id and start date, pell flag, first program's area and GPA change, where their inputs are there."""
    have, made = set(df.columns), {}
    if {"cohort", "cohort_term"} <= have:
        made["cohort_id"] = C.year_term("cohort", "cohort_term")
        made["cohort_start_dt"] = C.term_date("cohort", "cohort_term", "start", first_term)
    if "program_of_study_term_1" in have:
        made["student_program_of_study_area_term_1"] = C.short_cip("program_of_study_term_1")
    if "program_of_study_year_1" in have:
        made["student_program_of_study_area_year_1"] = C.short_cip("program_of_study_year_1")
    if {"program_of_study_term_1", "program_of_study_year_1"} <= have:
        made["student_program_of_study_changed_term_1_to_year_1"] = F.col("program_of_study_term_1") != F.col("program_of_study_year_1")
    if "pell_status_first_year" in have:
        made["student_is_pell_recipient_first_year"] = C.pell_flag("pell_status_first_year")
    if {"gpa_group_term_1", "gpa_group_year_1"} <= have:
        made["diff_gpa_term_1_to_year_1"] = F.col("gpa_group_year_1") - F.col("gpa_group_term_1")
    for n in range(1, 5):
        if {f"number_of_credits_earned_year_{n}", f"number_of_credits_attempted_year_{n}"} <= have:
            made[f"frac_credits_earned_year_{n}"] = C.ratio(f"number_of_credits_earned_year_{n}", f"number_of_credits_attempted_year_{n}")
    return df.withColumns(made) if made else df


def merge_keys(left: DataFrame, right: DataFrame) -> list[str]:
    """student_id, and institution_id if both sides have it."""
    return [k for k in ("institution_id", "student_id") if k in left.columns and k in right.columns]


def key_overlap(left: DataFrame, right: DataFrame, key: str = "student_id") -> DataFrame:
    """One row: distinct keys on either side and how many both have."""
    a, b = (df.select(key).dropna().distinct() for df in (left, right))
    both = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), key, "full_outer")
    return both.agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1)).alias("n_both"))


def cip_source(df: DataFrame, candidates: tuple[str, ...] = ("term_program_of_study", "program_of_study_term_1"), share: float = 0.05) -> str | None:
    """The first candidate column of which that share of rows looks like a CIP code; one aggregate looks at all."""
    present = [c for c in candidates if c in df.columns]
    if not present:
        return None
    row = df.agg(*(F.avg(C.is_cip_like(c).cast("int")).alias(c) for c in present)).first()
    return next((c for c in present if (row[c] or 0) >= share), None)
