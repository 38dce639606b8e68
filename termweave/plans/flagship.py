"""Whole dataflows, composed of operators; nothing here runs before its result is used."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from termweave.functions import names
from termweave.operators import checkpoints, courses, cumulative, model_prep, selection, student_terms, students, targets, terms


def student_term_dataset(cohort: DataFrame, course: DataFrame, dummies: Mapping[str, Sequence] | None = None, equal: Sequence[tuple[str, object]] = (), level_pattern: str | None = None, calendar: DataFrame | None = None, rename: bool = True) -> DataFrame:
    """Cohort and course rows to one row a student and term, with features of courses, sections, terms and history.

    Shuffles: course rows once by section (a window) and once by student, which the first occurrences of courses, the
    student-term aggregate, the join to students and all windows share. The term dimension is broadcast.
    """
    options = {"level_pattern": level_pattern} if level_pattern else {}
    rows = terms.term_features(courses.course_features(course, **options), calendar=calendar)
    rows = courses.section_features(rows)
    people = students.student_features(cohort)
    keys = students.merge_keys(people, rows)
    rows = cumulative.first_occurrences(rows.dropna(subset=["student_id", "term_id"]).repartition("student_id"))
    by_term = student_terms.aggregate_courses(rows, ["student_id", "term_id"], dummies, equal)
    shared = [k for k in keys if k in by_term.columns]
    joined = by_term.join(people.drop(*(c for c in people.columns if c in by_term.columns and c not in shared)), shared)
    out = cumulative.cumulative_features(student_terms.student_term_features(joined))
    return names.rename_all(out) if rename else out


def read_pair(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """Standardised cohort and course tables of a folder."""
    return spark.read.parquet(f"{folder}/cohort_standardized.parquet"), spark.read.parquet(f"{folder}/course_standardized.parquet")


def modelling_table(student_term: DataFrame, attributes: Mapping[str, object], target: Mapping, credits: float | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Checkpoints of selected students with target, leakage masked, split and weighted."""
    checkpoint = checkpoints.first_terms_in_cohort(student_term) if credits is None else checkpoints.first_terms_at_credits(student_term, credits)
    chosen = selection.students_with(student_term, attributes)
    labels = targets.from_config(student_term, target)
    merged = model_prep.merge_labelled(checkpoint, chosen, labels)
    return model_prep.sample_weights(model_prep.split(model_prep.mask_leakage(merged, drop=drop)))
