"""Scans: text tables stay text until typed, and every reader stays lazy."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions import columns as C
from termweave.functions import names
from termweave.operators import cleaning

DATE_FORMATS = ("yyyy-MM-dd", "yyyyMMdd'.0'", "yyyyMMdd")


def read_csv(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    """All columns as text."""
    return spark.read.csv(path, **({"header": True, "inferSchema": False, "multiLine": False, "escape": '"'} | options))


def read_parquet(spark: SparkSession, path: str, types: Mapping[str, str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumns({c: cleaning.typed(c, t) for c, t in types.items()}) if types else df


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_source(spark: SparkSession, file: str | None = None, table: str | None = None) -> DataFrame:
    """A file (its ending picks the reader) or a table: exactly one of them."""
    if (file is None) == (table is None):
        raise ValueError("exactly one of file and table")
    if table is not None:
        return read_table(spark, table)
    readers = {"csv": read_csv, "parquet": read_parquet, "json": lambda s, p: s.read.json(p), "orc": lambda s, p: s.read.orc(p)}
    kind = file.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in readers:
        raise ValueError(f"no reader for .{kind}")
    return readers[kind](spark, file)


def parse_dates(df: DataFrame, columns: Sequence[str], formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """df with text dates parsed by the first format that fits every known value of a column; raises if none does.
    One aggregate tries all formats on all columns."""
    if not columns:
        return df
    tried = [F.count(F.when(F.col(c).isNotNull() & F.try_to_timestamp(F.col(c), F.lit(f)).isNull(), 1)).alias(f"{c}|{i}") for c in columns for i, f in enumerate(formats)]
    row = df.agg(*tried).first()
    made = {}
    for c in columns:
        fits = [f for i, f in enumerate(formats) if row[f"{c}|{i}"] == 0]
        if not fits:
            raise ValueError(f"no date format fits {c}")
        made[c] = F.try_to_timestamp(F.col(c), F.lit(fits[0])).cast("date")
    return df.withColumns(made)


def prepare(df: DataFrame, rename: Mapping[str, str] | None = None, upper: Sequence[str] = (), dates: Sequence[str] = (), null_values: Mapping[str, Sequence] | None = None, booleans: Sequence[str] = (), converter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Names, upper case, dates, null values, booleans, then a converter of the caller's."""
    df = names.rename_some(names.rename_all(df), rename or {})
    df = parse_dates(df, [c for c in dates if c in df.columns])
    made = {c: F.upper(c) for c in upper if c in df.columns}
    made |= {c: C.null_if_in(made.get(c, F.col(c)), v) for c, v in (null_values or {}).items() if c in df.columns}
    made |= {c: C.bool_from(F.lower(F.col(c).cast("string")), {"1": True, "1.0": True, "true": True, "0": False, "0.0": False, "false": False}) for c in booleans if c in df.columns}
    df = df.withColumns(made) if made else df
    return converter(df) if converter else df


def read_courses(spark: SparkSession, file: str | None = None, table: str | None = None, converter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Course rows with typed dates and credits."""
    df = prepare(read_source(spark, file, table), {"student_guid": "student_id", "study_id": "student_id"}, ("academic_term", "cohort_term", "grade"), ("course_begin_date", "course_end_date"))
    credits = [c for c in ("number_of_credits_attempted", "number_of_credits_earned") if c in df.columns]
    df = df.withColumns({c: F.col(c).try_cast("double") for c in credits}) if credits else df
    return converter(df) if converter else df


def read_cohorts(spark: SparkSession, file: str | None = None, table: str | None = None, converter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Cohort rows; unknown GPA groups are null, retention and persistence booleans."""
    df = read_source(spark, file, table)
    unknown = {c: ("UK",) for c in ("gpa_group_term_1", "gpa_group_year_1")}
    df = prepare(df, {"student_guid": "student_id", "study_id": "student_id"}, ("cohort_term", "enrollment_type"), (), unknown, ("retention", "persistence"))
    gpa = [c for c in unknown if c in df.columns]
    df = df.withColumns({c: F.col(c).try_cast("double") for c in gpa}) if gpa else df
    return converter(df) if converter else df


def read_own_courses(spark: SparkSession, file: str | None = None, table: str | None = None, grades: Mapping[str, str] | None = None, converter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Course rows of schools with names of their own: learner_id and course_credits_*, letter grades as points."""
    renamed = {"learner_id": "student_id", "course_credits_attempted": "number_of_credits_attempted", "course_credits_earned": "number_of_credits_earned", "course_section_id": "section_id"}
    df = prepare(read_source(spark, file, table), renamed, ("academic_term",))
    made = {c: F.col(c).try_cast("double") for c in ("number_of_credits_attempted", "number_of_credits_earned") if c in df.columns}
    made |= {"grade": C.normal_grade("grade", grades)} if "grade" in df.columns else {}
    made |= {"academic_term": C.normal_term("academic_term")} if "academic_term" in df.columns else {}
    df = df.withColumns(made) if made else df
    return converter(df) if converter else df


def read_own_cohorts(spark: SparkSession, file: str | None = None, table: str | None = None, converter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Student rows of such schools: entry_year and entry_term name the cohort; categories are normalised."""
    df = prepare(read_source(spark, file, table), {"learner_id": "student_id", "entry_year": "cohort", "entry_term": "cohort_term"}, ("cohort_term",))
    rules = {"cohort_term": C.normal_term, "enrollment_type": C.normal_enrollment, "student_age": C.normal_age, "pell_status_first_year": C.normal_pell, "credential_type_sought_year_1": C.normal_credential}
    made = {c: rule(c) for c, rule in rules.items() if c in df.columns}
    df = df.withColumns(made) if made else df
    return converter(df) if converter else df


def read_config(path: str) -> dict:
    """A TOML file."""
    return tomllib.loads(Path(path).read_text())


def features_table(spark: SparkSession, path: str) -> DataFrame:
    """(pattern, name, description) of a TOML features table: a small lookup."""
    rows = [(k, v.get("name", k), v.get("description", "")) for k, v in read_config(path).items() if isinstance(v, dict)]
    return spark.createDataFrame(rows, "pattern string, name string, description string")


def resolve_file(folder: str, needles: Sequence[str], suffixes: Sequence[str] = (".csv", ".parquet")) -> str:
    """The one file of a folder whose name holds all needles."""
    found = sorted(str(p) for p in Path(folder).iterdir() if p.suffix in suffixes and all(n.lower() in p.name.lower() for n in needles))
    if len(found) != 1:
        raise ValueError(f"{len(found)} files for {list(needles)} in {folder}")
    return found[0]


def pick_path(candidates: Sequence[str]) -> str:
    for c in candidates:
        if Path(c).exists():
            return c
    raise FileNotFoundError(f"none of {list(candidates)}")


def contract_file(path: str) -> dict:
    return json.loads(Path(path).read_text())
