"""Target labels: (student, target) of the students whose outcome the data can tell."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import columns as C

from . import checkpoints

Limits = Mapping[str, tuple[float, str]]


def _terms(limits: Limits, terms_in_year: int) -> dict[str, float]:
    """Limits in terms; a year of four terms ends before the last one's, so one term less, but one at least."""
    out = C.convert_limits("term", limits, terms_in_year)
    return {k: max(n - 1.0, 1.0) for k, n in out.items()} if terms_in_year == 4 else out


def _beyond(limits: Mapping[str, float], intensity: Column, late: Callable[[float], Column]) -> Column:
    """Whether a limit for the intensity (or any, *) is exceeded."""
    out = F.lit(False)
    for k, n in limits.items():
        out = out | ((F.lit(True) if k == "*" else C.truthy(intensity == k)) & late(n))
    return out


def labelable(df: DataFrame, checkpoint: DataFrame, limits: Mapping[str, float], terms_in_year: int = 4, max_term_rank: int | None = None, student: Sequence[str] = ("student_id",), rank: str = "term_rank", intensity: str = "student_term_enrollment_intensity", keep: Sequence[str] = ()) -> DataFrame:
    """(student, student_max_term_rank, max_term_rank) of checkpoint students whose last term within the limit, in terms,
    lies in the data. An inferred end looks at core terms only; the season of the checkpoint shifts the limit by a term."""
    span = F.lit(limits["*"]) if "*" in limits else C.lookup(intensity, limits)
    last = F.col(rank) + span - 1.0
    if "academic_term" in checkpoint.columns:
        season = F.upper("academic_term")
        if terms_in_year == 3:
            last = last - F.when(season == "FALL", 1.0).otherwise(0.0)
        elif terms_in_year == 4:
            last = last + F.when(season.isin("SUMMER", "WINTER"), 1.0).otherwise(0.0)
    out = checkpoint.select(*student, *keep, last.alias("student_max_term_rank"))
    if max_term_rank is not None:
        out = out.withColumn("max_term_rank", F.lit(max_term_rank))
    else:
        end = F.max(rank)
        if "term_is_core" in df.columns:
            end = F.coalesce(F.max(F.when(C.truthy(F.col("term_is_core")), F.col(rank))), end)
        out = out.join(F.broadcast(df.agg(end.cast("int").alias("max_term_rank"))))  # one row
    return out.where(F.col("student_max_term_rank") <= F.col("max_term_rank"))


def more_than_one(checkpoint: DataFrame, student: Sequence[str] = ("student_id",)) -> DataFrame:
    """Students with several checkpoint rows; targets need none."""
    return checkpoint.groupBy(*student).count().where("count > 1")


def graduation(df: DataFrame, limits: Limits, terms_in_year: int = 4, max_term_rank: int | None = None, student: Sequence[str] = ("student_id",), years: str = "years_to_degree", year: str = "year_of_enrollment_at_cohort_inst", intensity: str = "student_term_enrollment_intensity") -> DataFrame:
    """target: not graduated in time. The intensity is a student's most common one up to graduation, ties by name.

    One aggregate a student gives that, and the checkpoint: the first term that is not before the cohort."""
    before = F.coalesce(F.col(year) <= F.col(years).cast("int"), F.lit(True))
    season = ["academic_term"] if "academic_term" in df.columns else []
    first = F.struct("term_rank", intensity, *season)
    if "term_is_pre_cohort" in df.columns:
        first = F.when(~C.truthy(F.col("term_is_pre_cohort")), first)
    own = df.groupBy(*student).agg(F.mode(F.when(before, F.col(intensity)), True).alias("_intensity"), F.min(years).alias("_years"), F.max(before).alias("_any"), F.min(first).alias("_first"))
    late = _beyond(C.convert_limits("year", limits, terms_in_year), F.col("_intensity"), lambda n: F.coalesce(F.col("_years") > n, F.lit(True)))
    checkpoint = own.where("_first IS NOT NULL").select(*student, "_first.*", (F.col("_any") & late).alias("target"))
    return labelable(df, checkpoint, _terms(limits, terms_in_year), terms_in_year, max_term_rank, student, intensity=intensity, keep=["target"]).select(*student, "target")


def credits_earned(df: DataFrame, credits: float, limits: Limits, checkpoint: DataFrame, terms_in_year: int = 4, max_term_rank: int | None = None, student: Sequence[str] = ("student_id",), rank: str = "term_rank", intensity: str = "student_term_enrollment_intensity", c: str = "cumsum_num_credits_earned") -> DataFrame:
    """target: so many credits not reached, or more terms after the checkpoint than its intensity's limit."""
    spans = _terms(limits, terms_in_year)
    reached = checkpoints.first_terms_at_credits(df, credits, c, student=student, order=(rank,)).select(*student, F.col(rank).alias("_reached"))
    known = labelable(df, checkpoint, spans, terms_in_year, max_term_rank, student, rank, intensity, keep=[rank, intensity])
    late = _beyond(spans, F.col(intensity), lambda n: F.coalesce(F.col("_reached") - F.col(rank) > n, F.lit(True)))
    return known.join(reached, list(student), "left").select(*student, late.alias("target"))


def _year(c: Column) -> Column:
    return C.extract(c, r"(\d{4})").cast("int")


def retention(df: DataFrame, student: Sequence[str] = ("student_id",), retained: str = "retention", cohort: str = "cohort_id", term: str = "term_id", max_year: int | None = None) -> DataFrame:
    """target: not retained, for students whose cohort year lies before the last academic year of the data."""
    end = F.lit(max_year) if max_year is not None else F.max(_year(F.col(term)) + F.when(F.col(term).endswith("SUMMER"), 1).otherwise(0))
    last = df.agg(end.alias("_end")) if max_year is None else df.limit(1).select(end.alias("_end"))
    one = df.groupBy(*student).agg(F.min(F.col(retained).cast("boolean")).alias("_kept"), F.min(cohort).alias("_cohort"))
    return one.join(F.broadcast(last)).where(_year(F.col("_cohort")) < F.col("_end")).where("_kept IS NOT NULL").select(*student, (~F.col("_kept")).alias("target"))


def with_retention(df: DataFrame, student: Sequence[str] = ("student_id",), year: str = "year_of_enrollment_at_cohort_inst", credentials: Sequence[str] = ()) -> DataFrame:
    """df with retention: enrolled in a second year, or a credential in year 1 or 2."""
    whole = Window.partitionBy(*student)
    out = C.truthy(F.max(year).over(whole) >= 2)
    for c in credentials:
        out = out | C.truthy(F.max(F.col(c).isin(1, 2)).over(whole))
    return df.withColumn("retention", out)


def from_config(df: DataFrame, config: Mapping) -> DataFrame:
    """The target that a configuration names: {'type': graduation | credits_earned | retention, ...options}."""
    options = {k: v for k, v in config.items() if k != "type"}
    made = {"graduation": graduation, "credits_earned": credits_earned, "retention": retention}
    if config.get("type") not in made:
        raise ValueError(f"no such target: {config.get('type')}")
    return made[config["type"]](df, **options)


def first_term_of_year(terms: Sequence[str]) -> str:
    """The first of the ordered terms of a calendar."""
    return list(terms)[0]


def terms_in_year(terms: Sequence[str]) -> int:
    return len(set(terms))
