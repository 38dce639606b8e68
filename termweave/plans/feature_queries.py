"""Queries over features, histories, checkpoints and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions import columns as C
from termweave.operators import checkpoints, courses, cumulative, selection, student_terms, students, targets, terms

from . import flagship, lens
from .registry import query, r, rounded

_KEY = ["student_id", "term_id"]


def sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return courses.section_features(terms.term_features(courses.course_features(lens.courses(spark, sf_dir)), calendar=lens.calendar(spark, sf_dir)))


_PLANNED: dict[tuple[str, str], DataFrame] = {}


def student_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The student-term dataset; its plan, not its rows, is kept for the queries that start from it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PLANNED:
        _PLANNED[key] = _student_term(spark, sf_dir)
    return _PLANNED[key]


def _student_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship.student_term_dataset(lens.cohorts(spark, sf_dir), lens.courses(spark, sf_dir), lens.DUMMIES, lens.EQUAL, calendar=lens.calendar(spark, sf_dir))


_AGG = """,
st0 AS (
  SELECT student_id, term_id, min(academic_year) academic_year, min(academic_term) academic_term, min(term_start_dt) term_start_dt, min(term_ordinal) term_ordinal, min(term_rank) term_rank, min(term_rank_core) term_rank_core, min(term_rank_noncore) term_rank_noncore,
    bool_and(term_is_core) term_is_core, bool_and(term_is_noncore) term_is_noncore, bool_and(term_in_peak_covid) term_in_peak_covid, min(term_program_of_study) term_program_of_study,
    count(course_id) num_courses, list(course_id) course_ids, list(course_subject_area) areas, list(course_cip) subjects, count(DISTINCT course_id) course_id_nunique, CAST(coalesce(sum(course_passed::INT),0) AS BIGINT) num_courses_passed, CAST(sum(course_completed::INT) AS BIGINT) num_courses_completed,
    sum(number_of_credits_attempted) num_credits_attempted, sum(number_of_credits_earned) num_credits_earned, count(DISTINCT course_cip) course_subject_nunique, count(DISTINCT course_subject_area) course_subject_area_nunique,
    avg(course_level) course_level_mean, stddev_samp(course_level) course_level_std, avg(course_grade_numeric) course_grade_numeric_mean, stddev_samp(course_grade_numeric) course_grade_numeric_std,
    avg(sections_num_students_enrolled) section_num_students_enrolled_mean, stddev_samp(sections_num_students_enrolled) section_num_students_enrolled_std, CAST(sum(sections_num_students_enrolled) AS BIGINT) sections_num_students_enrolled, CAST(sum(sections_num_students_passed) AS BIGINT) sections_num_students_passed, CAST(sum(sections_num_students_completed) AS BIGINT) sections_num_students_completed,
    count(*) FILTER (course_type='CC') num_courses_course_type_cc, count(*) FILTER (delivery_method='O') num_courses_delivery_method_o, count(*) FILTER (course_grade='A') num_courses_course_grade_a, count(*) FILTER (course_level=2) num_courses_course_level_2,
    count(*) FILTER (core_course='Y') num_courses_core_course_y, count(*) FILTER (course_level IN (0,1)) num_courses_course_level_0_1, count(*) FILTER (course_type IN ('CC','CD')) num_courses_course_type_cc_cd, count(*) FILTER (enrolled_at_other_institution_s='Y') num_courses_enrolled_at_other_institution_s_y,
    count(*) FILTER (course_subject_area='24') num_courses_course_subject_area_24, count(*) FILTER (course_id='STAN101' OR regexp_matches(course_id,'^STAN101-\\d+$')) num_courses_course_id_stan_101,
    count(*) FILTER (coalesce(grade IN ('F','W'),false) OR coalesce(course_grade_numeric>=0 AND course_grade_numeric<1,false)) num_courses_grade_is_failing_or_withdrawal, count(*) FILTER (course_grade_numeric>section_course_grade_numeric_mean) num_courses_grade_above_section_avg
  FROM sectioned GROUP BY 1,2),
people AS (SELECT *, cohort||' '||cohort_term cohort_id, make_date(CAST(substring(cohort,1,4) AS INT) + CASE cohort_term WHEN 'FALL' THEN 0 ELSE 1 END, CASE cohort_term WHEN 'FALL' THEN 9 WHEN 'WINTER' THEN 1 WHEN 'SPRING' THEN 2 ELSE 6 END, 1) cohort_start_dt,
    CASE pell_status_first_year WHEN 'Y' THEN true WHEN 'N' THEN false END student_is_pell_recipient_first_year, gpa_group_year_1-gpa_group_term_1 diff_gpa_term_1_to_year_1 FROM cohorts),
st1 AS (SELECT s.*, p.* EXCLUDE (student_id, institution_id), CAST(ceil((term_start_dt-cohort_start_dt+1)/365.25) AS INT) year_of_enrollment_at_cohort_inst, term_start_dt<cohort_start_dt term_is_pre_cohort,
    num_courses_enrolled_at_other_institution_s_y>0 term_is_while_student_enrolled_at_other_inst, substring(term_program_of_study,1,2) term_program_of_study_area, num_credits_earned/nullif(num_credits_attempted,0) frac_credits_earned,
    CASE WHEN num_credits_attempted>=12 THEN 'FULL-TIME' ELSE 'PART-TIME' END student_term_enrollment_intensity FROM st0 s JOIN people p USING (student_id)),
st2 AS (SELECT *, coalesce(first_year_to_certificate_at_cohort_inst<year_of_enrollment_at_cohort_inst,false) OR coalesce(years_to_latest_certificate_at_cohort_inst<year_of_enrollment_at_cohort_inst,false) student_earned_certificate_at_cohort_inst,
    coalesce(years_to_latest_certificate_at_other_inst<year_of_enrollment_at_cohort_inst,false) student_earned_certificate_at_other_inst,
    CAST(len(list_filter(areas, lambda x: x=term_program_of_study_area)) AS INT) num_courses_in_term_program_of_study_area,
    num_courses_passed/num_courses frac_courses_passed, num_courses_completed/num_courses frac_courses_completed, sections_num_students_passed/sections_num_students_enrolled frac_sections_students_passed, sections_num_students_completed/sections_num_students_enrolled frac_sections_students_completed FROM st1),
st AS (SELECT *, coalesce(frac_courses_passed>frac_sections_students_passed,false) student_pass_rate_above_sections_avg, coalesce(frac_courses_completed>frac_sections_students_completed,false) student_completion_rate_above_sections_avg,
    coalesce(lag(term_program_of_study) OVER h<>term_program_of_study,false) term_program_of_study_changed_prev_term FROM st2 WINDOW h AS (PARTITION BY student_id ORDER BY term_rank)),
cum0 AS (SELECT *, count(term_id) OVER w cumnum_terms_enrolled, CAST(sum(term_is_core::INT) OVER w AS BIGINT) cumnum_core_terms_enrolled, CAST(sum(term_is_noncore::INT) OVER w AS BIGINT) cumnum_noncore_terms_enrolled,
    avg(course_grade_numeric_mean) OVER w cummean_course_grade_numeric_mean, min(course_grade_numeric_mean) OVER w cummin_course_grade_numeric_mean, stddev_samp(course_grade_numeric_mean) OVER w cumstd_course_grade_numeric_mean,
    CAST(sum(num_courses) OVER w AS BIGINT) cumsum_num_courses, avg(num_courses) OVER w cummean_num_courses, min(num_courses) OVER w cummin_num_courses, sum(num_credits_earned) OVER w cumsum_num_credits_earned, sum(num_credits_attempted) OVER w cumsum_num_credits_attempted,
    CAST(sum(student_pass_rate_above_sections_avg::INT) OVER w AS BIGINT) cumsum_student_pass_rate_above_sections_avg, sum(num_courses_passed) OVER w/sum(num_courses) OVER w cumfrac_num_courses_passed, sum(num_courses_course_type_cc_cd) OVER w/sum(num_courses) OVER w cumfrac_num_courses_course_type_cc_cd,
    max((num_courses_course_subject_area_24>=1)::INT) OVER w cummax_took_course_subject_area_24 FROM st WINDOW w AS (PARTITION BY student_id ORDER BY academic_year, term_ordinal ROWS UNBOUNDED PRECEDING)),
cum AS (SELECT *, bool_or(cummax_took_course_subject_area_24>=1 AND cumsum_num_credits_earned<=12) OVER (PARTITION BY student_id) cummax_in_12_creds_took_course_subject_area_24,
    CAST(cumnum_terms_enrolled/(term_rank-min(term_rank) OVER p+1) AS FLOAT) cumfrac_terms_enrolled, CAST(cumnum_core_terms_enrolled/(term_rank_core-min(term_rank_core) OVER p+1) AS FLOAT) cumfrac_core_terms_enrolled,
    num_courses-lag(num_courses) OVER o num_courses_diff_prev_term, num_credits_earned-lag(num_credits_earned) OVER o num_credits_earned_diff_prev_term
  FROM cum0 WINDOW p AS (PARTITION BY student_id), o AS (PARTITION BY student_id ORDER BY academic_year, term_ordinal)),
cumd AS (SELECT *, max(num_courses_diff_prev_term) FILTER (cumnum_terms_enrolled=2) OVER p num_courses_diff_term_1_to_term_2, max(num_credits_earned_diff_prev_term) FILTER (cumnum_terms_enrolled=4) OVER p num_credits_earned_diff_term_3_to_term_4 FROM cum WINDOW p AS (PARTITION BY student_id))"""

STUDENT_TERM_SQL = f"WITH {lens.COHORTS_SQL}, {lens.FEATURED_SQL}{_AGG} "
SECTIONED_SQL = f"WITH {lens.FEATURED_SQL} "

_WHOLE = ["academic_year", "academic_term", "term_rank", "term_is_core", "num_courses", "course_id_nunique", "num_courses_passed", "num_courses_completed", "course_subject_nunique", "course_subject_area_nunique", "sections_num_students_enrolled", "sections_num_students_passed", "sections_num_students_completed", "student_term_enrollment_intensity", "year_of_enrollment_at_cohort_inst", "term_is_pre_cohort", "cumnum_terms_enrolled", "cumnum_core_terms_enrolled", "cumsum_num_courses", "student_pass_rate_above_sections_avg", "term_program_of_study_changed_prev_term", "num_courses_grade_is_failing_or_withdrawal", "num_courses_in_term_program_of_study_area", "cummax_in_12_creds_took_course_subject_area_24"]
_FRACTIONS = ["course_level_mean", "course_grade_numeric_mean", "num_credits_attempted", "num_credits_earned", "frac_credits_earned", "frac_courses_passed", "frac_sections_students_passed", "cumsum_num_credits_earned", "cummean_course_grade_numeric_mean", "cumfrac_terms_enrolled"]


def _sql(whole: list[str], fractions: list[str], source: str, prefix: str = STUDENT_TERM_SQL, tail: str = "", places: int = 5) -> str:
    return prefix + "SELECT " + ", ".join([*whole, *(f"{r(c, places)} {c}" for c in fractions)]) + f" FROM {source} {tail}"


def _table(df: DataFrame, whole: list[str], fractions: list[str], places: int = 5) -> DataFrame:
    return rounded(df.select(*whole, *fractions), places)


_COURSE = ["student_id", "course_id", "course_subject_area", "course_passed", "course_completed", "course_level", "course_grade"]


@query(_sql(_COURSE, ["course_grade_numeric"], "featured", SECTIONED_SQL))
def course_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(courses.course_features(lens.courses(spark, sf_dir)), _COURSE, ["course_grade_numeric"])


_SECTION = ["student_id", "term_id", "course_id", "section_id", "sections_num_students_enrolled", "sections_num_students_passed", "sections_num_students_completed"]


@query(_sql(_SECTION, ["section_course_grade_numeric_mean"], "sectioned", SECTIONED_SQL))
def section_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(sectioned(spark, sf_dir), _SECTION, ["section_course_grade_numeric_mean"])


@query(SECTIONED_SQL + "SELECT * FROM terms")
def term_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_dimension(lens.courses(spark, sf_dir))


@query(SECTIONED_SQL + ", k AS (SELECT academic_year, academic_term, CAST(row_number() OVER (ORDER BY academic_year, term_ordinal)-1 AS INT) rank_summer FROM terms0 WHERE academic_term IN ('SUMMER','WINTER')) SELECT academic_year, academic_term, rank_summer, count(*) n FROM courses LEFT JOIN k USING (academic_year, academic_term) GROUP BY 1,2,3")
def term_rank_of_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = terms.term_rank(lens.courses(spark, sf_dir), ["SUMMER", "WINTER"], to="rank_summer")
    return df.groupBy("academic_year", "academic_term", "rank_summer").agg(F.count("*").alias("n"))


@query(f"WITH {lens.COHORTS_SQL}, p AS (SELECT *, cohort||' '||cohort_term cohort_id, make_date(CAST(substring(cohort,1,4) AS INT) + CASE cohort_term WHEN 'FALL' THEN 0 ELSE 1 END, CASE cohort_term WHEN 'FALL' THEN 9 WHEN 'WINTER' THEN 1 WHEN 'SPRING' THEN 2 ELSE 6 END, 1) cohort_start_dt FROM cohorts) SELECT student_id, cohort_id, cohort_start_dt, substring(program_of_study_term_1,1,2) student_program_of_study_area_term_1, program_of_study_term_1<>program_of_study_year_1 student_program_of_study_changed_term_1_to_year_1, CASE pell_status_first_year WHEN 'Y' THEN true WHEN 'N' THEN false END student_is_pell_recipient_first_year, round(gpa_group_year_1-gpa_group_term_1,6) diff_gpa_term_1_to_year_1 FROM p")
def student_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = students.student_features(lens.cohorts(spark, sf_dir))
    return rounded(df.select("student_id", "cohort_id", "cohort_start_dt", "student_program_of_study_area_term_1", "student_program_of_study_changed_term_1_to_year_1", "student_is_pell_recipient_first_year", "diff_gpa_term_1_to_year_1"))


_AGGREGATES = ["num_courses", "num_courses_course_type_cc", "num_courses_delivery_method_o", "num_courses_course_grade_a", "num_courses_course_level_2", "num_courses_core_course_y", "num_courses_course_level_0_1", "num_courses_course_type_cc_cd", "num_courses_enrolled_at_other_institution_s_y", "num_courses_course_subject_area_24", "num_courses_course_id_stan_101", "num_courses_grade_above_section_avg"]
_SPREADS = ["course_level_std", "course_grade_numeric_std", "section_num_students_enrolled_mean", "section_num_students_enrolled_std"]


@query(_sql(_KEY + _AGGREGATES, _SPREADS, "st0"))
def student_term_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.functions import names

    df = names.rename_all(student_terms.aggregate_courses(sectioned(spark, sf_dir), _KEY, lens.DUMMIES, lens.EQUAL))
    return _table(df, _KEY + _AGGREGATES, _SPREADS)


_HISTORY = ["cumnum_noncore_terms_enrolled", "cummin_num_courses", "cumsum_student_pass_rate_above_sections_avg", "num_courses_diff_prev_term", "num_courses_diff_term_1_to_term_2", "student_earned_certificate_at_cohort_inst", "student_earned_certificate_at_other_inst"]
_RUNNING = ["cumstd_course_grade_numeric_mean", "cummin_course_grade_numeric_mean", "cummean_num_courses", "cumsum_num_credits_attempted", "cumfrac_num_courses_passed", "cumfrac_num_courses_course_type_cc_cd", "cumfrac_core_terms_enrolled", "num_credits_earned_diff_prev_term", "num_credits_earned_diff_term_3_to_term_4"]


@query(_sql(_KEY + _HISTORY, _RUNNING, "cumd", places=4))
def cumulative_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(student_term(spark, sf_dir), _KEY + _HISTORY, _RUNNING, 4)


@query(
    STUDENT_TERM_SQL
    + """, e AS (SELECT student_id, term_rank, unnest(list_distinct(course_ids)) x FROM st0), f AS (SELECT student_id, term_rank, row_number() OVER (PARTITION BY student_id, x ORDER BY term_rank)=1 new FROM e),
  g AS (SELECT student_id, term_rank, count(*) FILTER (new) n, count(*) a FROM f GROUP BY 1,2) SELECT student_id, term_rank, CAST(sum(n) OVER w AS BIGINT) cumnum_unique_course_ids, CAST(sum(a) OVER w - sum(n) OVER w AS BIGINT) cumnum_repeated_course_ids FROM g WINDOW w AS (PARTITION BY student_id ORDER BY term_rank ROWS UNBOUNDED PRECEDING)"""
)
def unique_and_repeated_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return student_term(spark, sf_dir).select("student_id", "term_rank", "cumnum_unique_course_ids", "cumnum_repeated_course_ids")


_LISTED = {"ids": "course_ids", "subjects": "course_subjects", "areas": "course_subject_areas"}
_COUNTED_SQL = """, le AS (SELECT student_id, term_rank, 'ids' k, unnest(list_distinct(course_ids)) x FROM st0 UNION ALL SELECT student_id, term_rank, 'subjects', unnest(subjects) FROM st0 UNION ALL SELECT student_id, term_rank, 'areas', unnest(areas) FROM st0),
  lf AS (SELECT student_id, term_rank, k, row_number() OVER (PARTITION BY student_id, k, x ORDER BY term_rank)=1 new FROM le),
  lg AS (SELECT student_id, term_rank, """ + ", ".join(f"count(*) FILTER (k='{k}' AND new) n_{k}, count(*) FILTER (k='{k}') a_{k}" for k in _LISTED) + """ FROM lf GROUP BY 1,2),
  lists AS (SELECT student_id, term_rank, """ + ", ".join(f"CAST(sum(n_{k}) OVER w AS BIGINT) cumnum_unique_{c}, CAST(sum(a_{k}) OVER w - sum(n_{k}) OVER w AS BIGINT) cumnum_repeated_{c}" for k, c in _LISTED.items()) + """ FROM lg WINDOW w AS (PARTITION BY student_id ORDER BY term_rank ROWS UNBOUNDED PRECEDING)),
  whole AS (SELECT * FROM cumd JOIN lists USING (student_id, term_rank))"""  # fmt: skip
_ALL = list(dict.fromkeys([*_KEY, *_WHOLE, *_AGGREGATES, *_HISTORY, *(f"cumnum_{k}_{c}" for c in _LISTED.values() for k in ("unique", "repeated"))]))
_ALL_FRACTIONS = list(dict.fromkeys([*_FRACTIONS, *_SPREADS, *_RUNNING]))


@query(_sql(_ALL, _ALL_FRACTIONS, "whole", STUDENT_TERM_SQL + _COUNTED_SQL, places=4))
def student_term_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all of the student-term dataflow, every family of features among its columns."""
    return _table(student_term(spark, sf_dir), _ALL, _ALL_FRACTIONS, 4)


_CHECK = ["student_id", "term_id", "term_rank"]
_RANKED = "(SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY term_rank{d}) n FROM cum WHERE {w})"


@query(STUDENT_TERM_SQL + f"SELECT student_id, term_id, term_rank FROM {_RANKED.format(d='', w='NOT term_is_pre_cohort AND term_is_core')} WHERE n=3")
def nth_core_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints.nth_terms(student_term(spark, sf_dir), 2, noncore=False, columns=_CHECK)


@query(STUDENT_TERM_SQL + f"SELECT student_id, term_id, term_rank FROM {_RANKED.format(d='', w='true')} WHERE n=1")
def first_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints.first_terms(student_term(spark, sf_dir), columns=_CHECK)


@query(STUDENT_TERM_SQL + f"SELECT student_id, term_id, term_rank FROM {_RANKED.format(d='', w='NOT term_is_pre_cohort')} WHERE n=1")
def first_terms_in_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints.first_terms_in_cohort(student_term(spark, sf_dir), columns=_CHECK)


@query(STUDENT_TERM_SQL + f"SELECT student_id, term_id, term_rank FROM {_RANKED.format(d='', w='cumsum_num_credits_earned>=30')} WHERE n=1")
def first_terms_at_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints.first_terms_at_credits(student_term(spark, sf_dir), 30, columns=_CHECK)


@query(STUDENT_TERM_SQL + f"SELECT student_id, term_id, term_rank FROM {_RANKED.format(d=' DESC', w='true')} WHERE n=1")
def last_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints.last_terms(student_term(spark, sf_dir), columns=_CHECK)


@query(STUDENT_TERM_SQL + f"SELECT student_id, term_id, term_rank FROM {_RANKED.format(d=' DESC', w='year_of_enrollment_at_cohort_inst=2')} WHERE n=1")
def last_terms_in_second_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints.last_terms_in_enrollment_year(student_term(spark, sf_dir), 2, columns=_CHECK)


LIMITS = {"FULL-TIME": (4.0, "year"), "PART-TIME": (6.0, "year")}
_LABELABLE = """(SELECT c.student_id FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY term_rank) n FROM cum WHERE {w}) c, (SELECT max(term_rank) FILTER (term_is_core) e FROM cum) m
  WHERE n=1 AND term_rank + CASE student_term_enrollment_intensity WHEN 'FULL-TIME' THEN {f} ELSE {p} END - 1 + CASE WHEN academic_term IN ('SUMMER','WINTER') THEN 1 ELSE 0 END <= e)"""


@query(
    STUDENT_TERM_SQL
    + f"""SELECT l.student_id, a AND CASE i WHEN 'FULL-TIME' THEN coalesce(y>4,true) WHEN 'PART-TIME' THEN coalesce(y>6,true) ELSE false END target FROM {_LABELABLE.format(w="NOT term_is_pre_cohort", f=15, p=23)} l
  JOIN (SELECT student_id, bool_or(b) a, min(years_to_degree) y, CASE WHEN count(*) FILTER (b AND student_term_enrollment_intensity='FULL-TIME')=0 AND count(*) FILTER (b)=0 THEN NULL WHEN count(*) FILTER (b AND student_term_enrollment_intensity='FULL-TIME')>=count(*) FILTER (b AND student_term_enrollment_intensity='PART-TIME') THEN 'FULL-TIME' ELSE 'PART-TIME' END i
    FROM (SELECT *, coalesce(year_of_enrollment_at_cohort_inst<=years_to_degree,true) b FROM cum) GROUP BY 1) g USING (student_id)"""
)
def target_graduation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.graduation(student_term(spark, sf_dir), LIMITS)


@query(
    STUDENT_TERM_SQL
    + f""", ck AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY term_rank) n FROM cum WHERE NOT term_is_pre_cohort) WHERE n=1)
  SELECT ck.student_id, CASE ck.student_term_enrollment_intensity WHEN 'FULL-TIME' THEN coalesce(t.term_rank-ck.term_rank>7,true) ELSE coalesce(t.term_rank-ck.term_rank>11,true) END target FROM ck JOIN {_LABELABLE.format(w="NOT term_is_pre_cohort", f=7, p=11)} l USING (student_id)
  LEFT JOIN (SELECT student_id, min(term_rank) term_rank FROM cum WHERE cumsum_num_credits_earned>=60 GROUP BY 1) t ON t.student_id=ck.student_id"""
)
def target_credits_earned(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = student_term(spark, sf_dir)
    return targets.credits_earned(df, 60, {"FULL-TIME": (2.0, "year"), "PART-TIME": (3.0, "year")}, checkpoints.first_terms_in_cohort(df))


@query(STUDENT_TERM_SQL + "SELECT student_id, NOT min(retention) target FROM cum, (SELECT max(CAST(substring(term_id,1,4) AS INT)+CASE WHEN term_id LIKE '%SUMMER' THEN 1 ELSE 0 END) e FROM cum) GROUP BY student_id, e HAVING CAST(substring(min(cohort_id),1,4) AS INT)<e")
def target_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.retention(student_term(spark, sf_dir))


@query(STUDENT_TERM_SQL + "SELECT student_id, bool_or(coalesce(year_of_enrollment_at_cohort_inst>=2,false)) OR bool_or(coalesce(years_to_degree IN (1,2),false)) retention FROM cum GROUP BY 1")
def retention_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = student_term(spark, sf_dir).drop("retention")
    return targets.with_retention(df, credentials=["years_to_degree"]).select("student_id", "retention").distinct()


@query(STUDENT_TERM_SQL + "SELECT student_id, min(enrollment_type) enrollment_type, min(student_term_enrollment_intensity) student_term_enrollment_intensity FROM cum WHERE enrollment_type IN ('FIRST-TIME','TRANSFER-IN') AND student_term_enrollment_intensity='FULL-TIME' GROUP BY 1")
def select_students(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.students_with(student_term(spark, sf_dir), {"enrollment_type": ["FIRST-TIME", "TRANSFER-IN"], "student_term_enrollment_intensity": "FULL-TIME"})


@query(STUDENT_TERM_SQL + f"SELECT student_id, term_n, {r('t')} total_num_credits_earned_to_date, {r('a')} avg_num_courses_to_date, m min_num_courses_to_date, x max_num_courses_to_date FROM (SELECT student_id, CAST(row_number() OVER o AS INT) term_n, sum(num_credits_earned) OVER w t, avg(num_courses) OVER w a, min(num_courses) OVER w m, max(num_courses) OVER w x FROM st WINDOW o AS (PARTITION BY student_id ORDER BY term_rank), w AS (PARTITION BY student_id ORDER BY term_rank ROWS UNBOUNDED PRECEDING))")
def custom_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cumulative.history(student_term(spark, sf_dir), ["student_id"], ["term_rank"], ["num_credits_earned"], ["num_courses"], ["num_courses"], ["num_courses"])
    return rounded(df.select("student_id", "term_n", "total_num_credits_earned_to_date", "avg_num_courses_to_date", "min_num_courses_to_date", "max_num_courses_to_date"))


@query(STUDENT_TERM_SQL + f"SELECT student_id, term_rank, {r('(p-c)/p')} pct_terms_unenrolled FROM (SELECT student_id, term_rank, term_rank-min(term_rank) OVER w+1 p, count(*) OVER w c FROM st WINDOW w AS (PARTITION BY student_id ORDER BY term_rank ROWS UNBOUNDED PRECEDING))")
def terms_unenrolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cumulative.share_unenrolled(student_term(spark, sf_dir), ["student_id"]).select("student_id", "term_rank", "pct_terms_unenrolled"))


@query(STUDENT_TERM_SQL + f"SELECT student_id, term_rank, {r('s')} rolling_num_credits_earned_365d, n rolling_n_terms_365d, {r('s/n')} avg_num_credits_earned_365d FROM (SELECT student_id, term_rank, sum(num_credits_earned) OVER w s, count(*) OVER w n FROM st WINDOW w AS (PARTITION BY student_id ORDER BY CAST(term_start_dt AS TIMESTAMP) RANGE BETWEEN INTERVAL '364 days 23 hours 59 minutes 59 seconds' PRECEDING AND CURRENT ROW))")
def rolling_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cumulative.rolling_credits(student_term(spark, sf_dir), ["student_id"], "term_start_dt", "num_credits_earned", 365)
    return rounded(df.select("student_id", "term_rank", "rolling_num_credits_earned_365d", "rolling_n_terms_365d", "avg_num_credits_earned_365d"))


@query(STUDENT_TERM_SQL + ", f AS (SELECT student_id, term_rank, (row_number() OVER (PARTITION BY student_id, term_program_of_study ORDER BY term_rank)=1)::INT x FROM st) SELECT student_id, term_rank, CAST(sum(x) OVER (PARTITION BY student_id ORDER BY term_rank ROWS UNBOUNDED PRECEDING) AS BIGINT) n_programs FROM f")
def running_distinct_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cumulative.running_distinct(student_term(spark, sf_dir), "term_program_of_study", ["student_id"], ["term_rank"], "n_programs").select("student_id", "term_rank", "n_programs")


@query(f"WITH {lens.FEATURED_SQL} SELECT student_id, term_id, count(*) term_n_courses, count(*) FILTER (core_course='Y') term_n_courses_core_course_Y, count(*) FILTER (core_course IS NULL) term_n_courses_core_course_nan, {r('avg((core_course IS NULL)::INT)')} term_prop_courses_core_course_nan, {r('sum(number_of_credits_earned)')} term_sum_number_of_credits_earned, {r('avg(course_grade_numeric)')} term_mean_course_grade_numeric, count(DISTINCT course_id) term_nunique_course_id FROM sectioned GROUP BY 1,2")
def custom_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = student_terms.custom_roll_up(sectioned(spark, sf_dir), _KEY, {"core_course": ["Y"]}, ["number_of_credits_earned"], ["course_grade_numeric"], ["course_id"])
    return rounded(df.drop("term_prop_courses_core_course_Y"))


@query(f"WITH {lens.COURSES_SQL}, d AS (SELECT course_prefix||course_number \"key\", count(*) FILTER (grade IN ('0','F')) F, count(*) FILTER (grade='1') D, count(*) FILTER (grade='W') W, count(*) FILTER (grade='I') I, count(*) FILTER (grade IN ('2','3','4','P','W')) enrollments_den FROM courses GROUP BY 1) SELECT *, D+F+W+I dfwi_count, round((D+F+W+I)/enrollments_den,6) rate FROM d WHERE enrollments_den>=30")
def dfwi_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"D": ("1",), "F": ("0", "F"), "W": ("W",), "I": ("I",)}
    return rounded(courses.rank_dfwi(lens.courses(spark, sf_dir), kinds=kinds, completed=("2", "3", "4", "P")))


@query("WITH y AS (SELECT unnest(range(2019,2023)) y), s AS (SELECT unnest([1,2,3,4]) p) SELECT CAST(y AS INT) \"year\", ['Spring','Summer','Fall','Winter'][p] season, CAST(y*100+p AS INT) term_order, make_date(CAST(y AS INT), CASE p WHEN 1 THEN 5 WHEN 2 THEN 8 WHEN 3 THEN 12 ELSE 1 END, 31) term_end_dt, CAST(dense_rank() OVER (ORDER BY y*100+p)-1 AS INT) term_rank FROM y, s")
def terms_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.terms_lookup(spark, 2019, 2022)


@query("SELECT DISTINCT label, CAST(regexp_extract(label,'(\\d{4})') AS INT) term_year, s term_season, CAST(regexp_extract(label,'(\\d{4})') AS INT)*100+s term_order FROM (SELECT CASE month(o_orderdate)%3 WHEN 0 THEN 'Spring '||year(o_orderdate) WHEN 1 THEN CAST(year(o_orderdate) AS VARCHAR)||' Fall' ELSE 'Intersession '||year(o_orderdate) END label, CASE month(o_orderdate)%3 WHEN 0 THEN 1 WHEN 1 THEN 3 END s FROM orders) WHERE s IS NOT NULL")
def label_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, y = F.month("o_orderdate") % 3, F.year("o_orderdate").cast("string")
    label = F.when(m == 0, F.concat(F.lit("Spring "), y)).when(m == 1, F.concat(y, F.lit(" Fall"))).otherwise(F.concat(F.lit("Intersession "), y))
    return terms.label_order(lens.table(spark, sf_dir, "orders").select(label.alias("label")).distinct(), "label")


@query("WITH u AS (SELECT year(o_orderdate)*100+month(o_orderdate) term_order, o_orderstatus s FROM orders), b AS (SELECT max(l) l, min(h) h FROM (SELECT min(term_order) l, max(term_order) h FROM u WHERE s IN ('F','O') GROUP BY s)) SELECT CAST(term_order AS INT) term_order, CAST(row_number() OVER (ORDER BY term_order)-1 AS INT) term_rank, CASE WHEN term_order%2=0 THEN CAST(row_number() OVER (PARTITION BY term_order%2 ORDER BY term_order)-1 AS INT) END term_rank_core FROM (SELECT DISTINCT term_order FROM u, b WHERE s IN ('F','O') AND term_order BETWEEN l AND h)")
def align_and_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.table(spark, sf_dir, "orders").select((F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("term_order"), "o_orderstatus")
    return terms.align_and_rank({s: rows.where(F.col("o_orderstatus") == s) for s in ("F", "O")}, core=F.col("term_order") % 2 == 0)


@query(f"WITH {lens.COHORTS_SQL}, {lens.COURSES_SQL}, a AS (SELECT DISTINCT student_id FROM cohorts WHERE retention), b AS (SELECT DISTINCT student_id FROM courses WHERE grade='F') SELECT (SELECT count(*) FROM a) n_left, (SELECT count(*) FROM b) n_right, (SELECT count(*) FROM a JOIN b USING (student_id)) n_both")
def key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return students.key_overlap(lens.cohorts(spark, sf_dir).where("retention"), lens.courses(spark, sf_dir).where("grade = 'F'"))


@query(f"WITH {lens.COURSES_SQL} SELECT course_prefix||course_number||'-2' id, course_prefix||course_number catalog, (course_prefix||course_number) IN ('STAN101','PROM205') listed, count(*) n FROM courses GROUP BY 1,2,3")
def catalog_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.courses(spark, sf_dir).select(F.concat(C.course_id("course_prefix", "course_number"), F.lit("-2")).alias("id"))
    return rows.groupBy("id", C.catalog_id("id").alias("catalog"), C.in_catalog("id", ["STAN101", "PROM205"]).alias("listed")).agg(F.count("*").alias("n"))
