"""The academic lens: course and cohort tables as expressions over the driver's order tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Grades by discount in hundredths; 10 is null.
GRADES = ("0", "1", "2", "3", "4", "P", "F", "W", "I", "M")
DUMMIES = {"course_type": ["CC", "CD", "CU"], "delivery_method": ["F", "H", "O"], "math_or_english_gateway": ["E", "M", "NA"], "course_level": [1, 2, 3, 4], "course_grade": ["A", "B", "C", "D", "F", "I", "M", "P", "W"]}
EQUAL = [("core_course", "Y"), ("course_level", [0, 1]), ("course_type", ["CC", "CD"]), ("enrolled_at_other_institution_s", "Y"), ("course_subject_area", "24"), ("course_id", "STAN101")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _term(date: str) -> F.Column:
    m = F.month(date)
    return F.when(m >= 9, "FALL").when(m == 1, "WINTER").when(m <= 5, "SPRING").otherwise("SUMMER")


def _year(date: str) -> F.Column:
    y = F.year(date) - F.when(F.month(date) < 9, 1).otherwise(0)
    return F.concat(y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a lineitem: the course that a student (customer) took in the term of the order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    rows = items.join(orders, items.l_orderkey == orders.o_orderkey).join(parts, items.l_partkey == parts.p_partkey)
    grade = F.round(F.col("l_discount") * 100).cast("int")
    q = F.col("l_quantity").cast("int")
    return rows.select(
        F.col("o_custkey").cast("string").alias("student_id"),
        F.lit("INST").alias("institution_id"),
        _year("o_orderdate").alias("academic_year"),
        _term("o_orderdate").alias("academic_term"),
        F.upper(F.substring(F.split_part("p_type", F.lit(" "), F.lit(1)), 1, 4)).alias("course_prefix"),
        (100 * (1 + F.col("l_partkey") % 4) + F.col("l_partkey") % 10).cast("string").alias("course_number"),
        (F.col("l_suppkey") % 3).cast("string").alias("section_id"),
        F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("."), F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0")).alias("course_cip"),
        F.get(F.array(*map(F.lit, GRADES)), grade).alias("grade"),
        F.col("l_linenumber").cast("double").alias("number_of_credits_attempted"),
        F.when(grade.isin(1, 2, 3, 4, 5), F.col("l_linenumber").cast("double")).otherwise(0.0).alias("number_of_credits_earned"),
        F.when(F.col("l_returnflag") == "A", "F").when(F.col("l_returnflag") == "N", "O").otherwise("H").alias("delivery_method"),
        F.when(F.col("l_linestatus") == "F", "CU").when(q % 5 == 0, "CD").otherwise("CC").alias("course_type"),
        F.when(q % 17 == 0, None).when(q % 3 == 0, "Y").otherwise("N").alias("core_course"),
        F.when(F.col("l_partkey") % 7 == 0, "M").when(F.col("l_partkey") % 7 == 1, "E").otherwise("NA").alias("math_or_english_gateway"),
        F.when(F.round(F.col("l_tax") * 100).cast("int") >= 7, "Y").otherwise("N").alias("enrolled_at_other_institution_s"),
        F.concat(F.lpad((10 + (F.col("o_custkey") + F.year("o_orderdate")) % 40).cast("string"), 2, "0"), F.lit(".0101")).alias("term_program_of_study"),
        F.col("o_orderdate").cast("date").alias("course_begin_date"),
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of all orders; each has courses."""
    return table(spark, sf_dir, "orders").select(_year("o_orderdate").alias("academic_year"), _term("o_orderdate").alias("academic_term")).distinct()


def cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a customer with orders: the student's cohort is the term of the first order."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("first"))
    rows = table(spark, sf_dir, "customer").join(first, "c_custkey")
    key = F.col("c_custkey")
    year = lambda n: F.when(key % n != 0, (key % n).cast("int"))
    return rows.select(
        key.cast("string").alias("student_id"),
        F.lit("INST").alias("institution_id"),
        _year("first").alias("cohort"),
        _term("first").alias("cohort_term"),
        F.when(F.col("c_mktsegment") == "BUILDING", "TRANSFER-IN").when(F.col("c_mktsegment") == "MACHINERY", "RE-ADMIT").when((F.col("c_mktsegment") == "HOUSEHOLD") & (key % 5 == 0), "DE").otherwise("FIRST-TIME").alias("enrollment_type"),
        F.when(key % 3 == 0, "PART-TIME").otherwise("FULL-TIME").alias("enrollment_intensity_first_term"),
        F.when(key % 11 == 0, None).when(F.col("c_acctbal") < 0, "Y").otherwise("N").alias("pell_status_first_year"),
        F.when(key % 13 != 0, (key % 41) / 10).alias("gpa_group_term_1"),
        F.when(key % 17 != 0, (key % 37) / 10).alias("gpa_group_year_1"),
        year(8).alias("years_to_degree"),
        year(6).alias("first_year_to_certificate_at_cohort_inst"),
        year(9).alias("years_to_latest_certificate_at_cohort_inst"),
        year(10).alias("years_to_latest_certificate_at_other_inst"),
        (key % 3 != 1).alias("retention"),
        (key % 4 != 1).alias("persistence"),
        F.concat(F.lpad((10 + key % 40).cast("string"), 2, "0"), F.lit(".0101")).alias("program_of_study_term_1"),
        F.concat(F.lpad((10 + key % 20).cast("string"), 2, "0"), F.lit(".0101")).alias("program_of_study_year_1"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
        F.when(key % 19 == 0, None).otherwise(F.concat(F.lit("R"), (key % 5).cast("string"))).alias("race"),
        F.when(key % 3 == 0, "20 AND YOUNGER").when(key % 3 == 1, ">20 - 24").otherwise("OLDER THAN 24").alias("student_age"),
    )


_TERM_SQL = "CASE WHEN month({0})>=9 THEN 'FALL' WHEN month({0})=1 THEN 'WINTER' WHEN month({0})<=5 THEN 'SPRING' ELSE 'SUMMER' END"
_START_SQL = "(year({0}) - CASE WHEN month({0})<9 THEN 1 ELSE 0 END)"
_YEAR_SQL = f"CAST({_START_SQL} AS VARCHAR) || '-' || lpad(CAST(({_START_SQL}+1)%100 AS VARCHAR),2,'0')"

COURSES_SQL = f"""courses AS (
  SELECT CAST(o_custkey AS VARCHAR) student_id, 'INST' institution_id, {_YEAR_SQL.format("o_orderdate")} academic_year, {_TERM_SQL.format("o_orderdate")} academic_term,
    upper(substring(split_part(p_type,' ',1),1,4)) course_prefix, CAST(100*(1+l_partkey%4)+l_partkey%10 AS VARCHAR) course_number, CAST(l_suppkey%3 AS VARCHAR) section_id,
    lpad(CAST(p_size AS VARCHAR),2,'0') || '.' || lpad(CAST(l_partkey%100 AS VARCHAR),2,'0') course_cip,
    ['0','1','2','3','4','P','F','W','I','M'][CAST(round(l_discount*100) AS INT)+1] grade,
    CAST(l_linenumber AS DOUBLE) number_of_credits_attempted, CASE WHEN CAST(round(l_discount*100) AS INT) IN (1,2,3,4,5) THEN CAST(l_linenumber AS DOUBLE) ELSE 0.0 END number_of_credits_earned,
    CASE l_returnflag WHEN 'A' THEN 'F' WHEN 'N' THEN 'O' ELSE 'H' END delivery_method,
    CASE WHEN l_linestatus='F' THEN 'CU' WHEN CAST(l_quantity AS INT)%5=0 THEN 'CD' ELSE 'CC' END course_type,
    CASE WHEN CAST(l_quantity AS INT)%17=0 THEN NULL WHEN CAST(l_quantity AS INT)%3=0 THEN 'Y' ELSE 'N' END core_course,
    CASE l_partkey%7 WHEN 0 THEN 'M' WHEN 1 THEN 'E' ELSE 'NA' END math_or_english_gateway,
    CASE WHEN CAST(round(l_tax*100) AS INT)>=7 THEN 'Y' ELSE 'N' END enrolled_at_other_institution_s,
    lpad(CAST(10+(o_custkey+year(o_orderdate))%40 AS VARCHAR),2,'0') || '.0101' term_program_of_study, CAST(o_orderdate AS DATE) course_begin_date
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey)"""

COHORTS_SQL = f"""cohorts AS (
  SELECT CAST(c_custkey AS VARCHAR) student_id, 'INST' institution_id, {_YEAR_SQL.format("first")} cohort, {_TERM_SQL.format("first")} cohort_term,
    CASE WHEN c_mktsegment='BUILDING' THEN 'TRANSFER-IN' WHEN c_mktsegment='MACHINERY' THEN 'RE-ADMIT' WHEN c_mktsegment='HOUSEHOLD' AND c_custkey%5=0 THEN 'DE' ELSE 'FIRST-TIME' END enrollment_type,
    CASE WHEN c_custkey%3=0 THEN 'PART-TIME' ELSE 'FULL-TIME' END enrollment_intensity_first_term,
    CASE WHEN c_custkey%11=0 THEN NULL WHEN c_acctbal<0 THEN 'Y' ELSE 'N' END pell_status_first_year,
    CASE WHEN c_custkey%13<>0 THEN (c_custkey%41)/10 END gpa_group_term_1, CASE WHEN c_custkey%17<>0 THEN (c_custkey%37)/10 END gpa_group_year_1,
    CAST(nullif(c_custkey%8,0) AS INT) years_to_degree, CAST(nullif(c_custkey%6,0) AS INT) first_year_to_certificate_at_cohort_inst,
    CAST(nullif(c_custkey%9,0) AS INT) years_to_latest_certificate_at_cohort_inst, CAST(nullif(c_custkey%10,0) AS INT) years_to_latest_certificate_at_other_inst,
    c_custkey%3<>1 retention, c_custkey%4<>1 persistence,
    lpad(CAST(10+c_custkey%40 AS VARCHAR),2,'0') || '.0101' program_of_study_term_1, lpad(CAST(10+c_custkey%20 AS VARCHAR),2,'0') || '.0101' program_of_study_year_1,
    CASE WHEN c_custkey%2=0 THEN 'F' ELSE 'M' END gender, CASE WHEN c_custkey%19=0 THEN NULL ELSE 'R'||CAST(c_custkey%5 AS VARCHAR) END race,
    CASE c_custkey%3 WHEN 0 THEN '20 AND YOUNGER' WHEN 1 THEN '>20 - 24' ELSE 'OLDER THAN 24' END student_age
  FROM customer JOIN (SELECT o_custkey, min(o_orderdate) first FROM orders GROUP BY 1) ON c_custkey=o_custkey)"""

#: Course rows with the features of courses; later steps build on it.
FEATURED_SQL = (
    COURSES_SQL
    + """,
featured AS (
  SELECT *, course_prefix||course_number course_id, nullif(trim(regexp_extract(course_cip,'^(\\d[\\d.])[\\d.]+$',1),'.'),'') course_subject_area,
    CASE WHEN grade IN ('W','I','M') THEN NULL WHEN grade='P' THEN true WHEN grade='F' THEN false ELSE TRY_CAST(grade AS DOUBLE)>=1.0 END course_passed,
    coalesce(grade NOT IN ('I','W'),true) course_completed, CAST(substring(course_number,1,1) AS INT) course_level, TRY_CAST(grade AS DOUBLE) course_grade_numeric,
    CASE WHEN grade IN ('P','F','W','I','M') THEN grade WHEN grade='0' THEN 'F' WHEN grade='1' THEN 'D' WHEN grade='2' THEN 'C' WHEN grade='3' THEN 'B' WHEN grade='4' THEN 'A' END course_grade
  FROM courses),
terms0 AS (SELECT DISTINCT academic_year, academic_term, CASE academic_term WHEN 'FALL' THEN 0 WHEN 'WINTER' THEN 1 WHEN 'SPRING' THEN 2 ELSE 3 END term_ordinal FROM courses),
terms AS (SELECT *, academic_year||' '||academic_term term_id,
    make_date(CAST(substring(academic_year,1,4) AS INT) + CASE academic_term WHEN 'FALL' THEN 0 ELSE 1 END, CASE academic_term WHEN 'FALL' THEN 9 WHEN 'WINTER' THEN 1 WHEN 'SPRING' THEN 2 ELSE 6 END, 1) term_start_dt,
    CAST(row_number() OVER (ORDER BY academic_year, term_ordinal)-1 AS INT) term_rank,
    CASE WHEN academic_term IN ('FALL','SPRING') THEN CAST(row_number() OVER (PARTITION BY academic_term IN ('FALL','SPRING') ORDER BY academic_year, term_ordinal)-1 AS INT) END term_rank_core,
    CASE WHEN academic_term NOT IN ('FALL','SPRING') THEN CAST(row_number() OVER (PARTITION BY academic_term IN ('FALL','SPRING') ORDER BY academic_year, term_ordinal)-1 AS INT) END term_rank_noncore,
    academic_term IN ('FALL','SPRING') term_is_core, academic_term NOT IN ('FALL','SPRING') term_is_noncore,
    (academic_year='2019-20' AND academic_term IN ('SPRING','SUMMER')) OR academic_year='2020-21' term_in_peak_covid FROM terms0),
sectioned AS (
  SELECT f.*, t.* EXCLUDE (academic_year, academic_term), count(*) OVER w sections_num_students_enrolled, CAST(coalesce(sum(course_passed::INT) OVER w,0) AS BIGINT) sections_num_students_passed,
    CAST(coalesce(sum(course_completed::INT) OVER w,0) AS BIGINT) sections_num_students_completed, avg(course_grade_numeric) OVER w section_course_grade_numeric_mean
  FROM featured f JOIN terms t USING (academic_year, academic_term) WINDOW w AS (PARTITION BY t.term_id, course_id, section_id))"""
)
