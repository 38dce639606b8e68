"""Queries over selection, cleaning, duplicates, reports and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions import columns as C
from termweave.operators import cleaning, duplicates, eda, profiling, selection

from . import lens
from .registry import query, r, rounded

_CO, _CU = lens.COHORTS_SQL, lens.COURSES_SQL


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.courses(spark, sf_dir).join(lens.cohorts(spark, sf_dir).drop("institution_id"), "student_id")


# --- selection -------------------------------------------------------------------------------------------------------


@query(f"WITH {_CO} SELECT student_id, enrollment_type FROM cohorts WHERE enrollment_type NOT IN ('DE','DS','SE')")
def without_dual_enrolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.drop_dual_enrolled(lens.cohorts(spark, sf_dir)).select("student_id", "enrollment_type")


@query(f"WITH {_CO} SELECT student_id, cohort, cohort_term FROM cohorts WHERE lower(cohort_term||' '||cohort) IN ('fall 1995-96','spring 1994-95')")
def cohort_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.with_labels(lens.cohorts(spark, sf_dir), "cohort_term", "cohort", ["Fall 1995-96", " SPRING  1994-95"]).select("student_id", "cohort", "cohort_term")


@query(f"WITH {_CO} SELECT student_id, cohort, cohort_term FROM cohorts WHERE NOT lower(cohort_term||' '||cohort) IN ('spring 1994-95')")
def without_training_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.without_cohorts(lens.cohorts(spark, sf_dir), ["spring 1994-95"]).select("student_id", "cohort", "cohort_term")


@query(f"WITH {_CU} SELECT student_id, course_id, grade FROM (SELECT *, course_prefix||course_number course_id FROM courses) c WHERE NOT EXISTS (SELECT 1 FROM courses d WHERE d.student_id=c.student_id AND d.grade='W')")
def without_students_who_withdrew(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lens.courses(spark, sf_dir).withColumn("course_id", C.course_id("course_prefix", "course_number"))
    return selection.drop_readmits(df, c="grade", value="W").select("student_id", "course_id", "grade")


@query("SELECT student_id, cohort, cohort_term, CAST(o_orderkey AS BIGINT) o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY CAST(substring(cohort,1,4) AS INT)*10 + CASE cohort_term WHEN 'FALL' THEN 0 WHEN 'WINTER' THEN 1 WHEN 'SPRING' THEN 2 ELSE 3 END, o_orderkey) n FROM (SELECT CAST(o_custkey AS VARCHAR) student_id, o_orderkey, " + lens._YEAR_SQL.format("o_orderdate") + " cohort, " + lens._TERM_SQL.format("o_orderdate") + " cohort_term FROM orders)) WHERE n=1")
def earliest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("student_id"), "o_orderkey", lens._year("o_orderdate").alias("cohort"), lens._term("o_orderdate").alias("cohort_term"))
    return selection.earliest_record(rows, ties=["o_orderkey"]).select("student_id", "cohort", "cohort_term", "o_orderkey")


_JOIN = f"WITH {_CO}, {_CU}, j AS (SELECT * FROM courses JOIN (SELECT * EXCLUDE (institution_id) FROM cohorts) USING (student_id))"


@query(_JOIN + ", s AS (SELECT student_id, count(*) FILTER (academic_year<'1997-98') n, bool_and(academic_year<'1997-98') o, bool_or(academic_year<'1997-98') a FROM j GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) n_rows, count(*) FILTER (a) n_students, count(*) FILTER (o) n_only FROM s")
def pre_cohort_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.pre_cohort_report(_joined(spark, sf_dir).withColumn("cohort", F.lit("1997-98")))


@query(_JOIN + " SELECT academic_year, academic_term, count(*) n FROM j WHERE academic_year>=cohort AND cohort>='1995-96' GROUP BY 1,2")
def since_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.since_cohort(_joined(spark, sf_dir).where("cohort >= '1995-96'")).groupBy("academic_year", "academic_term").agg(F.count("*").alias("n"))


@query(f"WITH {_CU}, x AS (SELECT academic_year, academic_term, CASE WHEN academic_term='WINTER' AND academic_year<'1998-99' THEN NULL ELSE course_prefix END p FROM courses) SELECT DISTINCT academic_year, academic_term FROM x WHERE (academic_year, academic_term) NOT IN (SELECT (academic_year, academic_term) FROM x WHERE p IS NOT NULL)")
def terms_without_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = (F.col("academic_term") == "WINTER") & (F.col("academic_year") < "1998-99")
    return selection.terms_lost(lens.courses(spark, sf_dir).withColumn("course_prefix", F.when(~lost, F.col("course_prefix"))))


@query("SELECT c_mktsegment, contains(c_mktsegment,'HO') h, c_mktsegment='BUILDING' e, starts_with(c_mktsegment,'M') s, c_mktsegment IN ('AUTOMOBILE','FURNITURE') i, count(*) n FROM customer GROUP BY ALL")
def filter_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = selection.filter_mask
    c = "c_mktsegment"
    return lens.table(spark, sf_dir, "customer").groupBy(c, m(c, "contains", "HO").alias("h"), m(c, "equals", "BUILDING").alias("e"), m(c, "startswith", "M").alias("s"), m(c, "isin", ["AUTOMOBILE", "FURNITURE"]).alias("i")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT (lower(o_orderpriority) LIKE '1-%' OR lower(o_orderpriority) LIKE '5-l%')")
def without_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.without_prefixes(lens.table(spark, sf_dir, "orders"), "o_orderpriority", ["1-", "5-L"]).select("o_orderkey", "o_orderpriority")


# --- duplicates ------------------------------------------------------------------------------------------------------

_ITEM = ["l_orderkey", "l_linenumber"]


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.table(spark, sf_dir, "lineitem").select(*_ITEM, "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", F.col("l_linenumber").cast("string").alias("number"))


@query("SELECT l_orderkey, l_linenumber, count(*) n, bool_or(d) must_suffix FROM (SELECT *, min(l_returnflag) OVER w<>max(l_returnflag) OVER w d FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber)) GROUP BY 1,2")
def duplicate_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.classify(_items(spark, sf_dir), _ITEM, ["l_returnflag"]).groupBy(*_ITEM).agg(F.max("group_size").alias("n"), F.max("must_suffix").alias("must_suffix"))


@query("SELECT l_orderkey, l_partkey, l_quantity, CASE WHEN n>0 THEN l_linenumber||'-'||n ELSE CAST(l_linenumber AS VARCHAR) END number FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC)-1 n FROM lineitem)")
def suffix_after_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.suffix_after_first(_items(spark, sf_dir), _ITEM, "number", ["l_partkey", "l_suppkey", "l_quantity"]).select("l_orderkey", "l_partkey", "l_quantity", "number")


@query("SELECT l_orderkey, l_partkey, l_quantity, CASE WHEN k>1 THEN l_linenumber||'-'||n ELSE CAST(l_linenumber AS VARCHAR) END number FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) n, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) k FROM lineitem)")
def suffix_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.suffix_all(_items(spark, sf_dir), _ITEM, "number", ["l_partkey", "l_suppkey", "l_quantity"]).select("l_orderkey", "l_partkey", "l_quantity", "number")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) n FROM lineitem) WHERE n=1")
def keep_first_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.keep_one(_items(spark, sf_dir), _ITEM, ["l_partkey", "l_suppkey", "l_quantity"]).select(*_ITEM, "l_partkey", "l_suppkey", "l_quantity")


@query("SELECT l_orderkey, l_partkey, l_quantity, CASE WHEN d AND n>0 THEN l_linenumber||'-'||n ELSE CAST(l_linenumber AS VARCHAR) END number FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC)-1 n, min(l_returnflag) OVER w<>max(l_returnflag) OVER w d FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber)) WHERE d OR n=0")
def resolve_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.resolve_courses(_items(spark, sf_dir), _ITEM, ["l_returnflag"], "number", ["l_partkey", "l_suppkey", "l_quantity"]).select("l_orderkey", "l_partkey", "l_quantity", "number")


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN lower(o_orderpriority)='2-high' THEN 1 WHEN contains(lower(o_orderpriority),'urgent') THEN 0 WHEN contains(lower(o_orderpriority),'medium') THEN 2 ELSE 3 END, o_orderkey) n FROM orders) WHERE n=1")
def categorical_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.by_priority(lens.table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", ["urgent", "2-HIGH", "medium"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("WITH g AS (SELECT count(DISTINCT l_returnflag) a, count(DISTINCT l_partkey) b FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*)>1) SELECT 'l_returnflag' \"column\", round(100*avg((a>1)::INT),4) pct FROM g UNION ALL SELECT 'l_partkey', round(100*avg((b>1)::INT),4) FROM g")
def duplicate_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.conflicts(_items(spark, sf_dir), _ITEM, ["l_returnflag", "l_partkey"])


@query("SELECT n, count(*) num_groups FROM (SELECT count(*) n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*)>1) GROUP BY 1")
def duplicate_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.group_sizes(_items(spark, sf_dir), _ITEM)


@query("SELECT count(*) rows_before, count(DISTINCT (l_orderkey, l_linenumber)) rows_after, count(*)-count(DISTINCT (l_orderkey, l_linenumber)) rows_dropped FROM lineitem")
def duplicate_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.impact(_items(spark, sf_dir), _ITEM)


# --- cleaning --------------------------------------------------------------------------------------------------------


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as an all-text table with null tokens and mixed spellings."""
    k = F.col("c_custkey")
    return lens.table(spark, sf_dir, "customer").select(
        k.cast("string").alias("Student ID"),
        F.when(k % 5 == 0, " n/a ").when(k % 7 == 0, "").otherwise(F.col("c_mktsegment")).alias("Segment Name"),
        F.round("c_acctbal", 2).cast("string").alias("acctBalance"),
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 900).cast("int")), "yyyyMMdd").alias("entryDate"),
        F.when(k % 2 == 0, "Yes").otherwise("no").alias("isActive"),
    )


@query("SELECT * FROM (VALUES ('student_id','bigint'),('segment_name','string'),('acct_balance','double'),('entry_date','date'),('is_active','boolean')) t(\"column\", dtype)")
def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.functions import names

    return cleaning.inferred_types(names.rename_all(_raw(spark, sf_dir)))


@query("SELECT c_custkey student_id, CASE WHEN c_custkey%5=0 OR c_custkey%7=0 THEN NULL ELSE c_mktsegment END segment_name, round(c_acctbal,2) acct_balance, CAST(DATE '2020-01-01'+CAST(c_custkey%900 AS INT) AS DATE) entry_date, c_custkey%2=0 is_active FROM customer")
def clean_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return cleaning.clean(raw.unionAll(raw), ["student_id"], types={"student_id": "bigint", "acct_balance": "double", "entry_date": "date", "is_active": "boolean"})


@query("SELECT 'not_null' \"check\", 'segment_name' \"column\", count(*) FILTER (c_custkey%5=0 OR c_custkey%7=0) n_failures FROM customer UNION ALL SELECT 'unique','segment_name', (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) n FROM customer GROUP BY CASE WHEN c_custkey%5=0 OR c_custkey%7=0 THEN NULL ELSE c_mktsegment END HAVING count(*)>1))")
def contract_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cleaning.clean(_raw(spark, sf_dir))
    return cleaning.contract_faults(df, {"columns": [{"name": "segment_name", "dtype": "string", "non_null": True}], "keys": ["segment_name"]})


@query(f"""WITH {_CU}, x AS (SELECT *, number_of_credits_attempted-2 a FROM courses)
  SELECT 'in_range' "check", 'number_of_credits_attempted' "column", count(*) FILTER (NOT a BETWEEN 0 AND 20) n_failures FROM x UNION ALL SELECT 'in_range','number_of_credits_earned',0 UNION ALL SELECT 'earned_le_attempted','number_of_credits_earned', count(*) FILTER (number_of_credits_earned>a) FROM x
  UNION ALL SELECT 'is_in','academic_term',0 UNION ALL SELECT 'matches','academic_year',0 UNION ALL SELECT 'valid_grade','grade',0""")
def course_check_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lens.courses(spark, sf_dir).withColumn("number_of_credits_attempted", F.col("number_of_credits_attempted") - 2)
    return cleaning.failures(df, cleaning.course_checks())


@query(f"WITH {_CU} SELECT 'earned_le_attempted' \"check\", student_id, count(*) n FROM courses WHERE number_of_credits_earned>number_of_credits_attempted-2 GROUP BY 2 UNION ALL SELECT 'in_range', student_id, count(*) FROM courses WHERE number_of_credits_attempted<2 GROUP BY 2")
def course_failure_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lens.courses(spark, sf_dir).withColumn("number_of_credits_attempted", F.col("number_of_credits_attempted") - 2)
    return cleaning.failure_cases(df, cleaning.course_checks(), ["student_id"]).groupBy("check", "student_id").agg(F.count("*").alias("n"))


# --- reports ---------------------------------------------------------------------------------------------------------


@query("SELECT 'c_custkey' \"column\", count(DISTINCT c_custkey) n_unique, 0 n_null, count(DISTINCT c_custkey)=count(*) is_unique FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), 0, false FROM customer UNION ALL SELECT 'n', count(DISTINCT nullif(c_nationkey,3)), count(*) FILTER (c_nationkey=3), false FROM customer")
def column_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lens.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("n"))
    return eda.column_uniqueness(df)


_STATS = "SELECT '{0}' \"column\", count({0}) n, count(*)-count({0}) null_count, round(100.0*(count(*)-count({0}))/count(*),1) null_pct, round(avg({0}),6) mean, round(stddev_samp({0}),6) std, min({0}) min, round(quantile_cont({0},0.25),6) q1, round(median({0}),6) median, round(quantile_cont({0},0.75),6) q3, max({0}) max FROM cohorts"


@query(f"WITH {_CO} {_STATS.format('gpa_group_term_1')} UNION ALL {_STATS.format('gpa_group_year_1')}")
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.summary_stats(lens.cohorts(spark, sf_dir), ["gpa_group_term_1", "gpa_group_year_1"]))


@query(f"WITH {_CO} SELECT race, pell_status_first_year, count(*) n, round(100.0*count(*)/sum(count(*)) OVER (),1) pct FROM cohorts GROUP BY 1,2")
def group_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.group_shares(lens.cohorts(spark, sf_dir), ["race", "pell_status_first_year"])


@query(f"WITH {_CO} SELECT CASE WHEN grouping(gender)=1 THEN 'All' ELSE coalesce(gender,'null') END a, CASE WHEN grouping(race)=1 THEN 'All' ELSE coalesce(race,'null') END b, count(*) n FROM cohorts GROUP BY CUBE(gender, race)")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.crosstab(lens.cohorts(spark, sf_dir), "gender", "race")


@query(f"WITH {_CO} SELECT * FROM (SELECT unnest(['years_to_degree','race','pell_status_first_year']) \"column\", unnest([round(avg((years_to_degree IS NULL)::INT),6), round(avg((race IS NULL)::INT),6), round(avg((pell_status_first_year IS NULL)::INT),6)]) null_share FROM cohorts) WHERE null_share>0.08")
def high_null_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.high_null_columns(lens.cohorts(spark, sf_dir).select("years_to_degree", "race", "pell_status_first_year"), 0.08))


@query(f"WITH {lens.FEATURED_SQL} SELECT course_id, course_subject_area, math_or_english_gateway gateway, count(*) n, bool_or(course_level>=2) upper_level FROM featured WHERE math_or_english_gateway IN ('M','E') GROUP BY 1,2,3")
def gateway_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.gateway_courses(lens.courses(spark, sf_dir))


@query(f"WITH {_CO}, {_CU}, a AS (SELECT DISTINCT student_id FROM cohorts WHERE retention), b AS (SELECT DISTINCT student_id FROM courses WHERE grade='W') SELECT CASE WHEN b.student_id IS NULL THEN 'left_only' WHEN a.student_id IS NULL THEN 'right_only' ELSE 'both' END side, count(*) n_keys FROM a FULL JOIN b USING (student_id) GROUP BY 1")
def misjoined_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.misjoined(lens.cohorts(spark, sf_dir).where("retention"), lens.courses(spark, sf_dir).where("grade = 'W'"), "student_id")


@query(f"WITH {_CO} SELECT DISTINCT race, gender FROM cohorts EXCEPT SELECT DISTINCT race, gender FROM cohorts WHERE student_age='OLDER THAN 24' AND enrollment_type='TRANSFER-IN'")
def keys_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lens.cohorts(spark, sf_dir)
    return eda.not_in(df, df.where("student_age = 'OLDER THAN 24' AND enrollment_type = 'TRANSFER-IN'"), ["race", "gender"])


@query(f"WITH {_CU}, x AS (SELECT number_of_credits_earned e, number_of_credits_attempted-2 a FROM courses) SELECT count(*) n, count(*) FILTER (e>a) n_more, count(*) FILTER (a=0 AND e>0) n_of_nothing, round(100*avg((e>a)::INT),4) pct_more, round(100*avg((a=0 AND e>0)::INT),4) pct_of_nothing FROM x")
def earned_over_attempted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.earned_over_attempted(lens.courses(spark, sf_dir).withColumn("number_of_credits_attempted", F.col("number_of_credits_attempted") - 2))


_GAPS = "count(*) FILTER (NOT match_{0}) {0}_mismatches, count(*) FILTER (diff_{0}<0) {0}_terms_above, count(*) FILTER (diff_{0}>0) {0}_courses_above, round(median(abs(diff_{0})),6) {0}_median_gap, round(quantile_cont(abs(diff_{0}),0.9),6) {0}_p90_gap, max(abs(diff_{0})) {0}_max_gap"
#: Orders as terms that report credits; the courses of some are missing, and some reports are null.
_REPORTED = f"""t AS (SELECT o_orderkey, CASE WHEN o_orderpriority='5-LOW' THEN NULL ELSE round(o_totalprice/100,0) END ra, round(o_totalprice/100,0)-10 re FROM orders), s AS (SELECT l_orderkey, sum(l_quantity) a, coalesce(sum(CASE WHEN l_linestatus='F' THEN l_quantity END),0) e FROM lineitem WHERE l_returnflag<>'A' GROUP BY 1),
  d0 AS (SELECT *, a-ra diff_attempted, e-re diff_earned FROM t LEFT JOIN s ON o_orderkey=l_orderkey), d AS (SELECT *, coalesce(abs(diff_attempted)<=50,false) match_attempted, coalesce(abs(diff_earned)<=50,false) match_earned FROM d0)"""


def _terms_and_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = lens.table(spark, sf_dir, "lineitem").where("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("double").alias("number_of_credits_attempted"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("double")).alias("number_of_credits_earned"))
    said = F.round(F.col("o_totalprice") / 100, 0)
    terms = lens.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", said).alias("number_of_semester_credits_attempted"), (said - 10).alias("number_of_semester_credits_earned"))
    return eda.reconciled_terms(items, terms, ["o_orderkey"], tolerance=50.0)


@query(f"WITH {_REPORTED} SELECT count(*) total_semester_rows, count(*) FILTER (NOT match_attempted OR NOT match_earned) mismatched_rows, round(100*avg((NOT match_attempted OR NOT match_earned)::INT),2) pct_of_data, count(*) FILTER (a IS NULL) rows_without_courses, {_GAPS.format('attempted')}, {_GAPS.format('earned')} FROM d")
def credit_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.reconciliation(_terms_and_courses(spark, sf_dir)))


@query(f"WITH {_REPORTED} SELECT o_orderkey, a IS NOT NULL has_course_rows, round(diff_attempted,6) diff_attempted, match_attempted, round(diff_earned,6) diff_earned, match_earned FROM d")
def reconciled_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_terms_and_courses(spark, sf_dir).select("o_orderkey", "has_course_rows", "diff_attempted", "match_attempted", "diff_earned", "match_earned"))


@query(f"WITH {_CU}, x AS (SELECT number_of_credits_attempted-2 a, number_of_credits_earned e FROM courses) SELECT count(*) rows_checked, count(*) FILTER (e-a>0 OR a<0 OR e<0) rows_with_anomalies, round(100.0*count(*) FILTER (e-a>0 OR a<0 OR e<0)/count(*),2) pct_of_data FROM x")
def course_credit_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lens.courses(spark, sf_dir).withColumn("number_of_credits_attempted", F.col("number_of_credits_attempted") - 2)
    return eda.share_of_rows(eda.course_credit_anomalies(df), df)


@query(f"""WITH {_CU}, x AS (SELECT CASE WHEN grade IN ('P','A','B','C','D') THEN true WHEN grade IN ('F','W','I') THEN false END g, CASE section_id WHEN '1' THEN true WHEN '2' THEN false END p, CASE WHEN section_id='2' AND delivery_method='O' THEN NULL ELSE number_of_credits_earned END e FROM courses),
  z AS (SELECT coalesce(NOT p AND e>0,false) a, coalesce(p AND e=0,false) b, coalesce(g<>p,false) c FROM x) SELECT {', '.join(f"count(*) FILTER ({k}) {n}, round(100*avg(({k})::INT),2) {n}_pct" for k, n in (('a', 'earned_with_failing_grade'), ('b', 'no_credits_with_passing_grade'), ('c', 'grade_pf_disagree'), ('a OR b OR c', 'total_anomalous_rows')))} FROM z""")
def pass_fail_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lens.courses(spark, sf_dir)
    flag = F.when(F.col("section_id") == "1", " p ").when(F.col("section_id") == "2", "F")
    earned = F.when(~((F.col("section_id") == "2") & (F.col("delivery_method") == "O")), F.col("number_of_credits_earned"))
    return eda.pass_fail_consistency(df.withColumns({"pass_fail_flag": flag, "number_of_credits_earned": earned}))


@query("SELECT upper(trim(g)) grade, count(*) n FROM (SELECT ['zz ','3.5','A-','4.5',NULL,'w',' b+','','np'][c_custkey%9+1] g FROM customer) WHERE upper(trim(g)) IN ('ZZ','A-','4.5','B+','NP') GROUP BY 1")
def unmapped_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.get(F.array(*map(F.lit, ("zz ", "3.5", "A-", "4.5", None, "w", " b+", "", "np"))), (F.col("c_custkey") % 9).cast("int"))
    return eda.unmapped_grades(lens.table(spark, sf_dir, "customer").select(g.alias("grade")))


#: Raw labels with the canonical values that they stand for.
_LABELS = {
    "term": (("Fall", "FALL"), ("FA", "FALL"), ("Fall 2023", "FALL"), ("WI", "WINTER"), ("spring ", "SPRING"), ("SP", "SPRING"), ("SU", "SUMMER"), (" sm", "SUMMER"), ("Autumn", None), ("Q1", None), (None, None)),
    "enrollment": (("First-time student", "FIRST-TIME"), ("Transfer", "TRANSFER-IN"), ("Re-admit", "RE-ADMIT"), ("Freshman", "FIRST-TIME"), ("First-Time Transfer", "FIRST-TIME"), ("part time", "FIRST-TIME"), ("readmitted", "RE-ADMIT"), ("Other", None), ("", None)),
    "pell": (("Yes", "Y"), (" y", "Y"), ("NO", "N"), ("n", "N"), ("true", None), ("1", None), ("Maybe", None)),
    "credential": (("Bachelor's Degree", "Bachelor's"), ("BA", "Bachelor's"), ("bs", "Bachelor's"), ("BA in Art", "Bachelor's"), ("AAS", "Associate's"), ("as", "Associate's"), ("Associate's", "Associate's"), ("certification", "Certificate"), ("Unknown", None)),
    "age": (("13", "20 AND YOUNGER"), ("20.9", "20 AND YOUNGER"), ("21.0", ">20 - 24"), ("24.9", ">20 - 24"), ("25", "OLDER THAN 24"), ("100", "OLDER THAN 24"), ("12", None), ("101", None), ("  older  than 24 ", "OLDER THAN 24"), ("under 21", "20 AND YOUNGER"), ("20-24", ">20 - 24"), ("older than 24 years", "OLDER THAN 24"), ("NaN", None)),
    "grade": (("W1", "W"), ("nsw", "W"), (" other", "O"), ("A-", "3.7"), ("b+", "3.3"), ("F", "0"), ("P", "P"), ("XF", "XF"), (None, None)),
}
_text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
_LABEL_ROWS = ", ".join(f"('{kind}', {_text(a)}, {_text(b)})" for kind, pairs in _LABELS.items() for a, b in pairs)


@query(f"WITH l(kind, label, value) AS (VALUES {_LABEL_ROWS}) SELECT kind, label, value, n FROM l, (SELECT count(*) n FROM customer)")
def normalised_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as raw files write them, by their normalisers, beside the number of customers."""
    rows = spark.createDataFrame([(kind, a) for kind, pairs in _LABELS.items() for a, _ in pairs], "kind string, label string")
    made = {"term": C.normal_term, "enrollment": C.normal_enrollment, "pell": C.normal_pell, "credential": C.normal_credential, "age": C.normal_age, "grade": C.normal_grade}
    value = F.lit(None).cast("string")
    for kind, f in made.items():
        value = F.when(F.col("kind") == kind, f("label")).otherwise(value)
    return rows.withColumn("value", value).join(F.broadcast(lens.table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))))


@query(f"WITH {_CO} SELECT program_of_study_term_1, count(*) n FROM cohorts GROUP BY 1 ORDER BY n DESC, 1 LIMIT 7")
def top_majors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.top_values(lens.cohorts(spark, sf_dir), "program_of_study_term_1", 7)


def _summary(spark: SparkSession, sf_dir: str) -> eda.CohortSummary:
    return eda.CohortSummary(lens.cohorts(spark, sf_dir), lens.courses(spark, sf_dir))


@query(f"WITH {_CO}, {_CU} SELECT (SELECT count(*) FROM cohorts) n_cohort_rows, (SELECT count(DISTINCT student_id) FROM cohorts) n_cohort_students, (SELECT count(DISTINCT student_id) FROM courses) n_course_students, (SELECT count(*) FROM courses) n_course_rows")
def cohort_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).totals()


@query(f"WITH {_CO} SELECT CASE enrollment_type WHEN 'FIRST-TIME' THEN 'First-Time' WHEN 'TRANSFER-IN' THEN 'Transfer-In' WHEN 'RE-ADMIT' THEN 'Re-Admit' ELSE 'De' END enrollment_type, cohort, round(avg(gpa_group_year_1),4) gpa FROM cohorts GROUP BY 1,2")
def gpa_by_enrollment_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).gpa_by_enrollment_type()


@query(f"WITH {_CU} SELECT academic_year, academic_term, count(DISTINCT student_id) n_students, count(*) n FROM courses GROUP BY 1,2")
def course_enrollments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).course_enrollments()


@query(f"WITH {_CO} SELECT cohort, round(100*avg(retention::INT),2) retention_pct, round(100*avg(persistence::INT),2) persistence_pct FROM cohorts GROUP BY 1")
def retention_by_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).retention()


@query(f"WITH {_CU} SELECT grade, count(*) n, round(100.0*count(*)/sum(count(*)) OVER (),1) pct FROM courses GROUP BY 1")
def grade_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).grades()


# --- profiles --------------------------------------------------------------------------------------------------------

_PROFILE = "SELECT '{0}' \"column\", count(*) n, round(avg(({0} IS NULL)::INT),6) null_share, round(avg(({0} IS NULL OR upper(trim(CAST({0} AS VARCHAR))) IN ('','NA','N/A','NULL','NONE','NAN','UNKNOWN'))::INT),6) token_null_share, count(DISTINCT {0}) n_unique FROM x"


@query("WITH x AS (SELECT c_mktsegment, CASE WHEN c_custkey%9=0 THEN 'unknown' WHEN c_custkey%4=0 THEN NULL ELSE c_name END c_name FROM customer) " + _PROFILE.format("c_mktsegment") + " UNION ALL " + _PROFILE.format("c_name"))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return profiling.profile(lens.table(spark, sf_dir, "customer").select("c_mktsegment", F.when(k % 9 == 0, "unknown").when(k % 4 != 0, F.col("c_name")).alias("c_name")))


@query("WITH v AS (SELECT 'o_orderpriority' \"column\", o_orderpriority \"value\", count(*) n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, \"value\") AS INT) \"rank\" FROM v) WHERE \"rank\"<=2")
def frequent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.frequent_values(lens.table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], 2)


@query("SELECT 'o_orderstatus' \"column\", string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) \"values\" FROM orders UNION ALL SELECT 'o_orderpriority', string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) FROM orders")
def small_vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.distinct_values(lens.table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.col("o_orderkey").cast("string").alias("k")), ["o_orderstatus", "o_orderpriority", "k"])


@query("SELECT 'l_orderkey' \"key\", round(count(DISTINCT l_orderkey)/count(*),6) uniqueness FROM lineitem UNION ALL SELECT 'l_orderkey+l_linenumber', round(count(DISTINCT (l_orderkey,l_linenumber))/count(*),6) FROM lineitem UNION ALL SELECT 'l_orderkey+l_partkey+l_suppkey', round(count(DISTINCT (l_orderkey,l_partkey,l_suppkey))/count(*),6) FROM lineitem")
def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiling.uniqueness_scores(lens.table(spark, sf_dir, "lineitem"), [["l_orderkey"], ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_partkey", "l_suppkey"]]))


@query(f"WITH c AS (SELECT unnest(['ps','psq']) k) SELECT 'l_orderkey+l_partkey' \"key\", {r('count(DISTINCT (l_orderkey,l_partkey))/count(*)')} uniqueness FROM lineitem")
def candidate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiling.candidate_keys(lens.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_returnflag"], 2, 0.99)
    return spark.createDataFrame([("+".join(k), round(u, 6)) for k, u in found], "key string, uniqueness double")
