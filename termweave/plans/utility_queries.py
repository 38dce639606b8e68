"""Queries over scalar helpers, readers and writers, and small tables of features, runs and terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions import columns as C
from termweave.functions import names
from termweave.functions import steps as S
from termweave.operators import association, cleaning, control, courses, cumulative, duplicates, eda, explain, metrics, model_prep, profiling, student_terms, students, targets, terms

from . import lens
from .model_queries import _SCORED, scored
from .registry import query, r, rounded

_CO, _CU = lens.COHORTS_SQL, lens.COURSES_SQL


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.table(spark, sf_dir, "customer")


# --- scalar helpers --------------------------------------------------------------------------------------------------


@query("SELECT c_custkey k, CAST(c_nationkey AS VARCHAR) stripped, coalesce(CASE WHEN c_acctbal>0 THEN c_mktsegment END,'N') filled, CASE WHEN c_nationkey%2=0 THEN -round(c_acctbal,2) ELSE round(c_acctbal,2) END scrubbed, c_nationkey<>0 flag, CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN c_mktsegment END known, CASE WHEN c_mktsegment<>'BUILDING' THEN c_mktsegment END kept FROM customer")
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment, money = F.col("c_mktsegment"), F.round("c_acctbal", 2).cast("decimal(20,2)")
    written = F.when(F.col("c_nationkey") % 2 == 0, -money).otherwise(money).cast("string")
    return _customers(spark, sf_dir).select(
        F.col("c_custkey").alias("k"), C.strip_trailing_decimal(F.concat(F.col("c_nationkey").cast("string"), F.lit(".0"))).alias("stripped"), C.yes_or_no(F.when(F.col("c_acctbal") > 0, segment)).alias("filled"),
        C.numeric_scrub(F.concat(F.lit("$ "), written, F.lit(" USD"))).alias("scrubbed"), C.bool_via_int(F.col("c_nationkey").cast("string")).alias("flag"),
        C.closed_vocabulary(F.concat(F.lit(" "), F.lower(segment)), ["BUILDING", "MACHINERY"]).alias("known"), C.null_if_in(segment, ["BUILDING"]).alias("kept"),
    )


@query("SELECT o_orderkey, CAST(year(d) AS INT) \"year\", CASE WHEN month(d)<=6 THEN 'SPRING' ELSE 'FALL' END season, CASE WHEN month(d)<=6 THEN 1 ELSE 8 END \"month\", CASE WHEN month(d)<=6 THEN make_date(year(d),5,31) ELSE make_date(year(d),12,31) END ends FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) d FROM orders)")
def term_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.year("o_orderdate").cast("string"), F.when(F.month("o_orderdate") <= 6, "10").otherwise("30"))
    season = C.code_season(code, {"10": "SPRING", "30": "FALL"})
    return lens.table(spark, sf_dir, "orders").select("o_orderkey", C.code_year(code).alias("year"), season.alias("season"), C.season_month(season).alias("month"), terms.season_end(C.code_year(code), season).alias("ends"))


@query("SELECT label, term_year, term_season, term_year||'|'||term_season||'|'||(term_year*100+term_season) grain_key, (term_year-CASE WHEN term_season<3 THEN 1 ELSE 0 END)||'-'||lpad(CAST((term_year+1-CASE WHEN term_season<3 THEN 1 ELSE 0 END)%100 AS VARCHAR),2,'0') academic_year FROM (SELECT DISTINCT CASE WHEN month(o_orderdate)<6 THEN 'Spring ' ELSE 'Fall ' END||year(o_orderdate) label, CAST(year(o_orderdate) AS INT) term_year, CASE WHEN month(o_orderdate)<6 THEN 1 ELSE 3 END term_season FROM orders)")
def term_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.when(F.month("o_orderdate") < 6, "Spring ").otherwise("Fall "), F.year("o_orderdate").cast("string"))
    found = terms.label_order(lens.table(spark, sf_dir, "orders").select(label.alias("label")).distinct(), "label")
    return terms.academic_labels(found).select("label", "term_year", "term_season", "grain_key", "academic_year")


@query("SELECT p_partkey, CASE p_size%3 WHEN 0 THEN 0 WHEN 1 THEN CAST(p_size%9 AS INT) END \"level\" FROM part")
def four_digit_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.col("p_size") % 3 == 0, "101H").when(F.col("p_size") % 3 == 1, F.concat((F.col("p_size") % 9).cast("string"), F.lit("230 ")))
    return lens.table(spark, sf_dir, "part").select("p_partkey", C.four_digit_course_level(n).alias("level"))


_STEPS = [("cast_nullable_int", {}), ("cast_nullable_float", {}), ("cast_nullable_string", {}), ("coerce_numeric", {}), ("strip_whitespace", {}), ("lowercase", {}), ("uppercase", {}), ("replace_values_with_null", {"values": ["7"]}), ("fill_nulls", {"value": "none"}), ("fill_constant", {"value": "crm"}), ("replace_null_tokens", {})]


@query("SELECT c_custkey k, CASE WHEN c_nationkey%4<>0 THEN CAST(c_nationkey AS BIGINT) END cast_nullable_int, CASE WHEN c_nationkey%4<>0 THEN CAST(c_nationkey AS DOUBLE) END cast_nullable_float, x cast_nullable_string, CASE WHEN c_nationkey%4<>0 THEN CAST(c_nationkey AS DOUBLE) END coerce_numeric, trim(x) strip_whitespace, lower(x) lowercase, upper(x) uppercase, CASE WHEN x<>'7' THEN x END replace_values_with_null, coalesce(x,'none') fill_nulls, 'crm' fill_constant, CASE WHEN upper(trim(x))<>'N/A' THEN x END replace_null_tokens FROM (SELECT *, CASE WHEN c_nationkey%4=0 THEN CASE WHEN c_nationkey%8=0 THEN ' n/A ' END ELSE CAST(c_nationkey AS VARCHAR) END x FROM customer)")
def field_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey")
    x = F.when(n % 4 != 0, n.cast("string")).when(n % 8 == 0, " n/A ")
    return _customers(spark, sf_dir).select(F.col("c_custkey").alias("k"), x.alias("x")).select("k", *(S.apply_step(F.col("x"), {"name": name, "options": options}).alias(name) for name, options in _STEPS))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS \"day\", CAST(o_orderdate AS DATE) AS typed, CASE WHEN year(o_orderdate)%2=0 THEN make_date(year(o_orderdate),1,1) END parsed, CASE WHEN 2020-year(o_orderdate) BETWEEN 13 AND 20 THEN '20 AND YOUNGER' WHEN 2020-year(o_orderdate) BETWEEN 21 AND 24 THEN '>20 - 24' WHEN 2020-year(o_orderdate) BETWEEN 25 AND 100 THEN 'OLDER THAN 24' END age, o_orderkey%2=0 flag FROM orders")
def field_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = lambda c, name, **o: S.apply_step(c, {"name": name, "options": o})
    day, year = F.date_format("o_orderdate", "yyyy-MM-dd"), F.year("o_orderdate")
    return lens.table(spark, sf_dir, "orders").select(
        "o_orderkey", step(day, "coerce_datetime").cast("date").alias("day"), step(day, "cast_nullable_datetime").cast("date").alias("typed"),
        step(F.when(year % 2 == 0, F.concat(F.lit("01/01/"), year.cast("string"))).otherwise("never"), "coerce_datetime", fmt="%d/%m/%Y").cast("date").alias("parsed"),
        step(year.cast("string"), "birthyear_to_age_bucket", reference_year=2020).alias("age"), step(F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise("0"), "cast_nullable_boolean").alias("flag"),
    )


@query("SELECT c_custkey student_guid, c_name \"name\", CASE WHEN c_acctbal<0 THEN 'Y' ELSE 'N' END flag, 0::BIGINT extra FROM customer")
def standardised_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names rewritten and renamed, columns dropped and added, flags filled."""
    raw = _customers(spark, sf_dir).select(F.col("c_custkey").alias("StudentKey"), F.col("c_name").alias("Full Name"), F.when(F.col("c_acctbal") < 0, "Y").alias("isFlag"), F.lit(1).alias("unwanted"))
    renamed = names.rename_some(names.rename_all(raw), {"student_key": "student_id", "full_name": "name", "is_flag": "flag"}, {"student_key": "student_guid"})
    return cleaning.standardise(renamed, ["unwanted", "absent"], {"extra": (0, "bigint"), "name": ("x", "string")}, ["flag"])


@query(f"WITH {_CO} SELECT 'term_program_of_study,program_of_study_term_1' candidates, 'program_of_study_term_1' found, (SELECT count(*) FROM cohorts WHERE regexp_matches(program_of_study_term_1,'^\\d[\\d.]+$')) n_cip_like, 'student_id' \"keys\"")
def cip_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lens.cohorts(spark, sf_dir)
    found = students.cip_source(df.withColumn("term_program_of_study", F.lit("Liberal Arts")))
    keys = ",".join(students.merge_keys(df.drop("institution_id"), lens.courses(spark, sf_dir)))
    return df.agg(F.lit("term_program_of_study,program_of_study_term_1").alias("candidates"), F.lit(found).alias("found"), F.count_if(C.is_cip_like("program_of_study_term_1")).alias("n_cip_like"), F.lit(keys).alias("keys"))


# --- student-terms ---------------------------------------------------------------------------------------------------

_FLAT = f"WITH {_CU}, t AS (SELECT student_id, academic_year, count(*) n, count(*) FILTER (delivery_method='O') o, count(*) FILTER (delivery_method='H') h, sum(number_of_credits_attempted) c FROM courses GROUP BY 1,2)"


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda v: F.count_if(F.col("delivery_method") == v)
    return lens.courses(spark, sf_dir).groupBy("student_id", "academic_year").agg(F.count("*").alias("n"), count("O").alias("term_n_courses_delivery_O"), count("H").alias("term_n_courses_delivery_H"), F.sum("number_of_credits_attempted").alias("c"))


@query(_FLAT + " SELECT student_id, academic_year, CASE WHEN o>0 THEN 1::BIGINT ELSE o END \"taking_course_delivery_O_this_term\", CASE WHEN h>0 THEN 1::BIGINT ELSE h END \"taking_course_delivery_H_this_term\" FROM t")
def taken_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return courses.count_flags(_years(spark, sf_dir), "delivery").drop("n", "c")


_TO_DATE = "(PARTITION BY student_id ORDER BY academic_year ROWS UNBOUNDED PRECEDING)"


@query(_FLAT + f" SELECT student_id, academic_year, {r(f'sum(o) OVER w/sum(n) OVER w')} pct_o_to_date, {r(f'sum(h) OVER w/sum(n) OVER w')} pct_h_to_date FROM t WINDOW w AS {_TO_DATE}")
def shares_of_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _years(spark, sf_dir).withColumnsRenamed({"term_n_courses_delivery_O": "o", "term_n_courses_delivery_H": "h"})
    df = cumulative.history(df, ["student_id"], ["academic_year"], sums=["n", "o", "h"])
    df = cumulative.shares_of_history(df.drop("o", "h"), "total_", "total_n_to_date", "total_", "pct_")
    return rounded(df.select("student_id", "academic_year", "pct_o_to_date", "pct_h_to_date"))


@query(_FLAT + f" SELECT student_id, academic_year, array_to_string(list(academic_year) OVER w,',') \"years\" FROM t WINDOW w AS {_TO_DATE}")
def running_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cumulative.running_list(_years(spark, sf_dir), "academic_year", ["student_id"], ["academic_year"], "years")
    return df.select("student_id", "academic_year", F.array_join("years", ",").alias("years"))


@query(_FLAT + " SELECT count(*) FILTER (o/n>0.5) frac_o, 0::BIGINT frac_h FROM t")
def fractions_out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _years(spark, sf_dir)
    share = lambda c: C.ratio(f"term_n_courses_delivery_{c}", "n")
    return student_terms.fractions_out_of_range(df.select((share("O") * 2).alias("frac_o"), share("H").alias("frac_h")))


@query(f"WITH {_CU} SELECT 'delivery_method' \"column\", string_agg(DISTINCT delivery_method, ',' ORDER BY delivery_method) \"values\" FROM courses UNION ALL SELECT 'course_type', string_agg(DISTINCT course_type, ',' ORDER BY course_type) FROM courses")
def vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = student_terms.vocabulary(lens.courses(spark, sf_dir), ["delivery_method", "course_type"])
    return spark.createDataFrame([(c, ",".join(v)) for c, v in found.items()], "`column` string, `values` string")


@query("SELECT student_id, n \"count\" FROM (SELECT CAST(o_custkey AS VARCHAR) student_id, count(*) n FROM orders GROUP BY 1) WHERE n>1")
def repeated_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.more_than_one(lens.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("student_id")))


# --- reports and duplicates ------------------------------------------------------------------------------------------


@query("SELECT 'l_returnflag' \"column\", round(100*avg((a>1)::INT),4) pct FROM (SELECT count(DISTINCT l_returnflag) a FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*)>1)")
def within_key_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.within_key_variance(lens.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_returnflag"])


@query("SELECT l_orderkey, l_linenumber, max(l_quantity) l_quantity FROM lineitem GROUP BY 1,2")
def key_groups_by_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas function of the caller's over the rows of each key, called with many keys at once."""
    df = lens.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")

    def largest(rows):
        rows = rows.sort_values("l_quantity", ascending=False)
        return rows[~rows.index.duplicated()]

    return duplicates.by_key_groups(df, ["l_orderkey", "l_linenumber"], largest, many=True)


@query("SELECT p_brand, p_brand LIKE '%-_%' suffixed FROM (SELECT DISTINCT CASE WHEN p_size%2=0 THEN p_brand ELSE p_brand||'-'||p_size END p_brand FROM part)")
def suffixed_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.concat_ws("-", "p_brand", F.col("p_size").cast("string")))
    return lens.table(spark, sf_dir, "part").select(brand.alias("p_brand")).distinct().withColumn("suffixed", duplicates.course_duplicates_truth("p_brand"))


@query(f"WITH {_CU} SELECT student_id, \"check\", \"column\" FROM (SELECT *, row_number() OVER (PARTITION BY \"check\", \"column\" ORDER BY student_id) n FROM (SELECT DISTINCT student_id, 'earned_le_attempted' \"check\", 'number_of_credits_earned' \"column\" FROM courses WHERE number_of_credits_earned>number_of_credits_attempted-2)) WHERE n<=5")
def sampled_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lens.courses(spark, sf_dir).withColumn("number_of_credits_attempted", F.col("number_of_credits_attempted") - 2)
    cases = cleaning.failure_cases(df, cleaning.course_checks(), ["student_id"]).where("check = 'earned_le_attempted'").distinct()
    return cleaning.sample_cases(cases, 5, ["student_id"])


@query(f"WITH {_CO} SELECT gender, count(*) FILTER (student_age='>20 - 24') \">20 - 24\", count(*) FILTER (student_age='20 AND YOUNGER') \"20 AND YOUNGER\", count(*) FILTER (student_age='OLDER THAN 24') \"OLDER THAN 24\" FROM cohorts GROUP BY 1")
def crosstab_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.crosstab_wide(lens.cohorts(spark, sf_dir), "gender", "student_age", [">20 - 24", "20 AND YOUNGER", "OLDER THAN 24"])


# --- model preparation, explanations, runs ---------------------------------------------------------------------------


@query(f"WITH {_SCORED}, b AS (SELECT avg((balance IS NULL)::INT) s FROM x) SELECT 'balance' feature, s>=0.1 incomplete FROM b UNION ALL SELECT 'digit', false")
def incomplete_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = model_prep.incomplete_features(scored(spark, sf_dir), ["balance", "digit"], 0.1)
    return spark.createDataFrame([(c, c in found) for c in ("balance", "digit")], "feature string, incomplete boolean")


@query("SELECT unnest(['a','b','c']) feature WHERE (SELECT count(*) FROM customer)>0")
def newly_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _customers(spark, sf_dir).select(*(F.col("c_custkey").alias(c) for c in "abcd"))
    now = df.withColumns({c: F.when(F.col(c) % 3 == 0, F.col(c)) for c in "abc"})
    return spark.createDataFrame([(c,) for c in model_prep.newly_missing(df, now, list("abcd"))], "feature string")


@query(f"WITH {_SCORED} SELECT id, score>=0.4 predicted FROM x")
def threshold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_labels(scored(spark, sf_dir).select("id", "score"), least=0.4).drop("score")


@query(f"WITH {_SCORED}, g AS (SELECT segment, round(avg(score),6) a, round(avg(balance),6) loss FROM x GROUP BY 1), s AS (SELECT segment, (1-(a-min(a) OVER ())/(max(a) OVER ()-min(a) OVER ())+(loss-min(loss) OVER ())/(max(loss) OVER ()-min(loss) OVER ()))/2 b FROM g) SELECT segment, round(b,6) balanced_score FROM s ORDER BY b, segment LIMIT 2")
def top_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = rounded(scored(spark, sf_dir).groupBy("segment").agg(F.avg("score").alias("a"), F.avg("balance").alias("loss")))
    return rounded(metrics.top_runs(runs, metrics.metric_directions(["a", "loss"]), 2).select("segment", "balanced_score"))


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    cell = lambda c, shap: F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"), shap.alias("shap"))
    cells = F.array(cell("balance", F.coalesce(F.col("balance"), F.lit(0.0)) / 1000), cell("digit", (F.col("digit") - 4.5) / 10), cell("segment", F.lit(0.01)))
    return df.select("id", F.explode(cells).alias("c")).select("id", "c.*")


_LONG = f"WITH {_SCORED}, l AS (SELECT id, 'balance' feature, balance x, coalesce(balance,0)/1000 shap FROM x UNION ALL SELECT id, 'digit', digit, (digit-4.5)/10 FROM x UNION ALL SELECT id, 'segment', NULL, 0.01 FROM x)"


@query(_LONG + f" SELECT id, feature, x IS NULL AND feature='balance' missing, {r('(x-min(x) OVER w)/(max(x) OVER w-min(x) OVER w)')} hint FROM l WINDOW w AS (PARTITION BY feature)")
def value_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    hinted = explain.missing_as(explain.colour_hints(_long(spark, sf_dir)))
    return rounded(hinted.select("id", "feature", (F.col("value") == "Missing").alias("missing"), "hint"))


@query(_LONG + f", m AS (SELECT feature, avg(abs(shap)) a, row_number() OVER (ORDER BY avg(abs(shap)) DESC, feature) n FROM l GROUP BY 1) SELECT id, feature, CAST(n AS INT) \"rank\", {r('shap')} shap FROM l JOIN m USING (feature) WHERE n<=2")
def rows_of_top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explain.rows_of_top_features(_long(spark, sf_dir), 2).select("id", "feature", "rank", "shap"))


@query("SELECT feature, CASE feature WHEN 'balance' THEN 'Account balance' WHEN 'digit' THEN 'A digit' ELSE feature END display_name, count(*) n FROM (SELECT unnest(['balance','digit','segment']) feature FROM customer) GROUP BY 1,2")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame([("balance", "Account balance"), ("dig.*", "A digit"), ("bal.*", "never: an equal name wins")], "pattern string, name string")
    return explain.display_names(_long(spark, sf_dir).select("feature"), table).groupBy("feature", "display_name").agg(F.count("*").alias("n"))


@query(f"WITH {_SCORED} SELECT unnest(['score']) feature FROM (SELECT corr(score, target) c FROM x) WHERE c>0")
def suggested_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature that the target was made to follow, by AUC and rank correlation."""
    df = scored(spark, sf_dir)
    corrs, aucs = ({x[0]: x[1] for x in f(df, ["score", "digit"]).collect() if x[1] is not None} for f in (association.spearman, association.auc))
    return spark.createDataFrame([(n,) for n in association.suggest_forced(corrs, aucs, n_each=1) if corrs[n] > 0], "feature string")


@query("SELECT event_id run_id, max_id model_id FROM events LEFT JOIN (SELECT user_id, max_by(event_id, (ts, event_id)) max_id FROM events WHERE event_type='purchase' GROUP BY 1) m ON m.user_id=events.user_id WHERE event_type='click'")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = lens.table(spark, sf_dir, "events")
    models = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("model_id"), F.struct("ts", "event_id").alias("logged_ts"))
    return control.latest_runs(events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("run_id")), models, "user_id").select("run_id", "model_id")


@query("SELECT event_id, CASE WHEN event_type<>'click' AND ts<TIMESTAMP '2024-01-19 00:00:00' THEN 'STALE' ELSE event_type END status FROM events")
def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = lens.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("status"), F.col("ts").alias("updated_at"))
    return control.stale(events, "2024-01-20 00:00:00", 24, ["click"]).select("event_id", "status")


@query("SELECT count(*) n FROM events WHERE CAST(ts AS DATE)=DATE '2024-01-15'")
def created_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.created_on(lens.table(spark, sf_dir, "events"), "2024-01-15", "ts")


@query("SELECT DISTINCT user_id file_fingerprint, event_type institution_id FROM events WHERE event_type<>'click'")
def expanded_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lens.table(spark, sf_dir, "events").select(F.col("user_id").alias("file_fingerprint"), F.col("event_type").alias("institution_id"))
    return control.expand(pairs.select("file_fingerprint").distinct(), pairs, pairs.where("institution_id = 'click'"))
