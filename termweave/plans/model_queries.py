"""Queries over model preparation, metrics, explanations, mapping and control tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions import columns as C
from termweave.functions import steps as S
from termweave.operators import association, control, explain, mapping, metrics, model_prep
from termweave.streaming import ingest

from . import lens
from .feature_queries import STUDENT_TERM_SQL, student_term
from .registry import query, r, rounded

_CO = lens.COHORTS_SQL


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as scored students: actual outcome, score, prediction, group, split and numeric features."""
    k = F.col("c_custkey")
    return lens.table(spark, sf_dir, "customer").select(
        k.alias("id"), (k % 3 == 1).alias("actual"), ((k * 7919) % 1000 / 1000 * 0.7 + F.when(k % 3 == 1, 0.3).otherwise(0.0)).alias("score"), ((k * 7919) % 1000 / 1000 * 0.7 + F.when(k % 3 == 1, 0.3).otherwise(0.0) >= 0.5).alias("predicted"),
        F.col("c_mktsegment").alias("segment"), F.when(k % 5 == 0, "test").when(k % 5 == 1, "validate").otherwise("train").alias("split"),
        F.when(k % 7 != 0, F.round("c_acctbal", 0)).alias("balance"), (k % 10).alias("digit"), F.col("c_nationkey").cast("double").alias("nation"), (k % 3 == 1).cast("int").alias("target"),
    )


_SCORED = """x AS (SELECT c_custkey id, c_custkey%3=1 actual, (c_custkey*7919)%1000/1000*0.7 + CASE WHEN c_custkey%3=1 THEN 0.3 ELSE 0.0 END score, (c_custkey*7919)%1000/1000*0.7 + CASE WHEN c_custkey%3=1 THEN 0.3 ELSE 0.0 END >= 0.5 predicted,
  c_mktsegment segment, CASE c_custkey%5 WHEN 0 THEN 'test' WHEN 1 THEN 'validate' ELSE 'train' END split, CASE WHEN c_custkey%7<>0 THEN round(c_acctbal,0) END balance, c_custkey%10 digit, CAST(c_nationkey AS DOUBLE) nation, (c_custkey%3=1)::INT target FROM customer)"""


# --- model preparation -----------------------------------------------------------------------------------------------


@query(
    STUDENT_TERM_SQL
    + f"""SELECT student_id, term_id, CASE WHEN NOT coalesce(cumsum_num_credits_earned<12,false) THEN cummax_in_12_creds_took_course_subject_area_24 END cummax_in_12_creds_took_course_subject_area_24,
  CASE WHEN NOT coalesce(years_to_latest_certificate_at_cohort_inst>=year_of_enrollment_at_cohort_inst,false) THEN years_to_latest_certificate_at_cohort_inst END years_to_latest_certificate_at_cohort_inst,
  {r("CASE WHEN NOT coalesce(year_of_enrollment_at_cohort_inst<=1,false) THEN gpa_group_year_1 END")} gpa_group_year_1, {r("CASE WHEN NOT cumnum_terms_enrolled<4 THEN num_credits_earned_diff_term_3_to_term_4 END")} num_credits_earned_diff_term_3_to_term_4 FROM cumd"""
)
def leakage_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = student_term(spark, sf_dir).select("student_id", "term_id", "cummax_in_12_creds_took_course_subject_area_24", "years_to_latest_certificate_at_cohort_inst", "gpa_group_year_1", "num_credits_earned_diff_term_3_to_term_4", "cumsum_num_credits_earned", "cumnum_terms_enrolled", "year_of_enrollment_at_cohort_inst")
    return rounded(model_prep.mask_leakage(df, drop=["cumsum_num_credits_earned_"]).drop("cumsum_num_credits_earned", "cumnum_terms_enrolled"))


@query(f"WITH {_SCORED} SELECT id, target, CASE WHEN p<=round(n*0.6) THEN 'train' WHEN p<=round(n*0.8) THEN 'test' ELSE 'validate' END split FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5(CAST(id AS VARCHAR)||'|0')) p, count(*) OVER (PARTITION BY target) n FROM x)")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_prep.split(scored(spark, sf_dir).select("id", "target"), "id")


@query(f"WITH {_SCORED} SELECT id, target, round(CAST((SELECT count(*) FROM x)/(2*count(*) OVER (PARTITION BY target)) AS DOUBLE),6) sample_weight FROM x")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model_prep.sample_weights(scored(spark, sf_dir).select("id", "target")))


@query(f"WITH {_SCORED} SELECT id FROM x ORDER BY md5(CAST(id AS VARCHAR)||'|7'), id LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_prep.seeded_sample(scored(spark, sf_dir).select("id"), "id", 50, 7)


@query(f"WITH {_SCORED} SELECT id, coalesce(balance, CASE WHEN abs(k)>=0.5 THEN md ELSE round(m,6) END) balance, balance IS NULL balance_missing_flag FROM x, (SELECT skewness(balance) k, median(balance) md, avg(balance) m FROM x)")
def imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir).select("id", "balance")
    return rounded(model_prep.impute(df, model_prep.imputation_values(df, ["balance"], [])))


@query(f"WITH {_SCORED} SELECT 'balance' feature, {r('avg((balance IS NULL)::INT)')} null_share FROM x UNION ALL SELECT 'digit', 0.0")
def null_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model_prep.null_shares(scored(spark, sf_dir), ["balance", "digit"]))


@query("SELECT 'b' feature UNION ALL SELECT 'constant'")
def feature_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that selection drops: a constant, and one that others nearly give."""
    df = scored(spark, sf_dir).select(F.col("digit").alias("a"), (F.col("digit") * 2 + F.col("id") % 2 * 0.01).alias("b"), (F.col("nation") - 12).alias("c"), F.lit(1.0).alias("constant"))
    constant = model_prep.low_variance_features(df, df.columns)
    dropped = constant + [c for c in model_prep.collinear_features(df, ["b", "a", "c"], keep=["a"])]
    return spark.createDataFrame([(c,) for c in sorted(dropped)], "feature string")


# --- association -----------------------------------------------------------------------------------------------------

_RANK = "(SELECT *, rank() OVER (ORDER BY {0})+(count(*) OVER (PARTITION BY {0})-1)/2 rx, rank() OVER (ORDER BY target)+(count(*) OVER (PARTITION BY target)-1)/2 ry FROM x WHERE {0} IS NOT NULL)"


@query(f"WITH {_SCORED} " + " UNION ALL ".join(f"SELECT '{c}' feature, {r('corr(rx,ry)')} spearman FROM {_RANK.format(c)}" for c in ("score", "balance", "digit")))
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(association.spearman(scored(spark, sf_dir), ["score", "balance", "digit"]))


@query(f"WITH {_SCORED} " + " UNION ALL ".join(f"SELECT '{c}' feature, {r('greatest(a,1-a)')} auc FROM (SELECT (sum(rx) FILTER (target=1) - p*(p+1)/2)/(p*(count(*)-p)) a FROM (SELECT *, count(*) FILTER (target=1) OVER () p FROM {_RANK.format(c)}) GROUP BY p)" for c in ("score", "balance", "digit")))
def univariate_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(association.auc(scored(spark, sf_dir), ["score", "balance", "digit"]))


_CELLS = "c AS (SELECT segment a, digit b, count(*) n FROM x GROUP BY 1,2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) na, sum(n) OVER (PARTITION BY b) nb, sum(n) OVER () t FROM c)"


@query(f"WITH {_SCORED}, {_CELLS} SELECT {r('sqrt(greatest((sum(n*n/(na*nb))-1)/(least(count(DISTINCT a),count(DISTINCT b))-1),0))')} cramers_v FROM m")
def cramers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(association.cramers_v(scored(spark, sf_dir), "segment", "digit"))


@query(f"WITH {_SCORED}, {_CELLS} SELECT {r('sum(n/t*ln(n*t/(na*nb)))')} mutual_information FROM m")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(association.mutual_information(scored(spark, sf_dir), "segment", "digit"))


@query(f"WITH {_SCORED}, g AS (SELECT count(balance) n, avg(balance) m, var_pop(balance) s FROM x WHERE balance IS NOT NULL GROUP BY segment), t AS (SELECT sum(n*m*m)-sum(n*m)*sum(n*m)/sum(n) b, sum(n*s) w FROM g) SELECT {r('sqrt(greatest(b/(b+w),0))')} correlation_ratio FROM t")
def correlation_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(association.correlation_ratio(scored(spark, sf_dir), "segment", "balance"))


# --- metrics ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {_SCORED}, s AS (SELECT split, count(*) n, CAST(count(*) FILTER (actual AND predicted) AS DOUBLE) tp, CAST(count(*) FILTER (NOT actual AND predicted) AS DOUBLE) fp, CAST(count(*) FILTER (actual AND NOT predicted) AS DOUBLE) fn, CAST(count(*) FILTER (NOT actual AND NOT predicted) AS DOUBLE) tn,
  avg(CASE WHEN actual THEN -ln(least(greatest(score,1e-15),1-1e-15)) ELSE -ln(1-least(greatest(score,1e-15),1-1e-15)) END) l FROM x GROUP BY 1)
  SELECT split, n num_samples, tp, fp, fn, tn, {r('(tp+fn)/n')} true_positive_prevalence, {r('(tp+fp)/n')} pred_positive_prevalence, {r('(tp+tn)/n')} accuracy, {r('tp/(tp+fp)')} "precision", {r('tp/(tp+fn)')} recall, {r('2*tp/(2*tp+fp+fn)')} f1_score, {r('l')} log_loss FROM s""")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.classification_metrics(scored(spark, sf_dir), ["split"]))


@query(f"WITH {_SCORED}, t AS (SELECT round(score,4) threshold, CAST(sum(target) AS BIGINT) p, CAST(sum(1-target) AS BIGINT) n FROM x GROUP BY 1), c AS (SELECT threshold, CAST(sum(p) OVER w AS BIGINT) tp, CAST(sum(n) OVER w AS BIGINT) fp, CAST(sum(p) OVER () AS BIGINT) sp, CAST(sum(n) OVER () AS BIGINT) sn FROM t WINDOW w AS (ORDER BY threshold DESC)) SELECT threshold, tp true_positive, fp false_positives, sn-fp true_negatives, sp-tp false_negatives, round(tp/sp,4) true_positive_rate, round(fp/sn,4) false_positive_rate FROM c")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc_curve(scored(spark, sf_dir)))


@query(f"WITH {_SCORED}, e AS (SELECT list_distinct(quantile_cont(score,[0,0.2,0.4,0.6,0.8,1])) e FROM x), p AS (SELECT CAST(greatest(least(len(list_filter(e, lambda v: v<=score))-1,len(e)-2),0) AS INT) bin, score, target FROM x, e) SELECT bin, count(*) num, {r('avg(score)')} mean_score, {r('avg(target)')} rate FROM p GROUP BY 1")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.calibration_bins(scored(spark, sf_dir), 5))


#: Positives that the predictions miss beside those that the scores miss: more of one segment's, a few of another's.
_MISSED = "segment='BUILDING' AND id%2=0 OR segment='FURNITURE' AND id%3=0"
_BIAS = f"""WITH {_SCORED}, g AS (SELECT split, segment subgroup, count(*) size, CAST(sum(target) AS BIGINT) positives, count(*) FILTER (actual AND NOT (predicted AND NOT ({_MISSED}))) fn FROM x GROUP BY 1,2), f AS (SELECT *, positives+ln(1+positives) den, coalesce(fn/nullif(positives+ln(1+positives),0),0) fnr FROM g),
  c AS (SELECT * EXCLUDE (den), 'segment' "group", greatest(fnr-1.96*coalesce(sqrt(fnr*(1-fnr)/nullif(den,0)),0),0) ci_low, least(fnr+1.96*coalesce(sqrt(fnr*(1-fnr)/nullif(den,0)),0),1) ci_high FROM f)"""


def _biased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumn("predicted", F.col("predicted") & ~F.expr(_MISSED))


@query(_BIAS + f" SELECT split, subgroup, size, positives, fn, \"group\", {r('fnr')} fnr, {r('ci_low')} ci_low, {r('ci_high')} ci_high FROM c")
def bias_by_subgroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.group_bias(_biased(spark, sf_dir), "segment"))


_FLAGS = """, q AS (SELECT a.split, a."group", a.subgroup subgroup_a, b.subgroup subgroup_b, a.fnr-b.fnr d, a.ci_low<=b.ci_high AND b.ci_low<=a.ci_high overlap, a.positives pa, b.positives pb,
    CASE WHEN a.size>30 AND b.size>30 THEN (a.fnr-b.fnr)/nullif(sqrt(a.fnr*(1-a.fnr)/a.size+b.fnr*(1-b.fnr)/b.size),0) END z FROM c a JOIN c b ON a.split=b.split AND b.fnr>0 AND (a.fnr>b.fnr OR a.fnr=b.fnr AND a.subgroup<b.subgroup)),
  w AS (SELECT *, 1/(1+0.3275911*z/sqrt(2)) t FROM q), v AS (SELECT *, exp(-z*z/2)*t*(0.254829592+t*(-0.284496736+t*(1.421413741+t*(-1.453152027+t*1.061405429)))) p FROM w JOIN (SELECT split s, least(50,floor(0.15*sum(positives))) enough FROM c GROUP BY 1) ON s=split),
  p AS (SELECT *, CASE WHEN p IS NULL OR pa<enough OR pb<enough THEN '⚪ INSUFFICIENT DATA' WHEN d<0.05 OR p>0.1 THEN '🟢 NO BIAS' WHEN d>=0.15 AND p<=0.01 THEN '🔴 HIGH BIAS' WHEN d>=0.1 AND p<=0.01 THEN '🟠 MODERATE BIAS' ELSE '🟡 LOW BIAS' END flag FROM v)"""


@query(_BIAS + _FLAGS + " SELECT split, subgroup_a, subgroup_b, round(d,4) difference, overlap, flag, CASE WHEN p IS NULL OR pa<enough OR pb<enough THEN 'insufficient samples for statistical test' WHEN d<0.05 OR p>0.1 THEN 'no significant difference' WHEN overlap THEN 'overlapping confidence intervals' ELSE 'non-overlapping confidence intervals' END || CASE WHEN p IS NULL THEN '' WHEN p<0.001 THEN ' with a p-value less than 0.001' ELSE ' with a p-value of '||printf('%.3f',p) END \"type\" FROM p")
def bias_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = metrics.flag_bias(metrics.group_bias(_biased(spark, sf_dir), "segment"))
    return flags.select("split", "subgroup_a", "subgroup_b", "difference", "overlap", "flag", "type")


@query(_BIAS + _FLAGS + ", y AS (SELECT split, round(d,4) d, flag, CASE flag WHEN '🔴 HIGH BIAS' THEN 1.0 WHEN '🟠 MODERATE BIAS' THEN 0.75 WHEN '🟡 LOW BIAS' THEN 0.25 END w FROM p), u AS (SELECT split, coalesce(round(round(sum(w*d),8),4),0) s, count(*) FILTER (flag<>'⚪ INSUFFICIENT DATA') n, count(w) k, coalesce(round(max(d) FILTER (w IS NOT NULL),4),0) m FROM y GROUP BY 1) SELECT split, s bias_score_sum, coalesce(round(round(s/nullif(n,0),8),4),0) bias_score_mean, m bias_score_max, k num_bias_flags, n num_valid_comparisons FROM u")
def bias_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bias_scores(metrics.flag_bias(metrics.group_bias(_biased(spark, sf_dir), "segment")))


@query(f"""WITH {_SCORED}, l AS (SELECT feature, v, split='test' s FROM (SELECT split, unnest(['balance','score']) feature, unnest([balance,score]) v FROM x) WHERE split IN ('train','test')), k AS (SELECT feature, v, count(*) FILTER (NOT s) a, count(*) FILTER (s) b FROM l WHERE v IS NOT NULL GROUP BY 1,2),
  d AS (SELECT feature, max(abs(ca/ta-cb/tb)) ks FROM (SELECT feature, sum(a) OVER w ca, sum(a) OVER f ta, sum(b) OVER w cb, sum(b) OVER f tb FROM k WINDOW w AS (PARTITION BY feature ORDER BY v), f AS (PARTITION BY feature)) GROUP BY 1)
  , e AS (SELECT feature, avg(v) FILTER (NOT s) ma, avg(v) FILTER (s) mb, median(v) FILTER (NOT s) da, median(v) FILTER (s) db, stddev_samp(v) FILTER (NOT s) sa, stddev_samp(v) FILTER (s) sb, avg((v IS NULL)::INT) FILTER (NOT s) na, avg((v IS NULL)::INT) FILTER (s) nb, max(ks) ks, count(v) FILTER (NOT s) ca, count(v) FILTER (s) cb FROM l JOIN d USING (feature) GROUP BY 1),
  h AS (SELECT *, (sqrt(ca*cb/(ca+cb))+0.12+0.11/sqrt(ca*cb/(ca+cb)))*ks x FROM e)
  SELECT feature, {r('ma')} train_mean, {r('mb')} infer_mean, {r('mb-ma')} mean_delta, {r('da')} train_median, {r('db')} infer_median, {r('db-da')} median_delta, {r('sa')} train_std, {r('sb')} infer_std, {r('na')} train_null_pct, {r('nb')} infer_null_pct, {r('ks')} ks_stat,
    {r('CASE WHEN x<0.3 THEN 1 ELSE least(greatest(list_sum(list_transform(range(1,21), lambda k: CASE WHEN k%2=1 THEN 2 ELSE -2 END*exp(-2*k*k*x*x))),0),1) END')} p_value FROM h""")
def ks_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    return rounded(metrics.ks_drift(df.where("split = 'train'"), df.where("split = 'test'"), ["balance", "score"]))


@query(f"WITH {_SCORED}, g AS (SELECT segment, round(avg(score),6) a, round(avg(balance),6) loss FROM x GROUP BY 1) SELECT segment, a, loss, {r('(1-(a-min(a) OVER ())/(max(a) OVER ()-min(a) OVER ())+(loss-min(loss) OVER ())/(max(loss) OVER ()-min(loss) OVER ()))/2')} balanced_score FROM g")
def balanced_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = rounded(scored(spark, sf_dir).groupBy("segment").agg(F.avg("score").alias("a"), F.avg("balance").alias("loss")))
    return rounded(metrics.balanced_score(runs, {"a": "desc", "loss": "asc"}))


# --- explanations ----------------------------------------------------------------------------------------------------


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    shap = df.select("id", ((F.col("digit") - 4) / 10).alias("digit"), (F.col("nation") / 50).alias("nation"), (-F.col("score")).alias("score"))
    return explain.to_long(df.withColumn("score", F.round("score", 3)), shap, "id", ["digit", "nation", "score"])


_LONG = f"WITH {_SCORED}, l AS (SELECT id, unnest(['digit','nation','score']) feature, unnest([(digit-4)/10,nation/50,-score]) shap FROM x)"


@query(_LONG + f", m AS (SELECT feature, round(avg(abs(shap)),6) mean_abs_shap FROM l GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY mean_abs_shap DESC, feature) AS INT) \"rank\", feature, mean_abs_shap FROM m QUALIFY \"rank\"<=2")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explain.top_features(contributions(spark, sf_dir), 2))


@query(_LONG + f" SELECT id, min(feature) FILTER (n=1) feature_1, {r('min(shap) FILTER (n=1)')} shap_1, min(feature) FILTER (n=2) feature_2, {r('min(shap) FILTER (n=2)')} shap_2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY -abs(shap), feature) n FROM l) GROUP BY 1")
def top_features_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explain.top_per_row(contributions(spark, sf_dir), "id", 2).drop("value_1", "value_2"))


@query(_LONG + f" SELECT id, CASE WHEN feature IN ('digit','nation') THEN 'base' ELSE feature END feature, {r('sum(shap)')} shap FROM l GROUP BY 1,2")
def grouped_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explain.group_contributions(contributions(spark, sf_dir), "id", {"digit": "base", "nation": "base"}).drop("value"))


_BOX = "SELECT '{0}' feature, min({0}) min, round(quantile_cont({0},0.25),6) q1, round(median({0}),6) median, round(quantile_cont({0},0.75),6) q3, max({0}) max, count({0}) count, count(*)-count({0}) missing FROM x"


@query(f"WITH {_SCORED} {_BOX.format('balance')} UNION ALL {_BOX.format('nation')}")
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explain.box_stats(scored(spark, sf_dir), ["balance", "nation"]))


@query(f"WITH {_SCORED}, c AS (SELECT CAST(least(floor(round(score*25,9)),24) AS INT) bin, count(*) num FROM x GROUP BY 1), b AS (SELECT CAST(unnest(range(25)) AS INT) bin) SELECT bin, round(bin/25,4) low, round((bin+1)/25,4) high, coalesce(num,0) num, round(100.0*coalesce(num,0)/(SELECT count(*) FROM x),2) pct FROM b LEFT JOIN c USING (bin)")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.score_histogram(scored(spark, sf_dir))


# --- mapping ---------------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT o_custkey, min(o_orderstatus) FILTER (n=1) s FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) n FROM orders) GROUP BY 1), u AS (SELECT o_custkey, arg_min(o_totalprice, o_orderdate) p FROM orders WHERE o_orderpriority='1-URGENT' GROUP BY 1)
  SELECT c_custkey customer, lower(c_mktsegment) segment, CASE WHEN c_nationkey IN (1,2,3) THEN 'near' ELSE 'far' END region, 'crm' source, CASE s WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE s END first_status, round(p,2) urgent_price FROM customer LEFT JOIN f ON c_custkey=f.o_custkey LEFT JOIN u ON c_custkey=u.o_custkey""")
def mapped_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = mapping.Manifest(
        "customer", ["c_custkey"], aliases={"c_custkey": "customer"},
        fields=[
            mapping.Field("segment", "c_mktsegment", steps=[{"name": "strip_whitespace"}, {"name": "lowercase"}]),
            mapping.Field("region", "c_nationkey", steps=[{"name": "map_values", "options": {"mapping": {1: "near", 2: "near", 3: "near"}, "default": "far"}}]),
            mapping.Field("source", constant="crm"),
            mapping.Field("first_status", "o_orderstatus", "orders", keys={"c_custkey": "o_custkey"}, select="first_by", order=["o_orderdate", "o_orderkey"], steps=[{"name": "map_values", "options": {"mapping": {"F": "done", "O": "open"}}}]),
            mapping.Field("urgent_price", "o_totalprice", "orders", keys={"c_custkey": "o_custkey"}, filter=("o_orderpriority", "equals", "1-URGENT"), select="where_not_null", order=["o_orderdate"]),
        ],
    )
    tables = {n: lens.table(spark, sf_dir, n) for n in ("customer", "orders")}
    return rounded(mapping.execute(tables, manifest), 2)


@query("""SELECT k, CASE WHEN k%3=0 THEN NULL WHEN k%3=1 THEN 'tail'||k ELSE NULL END tail, CASE g WHEN 'B+' THEN '3.3' WHEN 'OTH' THEN 'O' ELSE upper(g) END grade, CASE k%4 WHEN 0 THEN 'FIRST-TIME' WHEN 1 THEN 'TRANSFER-IN' WHEN 2 THEN 'RE-ADMIT' END enrollment,
  CASE WHEN k%40+5 BETWEEN 13 AND 20 THEN '20 AND YOUNGER' WHEN k%40+5 BETWEEN 21 AND 24 THEN '>20 - 24' WHEN k%40+5 BETWEEN 25 AND 100 THEN 'OLDER THAN 24' END age, CASE WHEN g IN ('B+','2') THEN 3.0::DOUBLE ELSE 0.0 END credits, make_date(CAST(2019+CASE WHEN k%2=0 THEN 0 ELSE 1 END AS INT), CASE WHEN k%2=0 THEN 8 ELSE 1 END, 1) starts,
  CASE WHEN k%2=0 THEN make_date(2019,12,31) ELSE make_date(2020,5,31) END conferred, make_date(2021, CASE WHEN k%2=0 THEN 8 ELSE 3 END, 31) compact FROM (SELECT c_custkey k, ['B+','OTH','w','2'][c_custkey%4+1] g FROM customer)""")
def field_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    df = lens.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).withColumn("g", F.get(F.array(*map(F.lit, ("B+", "OTH", "w", "2"))), (k % 4).cast("int")))
    text = F.when(k % 3 == 0, F.concat(F.lit("none"), k)).when(k % 3 == 1, F.concat(F.lit("head-tail"), k)).otherwise(F.lit("head- "))
    kind = F.get(F.array(*map(F.lit, ("First time", "transfer", "Readmit", "other"))), (k % 4).cast("int"))
    season = F.when(k % 2 == 0, "FALL").otherwise("SPRING")
    step = lambda c, name, **o: S.apply_step(c, {"name": name, "options": o})
    credits = S.conditional_credits(step(F.col("g"), "normalize_grade"), F.lit(3.0))
    return df.select("k", step(text, "substring_after_first_delimiter", delimiter="-").alias("tail"), step(F.col("g"), "normalize_grade").alias("grade"), step(kind, "normalize_enrollment").alias("enrollment"), step(k % 40 + 5, "normalize_student_age").alias("age"), credits.alias("credits"), S.term_month(F.lit("2019-20"), season).alias("starts"), S.conferral_date(F.lit("2019-20"), season).alias("conferred"), step(F.when(k % 2 == 0, "2021SU").otherwise("2021WI"), "compact_term_code_to_conferral_date").alias("compact"))


@query("SELECT count(*) n_rows, count(DISTINCT (l_orderkey,l_linenumber)) n_keys, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey,l_linenumber HAVING count(*)>1)) n_duplicated_keys, (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) n FROM lineitem GROUP BY l_orderkey,l_linenumber HAVING count(*)>1)) n_duplicated_rows FROM lineitem")
def uniqueness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.uniqueness_report(lens.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("WITH x AS (SELECT coalesce(term_label,'') l FROM (SELECT o_orderpriority term_label FROM orders)) SELECT l label, count(*) n FROM x GROUP BY 1")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.counts_by(lens.table(spark, sf_dir, "orders").select(C.col("o_orderpriority").alias("label")), ["label"])


# --- control tables --------------------------------------------------------------------------------------------------


@query("SELECT event_id, sha256(concat_ws('||', CAST(event_id AS VARCHAR), event_type, CAST(user_id AS VARCHAR))) file_fingerprint FROM events")
def file_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.fingerprint(lens.table(spark, sf_dir, "events"), ["event_id", "event_type", "user_id"]).select("event_id", "file_fingerprint")


#: Existing rows are the customers of all segments but two, new ones those of all but one; statuses stand for what is known of an event.
_OLD, _NEW = "c_mktsegment NOT IN ('MACHINERY','FURNITURE')", "c_mktsegment<>'BUILDING'"


def _rows(spark: SparkSession, sf_dir: str, where: str, value: F.Column) -> DataFrame:
    return lens.table(spark, sf_dir, "customer").where(where).select(F.col("c_custkey").alias("k"), value.alias("v"))


@query(f"SELECT c_custkey k, CASE WHEN {_OLD} THEN c_name ELSE c_mktsegment END v FROM customer")
def insert_only_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.insert_new(_rows(spark, sf_dir, _OLD, F.col("c_name")), _rows(spark, sf_dir, _NEW, F.col("c_mktsegment")), ["k"])


@query(f"SELECT c_custkey k, CASE WHEN {_NEW} AND c_acctbal>=0 THEN c_mktsegment WHEN {_OLD} THEN c_name END v FROM customer")
def update_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.upsert(_rows(spark, sf_dir, _OLD, F.col("c_name")), _rows(spark, sf_dir, _NEW, F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))), ["k"])


@query("SELECT event_id FROM events WHERE event_type='click' AND \"value\">=50")
def queue_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lens.table(spark, sf_dir, "events")
    return control.to_queue(df.withColumnRenamed("event_type", "status"), df.where("value < 50").select("event_id"), "event_id", "click").select("event_id")


@query("SELECT user_id, count(*) n_runs, count(*) FILTER (event_type='purchase') n_success, round(count(*) FILTER (event_type='purchase')/count(*),6) success_rate, round(median(\"value\"),6) median_duration, max(ts) last_ts FROM events GROUP BY 1")
def institution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.institution_summary(lens.table(spark, sf_dir, "events"), "user_id", "event_type", "value", "ts", "purchase")


@query("WITH d AS (SELECT CAST(ts AS DATE) \"day\", count(*) n FROM events GROUP BY 1) SELECT \"day\", n, lag(n) OVER (ORDER BY \"day\") n_before, n-lag(n) OVER (ORDER BY \"day\") change FROM d")
def day_over_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.day_over_day(lens.table(spark, sf_dir, "events"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) n FROM events) WHERE n=1")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.latest_per_key(lens.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT user_id file_fingerprint, count(DISTINCT event_type) n_institutions, string_agg(DISTINCT event_type, ',' ORDER BY event_type) institutions FROM events GROUP BY 1")
def institutions_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.institutions_per_file(lens.table(spark, sf_dir, "events"), "user_id", "event_type").withColumnRenamed("user_id", "file_fingerprint")


@query("SELECT CAST(ts AS DATE) \"day\", event_type, count(*) n FROM events GROUP BY 1,2")
def daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming operator on a batch: the same expressions serve both."""
    return ingest.daily_counts(lens.table(spark, sf_dir, "events"), by=["event_type"])


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts-lag(ts) OVER (PARTITION BY user_id ORDER BY ts)<INTERVAL '30 minutes' THEN 0 ELSE 1 END f FROM events), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) s FROM o) SELECT user_id, min(ts) \"start\", max(ts)+INTERVAL '30 minutes' \"end\", count(*) n FROM g GROUP BY user_id, s")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sessions(lens.table(spark, sf_dir, "events"), "user_id")
