import datetime

import pytest
from pyspark.sql import functions as F

from termweave.operators import checkpoints, cleaning, control, cumulative, duplicates, eda, explain, mapping, metrics, model_prep, profiling, selection, student_terms, targets, terms
from termweave.sources import readers, synthetic, writers
from termweave.streaming import ingest


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_nulls_in_student_terms(spark):
    df = spark.createDataFrame([("a", "t", "M1", None, None), ("a", "t", "M1", True, 3.0), ("b", None, "M1", True, 1.0)], "student_id string, term_id string, course_id string, course_passed boolean, number_of_credits_earned double")
    out = student_terms.aggregate_courses(df, equal=[("course_id", "M1")])
    assert rows(out, "student_id", "num_courses", "num_courses_passed", "num_credits_earned", "took_course_id_M1") == [("a", 2, 1, 3.0, True)]


def test_expanding_keeps_null_prefix(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 2.0), ("a", 3, None), ("a", 4, 4.0)], "student_id string, term_rank int, course_level_mean double")
    out = cumulative.expanding_features(df, order=["term_rank"])
    assert rows(out, "term_rank", "cummean_course_level_mean", "cumstd_course_level_mean") == [(1, None, None), (2, 2.0, None), (3, 2.0, None), (4, 3.0, pytest.approx(2**0.5))]


def test_unique_and_repeated(spark):
    df = spark.createDataFrame([("a", 1, ["x-1", "x-2", "y"]), ("a", 2, ["x", None]), ("a", 3, [None])], "student_id string, r int, course_ids array<string>")
    out = cumulative.unique_and_repeated(df, order=["r"])
    assert rows(out, "r", "cumnum_unique_course_ids", "cumnum_repeated_course_ids") == [(1, 2, 0), (2, 3, 1), (3, 3, 2)]


def test_rolling_window_is_open_on_the_left(spark):
    day = datetime.date
    df = spark.createDataFrame([("a", day(2020, 1, 1), 1.0), ("a", day(2020, 1, 11), 2.0), ("a", day(2020, 1, 12), 4.0)], "s string, d date, c double")
    assert rows(cumulative.rolling_credits(df, ["s"], "d", "c", 10), "rolling_c_10d") == [(1.0,), (2.0,), (6.0,)]


def test_changes(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, "y")], "student_id string, term_rank int, p string")
    assert rows(df.withColumn("c", student_terms.changed_from_previous("p")), "term_rank", "c") == [(1, False), (2, False), (3, True), (4, False)]


def test_checkpoints(spark):
    df = spark.createDataFrame([("a", 1, True, False, 3.0), ("a", 2, False, True, 13.0), ("a", 3, False, True, 31.0), ("b", 5, False, False, 0.0)], "student_id string, term_rank int, term_is_pre_cohort boolean, term_is_core boolean, cumsum_num_credits_earned double")
    assert rows(checkpoints.first_terms_in_cohort(df), "student_id", "term_rank") == [("a", 2), ("b", 5)]
    assert rows(checkpoints.nth_terms(df, 1, noncore=False), "student_id", "term_rank") == [("a", 3)]
    assert rows(checkpoints.first_terms_at_credits(df, 30), "student_id", "term_rank") == [("a", 3)]
    assert rows(checkpoints.last_terms(df), "student_id", "term_rank") == [("a", 3), ("b", 5)]


@pytest.mark.parametrize(("terms_in_year", "season", "last"), [(4, "FALL", 4.0), (4, "SUMMER", 5.0), (3, "FALL", 3.0), (3, "SPRING", 4.0)])
def test_labelable_seasons(spark, terms_in_year, season, last):
    df = spark.createDataFrame([("a", 0, True), ("a", 9, True), ("a", 10, False)], "student_id string, term_rank int, term_is_core boolean")
    checkpoint = spark.createDataFrame([("a", 0, season, "x")], "student_id string, term_rank int, academic_term string, student_term_enrollment_intensity string")
    out = targets.labelable(df, checkpoint, {"*": 5.0}, terms_in_year)
    assert rows(out, "student_max_term_rank", "max_term_rank") == [(last, 9)]


def test_retention_target(spark):
    df = spark.createDataFrame([("a", True, "2019-20 FALL", "2019-20 FALL"), ("b", False, "2019-20 FALL", "2020-21 FALL"), ("c", None, "2019-20 FALL", "2019-20 FALL"), ("d", True, "2020-21 FALL", "2020-21 FALL")], "student_id string, retention boolean, cohort_id string, term_id string")
    assert rows(targets.retention(df)) == [("a", False), ("b", True)]


def test_selection(spark):
    df = spark.createDataFrame([("a", "RE-ADMIT"), ("a", "FIRST-TIME"), ("b", "DE"), ("c", None)], "student_id string, enrollment_type string")
    assert rows(selection.drop_readmits(df)) == [("b", "DE"), ("c", None)]
    assert rows(selection.drop_dual_enrolled(df), "student_id") == [("a",), ("a",), ("c",)]
    with pytest.raises(ValueError):
        selection.with_labels(df, "student_id", "enrollment_type", [])
    with pytest.raises(ValueError):
        selection.require_rows(df.where("false"), "none")
    assert selection.labels_param('["  Fall  2020 "]') == ["fall 2020"]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "101", 3.0, "x"), (1, "101", 4.0, None), (2, "101", 3.0, "x"), (2, "101", 3.0, "x")], "k int, n string, c double, m string")
    assert rows(duplicates.resolve_courses(df, ["k"], ["m"], "n", ["c"]), "k", "n") == [(1, "101"), (1, "101-1"), (2, "101")]
    assert rows(duplicates.suffix_all(df, ["k"], "n", ["c"]), "n") == [("101-1",), ("101-1",), ("101-2",), ("101-2",)]
    assert duplicates.resolve(df, {"strategy": "sequence", "steps": [{"strategy": "true_duplicate"}, {"strategy": "first", "keys": ["k"], "order": ["c"]}]}).count() == 2
    with pytest.raises(ValueError):
        duplicates.resolve(df, {"strategy": "?"})
    assert duplicates.by_key_groups(df, ["k"], lambda p: p.head(1)).count() == 2


def test_cleaning(spark):
    df = spark.createDataFrame([("1", " n/a "), ("1", " n/a "), ("x", "B")], "`Student ID` string, `the Value` string")
    out = cleaning.clean(df, ["student_id"], types={"student_id": "bigint"})
    assert out.dtypes == [("student_id", "bigint"), ("the_value", "string")]
    assert rows(out) == [(1, None), (None, "B")]
    contract = cleaning.load_contract(cleaning.save_contract(cleaning.freeze(out, dict(out.dtypes), ["student_id"])))
    assert cleaning.enforce(df.toDF("student_id", "other"), contract).dtypes == out.dtypes
    with pytest.raises(ValueError):
        cleaning.require_no_nulls(out, ["student_id"])
    with pytest.raises(ValueError):
        cleaning.require_columns(out, ["absent"])
    assert cleaning.boolean_like(spark.createDataFrame([("Yes",), ("0",), (None,)], "b string"), "b")


def test_type_inference_needs_enough_rows(spark):
    df = spark.createDataFrame([(str(i) if i < 15 else "x", "2020", f"24.0{i}") for i in range(20)], "a string, year string, cip string")
    assert dict(rows(cleaning.inferred_types(df))) == {"a": "bigint", "cip": "double", "year": "bigint"} or dict(rows(cleaning.inferred_types(df)))["year"] == "bigint"
    assert dict(rows(cleaning.inferred_types(df.limit(5))))["a"] == "string"


def test_metrics_edges(spark):
    df = spark.createDataFrame([(True, True, 1.0), (False, False, 0.0)], "actual boolean, predicted boolean, score double")
    row = metrics.classification_metrics(df).first()
    assert (row.accuracy, row.f1_score) == (1.0, 1.0) and row.log_loss < 1e-10
    assert spark.range(1).select(metrics.normal_cdf(F.lit(1.96))).first()[0] == pytest.approx(0.975, abs=1e-4)
    same = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    assert metrics.ks_drift(same, same, ["x"]).first().ks_stat == 0.0
    assert explain.score_histogram(spark.createDataFrame([(1.0,), (0.0,), (0.04,)], "score double")).where("num > 0").select("bin").collect() == [(0,), (1,), (24,)]


def test_split_has_exact_shares(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).alias("target"))
    counts = dict(model_prep.split(df, "id").groupBy("split").count().collect())
    assert counts == {"train": 60, "test": 20, "validate": 20}
    assert model_prep.hash_split(df, "id").select("split").distinct().count() == 3


def test_mapping_errors(spark):
    t = {"a": spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")}
    fields = [mapping.Field("v", "v", select="nth", n=1, order=["v"])]
    assert rows(mapping.execute(t, mapping.Manifest("a", ["k"], fields))) == [(1, "y")]
    with pytest.raises(mapping.GrainError):
        mapping.execute(t, mapping.Manifest("a", ["k"], fields, one_row_per_key=True))
    with pytest.raises(ValueError, match="missing columns"):
        mapping.execute(t, mapping.Manifest("a", ["k"], [mapping.Field("w", "w")]))


def test_control(spark):
    runs = spark.createDataFrame([("r", "RUNNING", datetime.datetime(2024, 1, 1))], "run_id string, status string, updated_at timestamp")
    assert control.stale(runs, datetime.datetime(2024, 1, 3), 24).first().status == "STALE"
    assert profiling.candidate_keys(spark.range(20).select("id", (F.col("id") % 3).alias("m")), ["id", "m"]) == [(("id",), 1.0)]
    assert rows(eda.crosstab(spark.range(4).select((F.col("id") % 2).alias("a"), F.lit("x").alias("b")), "a", "b"))[-1] == ("All", "x", 4)


def test_candidate_keys_of_a_large_table(spark):
    twice = spark.range(600_000).select(F.expr("id div 2").alias("a"), (F.col("id") % 2).alias("b"))
    assert profiling.candidate_keys(twice, ["a", "b"], 2, 0.9) == [(("a", "b"), 1.0)]


def test_sources(spark, tmp_path):
    cohort = synthetic.cohorts(spark, 50)
    path = str(tmp_path / "cohort.parquet")
    assert writers.write_parquet(cohort, path) == 50
    assert readers.read_source(spark, path).count() == 50
    with pytest.raises(ValueError):
        readers.read_source(spark)
    csv = tmp_path / "c.csv"
    csv.write_text("Study ID,Course Begin Date,Grade,Number of Credits Earned\n1,20190522.0,a,3\n2,20200101.0,,x\n")
    df = readers.read_courses(spark, str(csv))
    assert rows(df) == [("1", datetime.date(2019, 5, 22), "A", 3.0), ("2", datetime.date(2020, 1, 1), None, None)]
    with pytest.raises(ValueError):
        readers.parse_dates(spark.createDataFrame([("nope",)], "d string"), ["d"])
    assert synthetic.courses(cohort, 3).count() == 150
    with pytest.raises(ValueError):
        writers.require_tables(spark, {"no_such_table": 1})


def test_term_alignment(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "term_order int") for v in ((1, 2, 3), (2, 3, 4)))
    assert rows(terms.align_and_rank({"a": a, "b": b}), "term_order", "term_rank") == [(2, 0), (3, 1)]


def test_stream_upserts(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for i, data in enumerate(([(1, "a"), (2, "b")], [(2, "c"), (3, "d")])):
        spark.createDataFrame(data, "k int, v string").coalesce(1).write.mode("append").parquet(source)
        stream = ingest.read_files(spark, source, "k int, v string")
        ingest.upsert_into(stream, target, str(tmp_path / "ck"), ["k"]).awaitTermination()
    assert rows(ingest.current(spark, target)) == [(1, "a"), (2, "c"), (3, "d")]


def test_stream_upserts_after_a_crash(spark, tmp_path, monkeypatch):
    """A batch that dies between its data and its manifest leaves the table as it was, and is whole when it runs again."""
    target, commit = str(tmp_path / "out"), ingest._commit
    batch = lambda *data: spark.createDataFrame(list(data), "k int, v string")
    ingest.upsert_batch(batch((1, "a"), (2, "b"), (2, "b")), 0, target, "ck", ["k"])
    with monkeypatch.context() as m:
        m.setattr(ingest, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest.upsert_batch(batch((2, "c"), (3, "d")), 1, target, "ck", ["k"])
    assert rows(ingest.current(spark, target)) == [(1, "a"), (2, "b")]
    ingest.upsert_batch(batch((2, "c"), (3, "d")), 1, target, "ck", ["k"])
    ingest.upsert_batch(batch((2, "x")), 1, target, "ck", ["k"])  # run again
    ingest.upsert_batch(batch((9, None)).where("false"), 2, target, "ck", ["k"])
    ingest.upsert_batch(batch((4, "e")), 0, target, "other", ["k"])
    assert rows(ingest.current(spark, target)) == [(1, "a"), (2, "c"), (3, "d"), (4, "e")]
    assert ingest._commit is commit and ingest.current(spark, str(tmp_path / "none")) is None


def test_nth_of_an_entity(spark):
    from termweave.operators import mapping

    people = spark.createDataFrame([(1,), (2,)], "id int")
    visits = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "c", 3), (2, "z", 1)], "id int, what string, at int")
    manifest = mapping.Manifest(table="people", keys=["id"], fields=[mapping.Field("second", "what", "visits", select="nth", n=1, order=["at"]), mapping.Field("first", "what", "visits", select="nth", n=0, order=["at"])])
    assert rows(mapping.execute({"people": people, "visits": visits}, manifest), "id", "second", "first") == [(1, "b", "a"), (2, None, "z")]


def test_ties_of_an_order_fall_to_the_columns_as_they_stand(spark):
    people = spark.createDataFrame([(i,) for i in range(50)], "id int")
    visits = [(visit, p, at, what, {visit: p}) for p in range(50) for visit, at, what in ((0, None, "no time"), (1, 1, "b"), (2, 1, "a"))]
    fields = [mapping.Field(s, "what", "visits", select=s, n=1, order=["at"]) for s in ("where_not_null", "first_by", "nth")]
    for read in (visits, visits[::-1]):
        df = spark.createDataFrame(read, "visit int, id int, at int, what string, other map<int,int>")
        out = mapping.execute({"people": people, "visits": df}, mapping.Manifest("people", ["id"], fields))
        assert sorted(map(tuple, out.collect())) == [(p, "b", "b", "a") for p in range(50)]


def test_hook_over_many_whole_keys(spark):
    big, day = 2**60, datetime.datetime(2024, 3, 31, 1, 30)
    data = [(None if k == 0 else big + k, "x", i, None if i % 5 == 0 else big + i, day, [k, i], float("nan") if i == 1 else None if i == 2 else -0.0) for k in range(40) for i in range(1 + k % 4 * 3 + 90 * (k == 7))]
    df = spark.createDataFrame(data, "k bigint, c string, i int, v bigint, at timestamp, a array<bigint>, x double").repartition(5)
    plain = lambda found: sorted(map(repr, found))
    one = lambda p: p.sort_values("i", ascending=False).pipe(lambda q: q[~q.index.duplicated()])
    last = {r[0]: r for r in data}
    try:
        for size in (1, 7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
            assert plain(duplicates.by_key_groups(df, ["k", "c"], lambda p: p, many=True).collect()) == plain(df.collect())
            assert plain(map(tuple, duplicates.by_key_groups(df, ["k", "c"], one, many=True).collect())) == plain(last.values())
            assert duplicates.by_key_groups(df, ["k", "c"], lambda p: p.head(0), many=True).count() == 0
        assert duplicates.by_key_groups(df, ["k", "c"], lambda p: p.head(1), many=True).count() <= 8  # one row a call
        assert duplicates.by_key_groups(df.where("false"), ["k"], one, many=True).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_hook_query_calls_it_for_many_keys(spark, monkeypatch):
    from termweave.plans.queries import QUERIES

    real = duplicates.by_key_groups
    monkeypatch.setattr(duplicates, "by_key_groups", lambda df, keys, hook, **how: real(df.where("l_orderkey < 500"), keys, lambda rows: hook(rows).head(1), **how))
    assert QUERIES["key_groups_by_hook"](spark, "/root/testdata/sf0.001").count() <= 8  # one row a call


def test_vocabulary_is_bounded(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("a"), (F.col("id") % 3).alias("b"))
    assert student_terms.vocabulary(df, ["b"]) == {"b": [0, 1, 2]}
    with pytest.raises(ValueError):
        student_terms.vocabulary(df, ["a", "b"])


def test_modeling(spark):
    from termweave.operators import modeling

    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"), ((F.col("id") % 20) >= 10).alias("target"))
    for kind in ("logistic", "trees"):
        model = modeling.train(df, ["x"], ["c"], kind=kind)
        out = modeling.score(model, df, ["id", "target"])
        assert out.where("predicted = target").count() > 380
    linear = modeling.train(df, ["x"])
    parts = modeling.linear_contributions(linear, df, "id", ["x"])
    assert parts.agg(F.avg("shap")).first()[0] == pytest.approx(0, abs=1e-6)
    skewed = out.select((F.col("score") * 0.5).alias("score"), F.col("target").alias("actual"))
    scaling = modeling.calibrate(skewed)
    assert scaling and modeling.apply_calibration(skewed, scaling).where("actual").agg(F.avg("score")).first()[0] > 0.6 and scaling[2] == 0.5
    assert modeling.calibrate(skewed.limit(10)) is None


def test_own_schools(spark, tmp_path):
    from termweave.operators import students

    csv = tmp_path / "s.csv"
    csv.write_text("learner_id,entry_year,entry_term,student_age,pell_status_first_year\n1,2020-21,Fall 20,19.5,yes\n")
    row = readers.read_own_cohorts(spark, str(csv)).first()
    assert (row.student_id, row.cohort, row.cohort_term, row.student_age, row.pell_status_first_year) == ("1", "2020-21", "FALL", "20 AND YOUNGER", "Y")
    csv.write_text("learner_id,grade,course_credits_earned,academic_term\n1,b+,3,Fall\n2,OTH,x,?\n")
    assert rows(readers.read_own_courses(spark, str(csv)), "student_id", "grade", "number_of_credits_earned", "academic_term") == [("1", "3.3", 3.0, "FALL"), ("2", "O", None, None)]
    df = spark.createDataFrame([("x", "24.01"), (None, "23.02")], "term_program_of_study string, program_of_study_term_1 string")
    assert students.cip_source(df) == "program_of_study_term_1"
    labelled = terms.academic_labels(spark.createDataFrame([(2020, 3), (2021, 1)], "term_year int, term_season int"))
    assert rows(labelled, "grain_key", "academic_year") == [("2020|3|202003", "2020-21"), ("2021|1|202101", "2020-21")]
