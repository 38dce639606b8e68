import datetime

import pytest
from pyspark.sql import functions as F

from termweave.functions import columns as C
from termweave.functions import constants as K
from termweave.functions import names, steps


def one(spark, expression, **values):
    """The value of an expression over one row."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else {int: 'int', float: 'double', datetime.date: 'date', list: 'array<string>'}[type(v)]}" for k, v in values.items())) if values else spark.range(1)
    return df.select(expression.alias("x")).first().x


@pytest.mark.parametrize(("grade", "passed", "completed"), [("P", True, True), ("F", False, True), ("W", None, False), ("0.5", False, True), ("1", True, True), (None, None, True), ("A", None, True), ("?", None, True)])
def test_grades(spark, grade, passed, completed):
    assert one(spark, C.passed("g"), g=grade) is passed
    assert one(spark, C.completed("g"), g=grade) is completed


@pytest.mark.parametrize(("grade", "label"), [("A", "AUDIT"), ("AU", "AUDIT"), ("O", "OTHER"), ("0.69", "F"), ("0.7", "D"), ("4", "A"), ("4.2", None), ("W", "W"), (None, None), ("-1", None)])
def test_grade_label(spark, grade, label):
    assert one(spark, C.grade_label("g", C.grade_numeric("g")), g=grade) == label


@pytest.mark.parametrize(("cip", "area"), [("24.0101", "24"), ("9.01", "9"), ("240101", "24"), ("x", None), (None, None), ("24", None)])
def test_short_cip(spark, cip, area):
    assert one(spark, C.short_cip("c"), c=cip) == area


@pytest.mark.parametrize(("number", "level"), [("101", 1), (" 305A ", 3), ("99", None), (None, None), ("101ABC", None)])
def test_course_level(spark, number, level):
    assert one(spark, C.course_level("n"), n=number) == level


def test_four_digit_levels(spark):
    assert one(spark, C.four_digit_course_level("n"), n="1301L") == 1
    assert one(spark, C.four_digit_course_level("n"), n="301") == 0
    with pytest.raises(Exception, match="unexpected course number"):
        one(spark, C.four_digit_course_level("n"), n="11")


def test_catalog(spark):
    assert one(spark, C.catalog_id("c"), c="ENG101-2") == "ENG101"
    assert one(spark, C.in_catalog("c", "ENG101"), c="ENG101-12") is True
    assert one(spark, C.in_catalog("c", "ENG101"), c="ENG1011") is False
    assert one(spark, C.in_catalog("c", ["A", "B"]), c=None) is False
    assert one(spark, C.distinct_catalog_ids("c"), c=["A-1", "A-2", "B"]) == ["A", "B"]


@pytest.mark.parametrize(("year", "term", "bound", "first", "date"), [("2020-21", "FALL", "start", "FALL", (2020, 9, 1)), ("2020-21", "SPRING", "end", "FALL", (2021, 5, 31)), ("2020-21", "SUMMER", "start", "FALL", (2021, 6, 1)), ("2020-21", "SUMMER", "start", "SUMMER", (2020, 6, 1)), ("2020-21", "?", "start", "FALL", None), (None, "FALL", "start", "FALL", None)])
def test_term_dates(spark, year, term, bound, first, date):
    assert one(spark, C.term_date("y", "t", bound, first), y=year, t=term) == (datetime.date(*date) if date else None)


@pytest.mark.parametrize(("term", "cohort", "year"), [((2020, 9, 1), (2020, 9, 1), 1), ((2021, 8, 31), (2020, 9, 1), 1), ((2021, 9, 1), (2020, 9, 1), 2), ((2020, 8, 31), (2020, 9, 1), 0)])
def test_enrollment_year(spark, term, cohort, year):
    assert one(spark, C.enrollment_year("t", "c"), t=datetime.date(*term), c=datetime.date(*cohort)) == year


@pytest.mark.parametrize(("label", "season", "year"), [("Fall 2020", 3, 2020), ("2021 SPRING", 1, 2021), ("  winter   2019", 4, 2019), ("intersession 2020", None, 2020), (None, None, None)])
def test_labels(spark, label, season, year):
    assert one(spark, C.label_season("x"), x=label) == season
    assert one(spark, C.label_year("x"), x=label) == year


def test_ratios_and_flags(spark):
    assert one(spark, C.ratio("a", "b"), a=1.0, b=0.0) is None
    assert one(spark, C.equals_any("a", ["x"]), a=None) is False
    assert one(spark, C.intensity("a"), a=None) == "PART-TIME"
    assert one(spark, C.intensity("a"), a=12.0) == "FULL-TIME"
    assert one(spark, C.certificate_earned("a", None, "b"), a=1, b=2) is True
    assert one(spark, C.numeric_scrub("a"), a="$1,234.50") == 1234.5


def test_limits():
    assert C.convert_limits("term", {"a": (4.0, "year"), "b": (3.0, "term")}, 4) == {"a": 16.0, "b": 3.0}
    assert C.convert_limits("year", {"a": (8.0, "term")}, 4) == {"a": 2.0}
    with pytest.raises(ValueError):
        C.convert_limits("week", {}, 4)


def test_names():
    assert names.snake_case("Student GUID") == "student_guid"
    assert names.snake_case("numCourses_CC|CD") == "num_courses_cc_cd"
    assert names.java_regex(r"^(?P<a_b>\d)[A-Z]{,2}$") == r"^(\d)[A-Z]{0,2}$"
    assert names.collisions(["a b", "a_b", "c"]) == {"a_b": ["a b", "a_b"]}
    assert names.unique([2, 1, 2]) == [2, 1]
    assert names.base_feature("x_missing_flag") == "x"
    assert names.feature_family("cumfrac_num_courses_passed") == "courses_passed"


def test_steps(spark):
    step = lambda value, name, **o: one(spark, steps.apply_step(F.col("c"), {"name": name, "options": o}), c=value)
    assert step("x", "map_values", mapping={"x": None}) is None
    assert step("y", "map_values", mapping={"x": "1"}) == "y"
    assert step("y", "map_values", mapping={"x": "1"}, default=None) is None
    assert step("x", "map_values", mapping={"x": None}, default="d") == "d"
    assert step("7.0", "cast_nullable_int") == 7
    with pytest.raises(Exception, match="not whole"):
        step("7.5", "cast_nullable_int")
    assert step("2001-05-04", "birthyear_to_age_bucket", reference_year=2023) == ">20 - 24"
    assert step("31/12/2020", "coerce_datetime", fmt="%d/%m/%Y") == datetime.datetime(2020, 12, 31)
    with pytest.raises(ValueError):
        steps.apply_step(F.col("c"), {"name": "no such"})
    assert set(K.NON_PASS_FAIL_GRADES).isdisjoint({"P", "PASS", "F"})
