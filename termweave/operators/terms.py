"""The term dimension: a small table of distinct terms, joined back by broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import columns as C
from termweave.functions import constants as K


def distinct_terms(df: DataFrame, year: str = "academic_year", term: str = "academic_term", terms: Sequence[str] = K.TERMS) -> DataFrame:
    """Distinct (year, term) without nulls, with the term's place in the year."""
    return df.select(year, term).dropna().distinct().withColumn("term_ordinal", C.term_ordinal(term, terms))


def _rank(inside: Column, order: Sequence[str]) -> Column:
    """0-based rank among the terms inside; null for others. The dimension has a few terms a year, so one task sorts it."""
    return F.when(inside, (F.row_number().over(Window.partitionBy(inside).orderBy(*order)) - 1).cast("int"))


def term_dimension(df: DataFrame, core: Sequence[str] = K.CORE_TERMS, covid=K.PEAK_COVID_TERMS, first_term: str = K.FIRST_TERM, year: str = "academic_year", term: str = "academic_term", terms: Sequence[str] = K.TERMS) -> DataFrame:
    """One row a term: term_id, dates, ranks (all, core, non-core) and flags."""
    order = (year, "term_ordinal")
    is_core = F.col(term).isin(list(core))
    return distinct_terms(df, year, term, terms).withColumns(
        {
            "term_id": C.year_term(year, term),
            "term_start_dt": C.term_date(year, term, "start", first_term),
            "term_rank": _rank(F.lit(True), order),
            "term_rank_core": _rank(is_core, order),
            "term_rank_noncore": _rank(~is_core, order),
            "term_in_peak_covid": C.in_year_terms(year, term, covid),
            "term_is_core": is_core,
            "term_is_noncore": ~is_core,
        }
    )


def term_features(df: DataFrame, year: str = "academic_year", term: str = "academic_term", calendar: DataFrame | None = None, **options) -> DataFrame:
    """df with the features of its terms; rows without year or term go. The dimension is broadcast: it grows with years.
    A calendar, a cheaper table of the same terms, spares a second pass over df."""
    dimension = term_dimension(df if calendar is None else calendar, year=year, term=term, **options)
    return df.join(F.broadcast(dimension), [year, term])


def term_rank(df: DataFrame, subset: Sequence[str] | None = None, year: str = "academic_year", term: str = "academic_term", to: str = "term_rank") -> DataFrame:
    """df with the rank of its term among those of a subset; null outside."""
    known = distinct_terms(df if subset is None else df.where(F.col(term).isin(list(subset))), year, term)
    ranked = known.withColumn(to, _rank(F.lit(True), (year, "term_ordinal"))).drop("term_ordinal")
    return df.join(F.broadcast(ranked), [year, term], "left")


def label_order(df: DataFrame, label: str = "term", seasons=None, drop_unmapped: bool = True) -> DataFrame:
    """df with term_year, season rank and term_order = year * 100 + rank of free-form labels."""
    seasons = seasons or K.SEASON_RANK
    out = df.withColumns({"term_year": C.label_year(label), "term_season": C.label_season(label, seasons)})
    out = out.withColumn("term_order", F.col("term_year") * 100 + F.col("term_season"))
    return out.where("term_order IS NOT NULL") if drop_unmapped else out


def academic_labels(df: DataFrame, year: str = "term_year", season: str = "term_season") -> DataFrame:
    """df with grain_key 'year|season|order' and academic_year 'YYYY-YY' of calendar years and season ranks; an academic year
    starts with its fall (rank 3)."""
    start = F.col(year) - F.when(F.col(season) < 3, 1).otherwise(0)
    label = F.concat(start.cast("string"), F.lit("-"), F.lpad(F.pmod(start + 1, F.lit(100)).cast("string"), 2, "0"))
    key = F.concat_ws("|", F.col(year).cast("string"), F.col(season).cast("string"), (F.col(year) * 100 + F.col(season)).cast("string"))
    return df.withColumns({"grain_key": key, "academic_year": label})


def terms_lookup(spark, first_year: int, last_year: int, seasons: Sequence[str] = ("Spring", "Summer", "Fall", "Winter")) -> DataFrame:
    """Years times seasons with order, calendar year, end date and dense rank: a generated dimension."""
    rows = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"), F.posexplode(F.array(*(F.lit(s) for s in seasons))).alias("place", "season"))
    rows = rows.withColumn("term_order", F.col("year") * 100 + F.col("place") + 1).withColumn("term_end_dt", season_end(F.col("year"), F.col("season")))
    return rows.withColumn("term_rank", F.dense_rank().over(Window.orderBy("term_order")) - 1).drop("place")


def season_end(year: Column, season: Column) -> Column:
    """Last day of a calendar season."""
    of = F.upper(season)
    out = F.when(F.lit(False), F.make_date(year, F.lit(1), F.lit(1)))
    for name, (_, (month, day)) in K.TERM_BOUNDS.items():
        out = out.when(of == name, F.make_date(year, F.lit(month), F.lit(day)))
    return out


def align_and_rank(frames: dict[str, DataFrame], order: str = "term_order", core: Column | None = None) -> DataFrame:
    """(term order, term_rank, term_rank_core) of the terms within the range that all frames share."""
    bounds = None
    union = None
    for df in frames.values():
        one = df.agg(F.min(order).alias("low"), F.max(order).alias("high"))
        bounds = one if bounds is None else bounds.unionAll(one)
        union = df.select(order) if union is None else union.unionAll(df.select(order))
    shared = bounds.agg(F.max("low").alias("low"), F.min("high").alias("high"))
    inside = union.dropna().distinct().join(F.broadcast(shared), (F.col(order) >= F.col("low")) & (F.col(order) <= F.col("high"))).select(order)
    core = F.lit(True) if core is None else core
    return inside.withColumns({"term_rank": _rank(F.lit(True), (order,)), "term_rank_core": _rank(core, (order,))})
