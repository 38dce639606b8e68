"""Cleaning of raw, all-text tables: nulls, types, contracts, validation."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions import columns as C
from termweave.functions import constants as K
from termweave.functions import names

from . import duplicates, terms

DATE_FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "MM/dd/yyyy", "yyyy-MM-dd HH:mm:ss")
BOOLEANS = {"true": True, "false": False, "yes": True, "no": False, "y": True, "n": False, "t": True, "f": False}


def nulls(df: DataFrame, tokens: Sequence[str] = K.NULL_TOKENS) -> DataFrame:
    """df with blanks and null tokens of text columns as null."""
    made = {n: F.when(~F.upper(F.trim(F.col(n))).isin(list(tokens)), F.trim(F.col(n))) for n, k in df.dtypes if k == "string"}
    return df.withColumns(made) if made else df


def drop_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*(c for c in columns if c in df.columns))


def add_missing(df: DataFrame, columns: Mapping[str, tuple[object, str]]) -> DataFrame:
    """df with each absent column as a constant of a type."""
    made = {c: F.lit(v).cast(t) for c, (v, t) in columns.items() if c not in df.columns}
    return df.withColumns(made) if made else df


def standardise(df: DataFrame, drop: Sequence[str] = (), fill: Mapping[str, tuple[object, str]] | None = None, flags: Sequence[str] = ()) -> DataFrame:
    """Columns dropped and added, and Y/N flags with N for null."""
    out = add_missing(drop_present(df, drop), fill or {})
    return out.withColumns({c: C.yes_or_no(c) for c in flags if c in out.columns}) if flags else out


def type_counts(df: DataFrame, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """(column, n_rows, n_known, n_date, n_number, n_whole, n_boolean) of text columns, by one aggregate."""
    made, columns = [], [n for n, k in df.dtypes if k == "string"]
    for c in columns:
        x = F.col(f"`{c}`")
        number = x.try_cast("double")
        date = F.coalesce(*(F.try_to_timestamp(x, F.lit(f)) for f in formats)).isNotNull() & ~x.rlike(r"^\d{4}$") & F.lit("cip" not in c.lower())
        whole = number.isNotNull() & (number == F.floor(number))
        boolean = F.lower(x).isin(*BOOLEANS)
        made.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("n_rows"), F.count(x).alias("n_known"), *(F.count(F.when(hit, 1)).alias(n) for n, hit in (("n_date", date), ("n_number", number.isNotNull()), ("n_whole", whole), ("n_boolean", boolean)))).alias(f"_{len(made)}"))
    return df.agg(*made).select(F.explode(F.array(*(F.col(f"_{i}") for i in range(len(made))))).alias("r")).select("r.*")


def inferred_types(df: DataFrame, share: float = K.DTYPE_SHARE, least: int = K.DTYPE_ROWS) -> DataFrame:
    """(column, dtype): date, number (bigint if whole), boolean or string; a type needs that share of all rows."""
    counts = type_counts(df)
    enough = lambda n: (F.col(n) >= share * F.col("n_rows")) & (F.col("n_known") >= least)
    kind = F.when(enough("n_date"), "date").when(enough("n_number") & (F.col("n_whole") == F.col("n_number")), "bigint").when(enough("n_number"), "double").when(enough("n_boolean"), "boolean").otherwise("string")
    return counts.select("column", kind.alias("dtype"))


def typed(c: str, dtype: str) -> Column:
    """A text column as a type; what does not fit is null, whole numbers are rounded half to even."""
    x = F.col(f"`{c}`")
    if dtype == "date":
        return C.first_date(x, DATE_FORMATS)
    if dtype == "boolean":
        return C.bool_from(F.lower(x.cast("string")), BOOLEANS)
    if dtype == "bigint":
        return F.bround(x.cast("string").try_cast("double")).cast("bigint")
    return x.cast("string").try_cast(dtype)


def freeze(df: DataFrame, types: Mapping[str, str], keys: Sequence[str] = (), tokens: Sequence[str] = K.NULL_TOKENS) -> dict:
    """A contract: names, types, columns without nulls, keys, and a hash of the order of names."""
    row = df.agg(*(F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in df.columns)).first()
    order = hashlib.sha256("\n".join(df.columns).encode()).hexdigest()
    return {"columns": [{"name": c, "dtype": types.get(c, "string"), "non_null": row[c] == 0} for c in df.columns], "keys": list(keys), "null_tokens": list(tokens), "order_hash": order}


def enforce(df: DataFrame, contract: Mapping) -> DataFrame:
    """df as the contract has it: its columns in its order and types; absent ones are null, others go."""
    present = set(df.columns)
    return df.select(*(typed(c["name"], c["dtype"]).alias(c["name"]) if c["name"] in present else F.lit(None).cast(c["dtype"]).alias(c["name"]) for c in contract["columns"]))


def contract_faults(df: DataFrame, contract: Mapping) -> DataFrame:
    """(check, column, n_failures) of a contract's nulls and keys, by one aggregate and one grouped one."""
    needed = [c["name"] for c in contract["columns"] if c["non_null"]]
    checks = {("not_null", c): F.col(f"`{c}`").isNotNull() for c in needed}
    out = failures(df, checks)
    if contract["keys"]:
        dup = duplicates.duplicate_groups(df, contract["keys"]).agg(F.lit("unique").alias("check"), F.lit(",".join(contract["keys"])).alias("column"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_failures"))
        out = dup if out is None else out.unionAll(dup)
    return out


def save_contract(contract: Mapping) -> str:
    return json.dumps(contract, sort_keys=True)


def load_contract(text: str) -> dict:
    return json.loads(text)


def failures(df: DataFrame, checks: Mapping[tuple[str, str], Column]) -> DataFrame | None:
    """(check, column, n_failures) of row checks, by one aggregate; a check that is null passes."""
    if not checks:
        return None
    row = df.agg(*(F.struct(F.lit(n).alias("check"), F.lit(c).alias("column"), F.count(F.when(~F.coalesce(hit, F.lit(True)), 1)).alias("n_failures")).alias(f"_{i}") for i, ((n, c), hit) in enumerate(checks.items())))
    return row.select(F.explode(F.array(*(F.col(f"_{i}") for i in range(len(checks))))).alias("r")).select("r.*")


def failure_cases(df: DataFrame, checks: Mapping[tuple[str, str], Column], keys: Sequence[str]) -> DataFrame:
    """(keys, check, column) of every failing row and check: rows are read once, whatever the number of checks."""
    cases = F.array_compact(F.array(*(F.when(~F.coalesce(hit, F.lit(True)), F.struct(F.lit(n).alias("check"), F.lit(c).alias("column"))) for (n, c), hit in checks.items())))
    return df.select(*keys, F.explode(cases).alias("_f")).select(*keys, "_f.*")


def sample_cases(cases: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    """At most k cases of each check and column."""
    return cases.withColumn("_n", F.row_number().over(duplicates.Window.partitionBy("check", "column").orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if lost := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {lost}")
    return df


def require_no_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns)).first()
    if found := {c: row[c] for c in columns if row[c]}:
        raise ValueError(f"nulls: {found}")
    return df


def boolean_like(df: DataFrame, c: str) -> bool:
    """Whether a column's known values are all booleans, in one of the usual spellings."""
    odd = ~F.lower(F.col(c).cast("string")).isin(*BOOLEANS, "0", "1", "0.0", "1.0")
    return df.agg(F.count(F.when(odd, 1)).alias("n")).first().n == 0


def course_checks() -> dict[tuple[str, str], Column]:
    """Checks of course rows."""
    return {
        ("in_range", "number_of_credits_attempted"): F.col("number_of_credits_attempted").between(0, 20),
        ("in_range", "number_of_credits_earned"): F.col("number_of_credits_earned").between(0, 20),
        ("earned_le_attempted", "number_of_credits_earned"): F.col("number_of_credits_earned") <= F.col("number_of_credits_attempted"),
        ("is_in", "academic_term"): F.col("academic_term").isin(*K.TERMS),
        ("matches", "academic_year"): F.col("academic_year").rlike(r"^\d{4}-\d{2}$"),
        ("valid_grade", "grade"): F.col("grade").isin(*K.NON_NUMERIC_GRADES) | F.col("grade").try_cast("double").between(0, 4),
    }


#: Names of the learner's column, and the alias that raw files use where no other is given.
LEARNERS, ALIAS = ("student_id", "learner_id"), "student_id_randomized_datakind"


def learner_names(columns: Sequence[str], learner: str = "student_id", alias: str | None = None) -> dict[str, str]:
    """How to rename columns so that the learner's has its canonical name: from the alias, or from student_id to learner_id."""
    sources = [alias or ALIAS, *(["student_id"] if learner == "learner_id" else [])]
    return next(({c: learner} for c in sources if c in columns and c != learner), {}) if learner not in columns else {}


def clean(
    df: DataFrame, keys: Sequence[str] = (), aliases: Mapping[str, str] | None = None, tokens: Sequence[str] = K.NULL_TOKENS, drop: Sequence[str] = (), non_null: Sequence[str] = (),
    types: Mapping[str, str] | None = None, hook: Callable[[DataFrame], DataFrame] | None = None, order: Sequence[str] | None = None, term: str | None = None,
    contract: Mapping | None = None, learner: str = "student_id", learner_alias: str | None = None,
) -> DataFrame:
    """The cleaning chain: names, aliases, nulls, columns and rows to drop, types, distinct rows, a hook (then distinct
    again), one row a key, term order.

    A frozen contract gives the types of the columns that it names, before rows are compared, as when it was made. The
    learner's column gets its canonical name (in keys too), stays text and is never dropped."""
    out = names.rename_some(names.rename_all(df), aliases or {})
    renamed = learner_names(out.columns, learner, learner_alias)
    out, keys = out.withColumnsRenamed(renamed), [renamed.get(k, k) for k in keys]
    out = drop_present(nulls(out, tokens), [c for c in drop if c not in LEARNERS])
    out = out.dropna(subset=list(non_null)) if non_null else out
    types = ({c["name"]: c["dtype"] for c in contract["columns"]} if contract else {}) | dict(types or {})
    out = out.withColumns({c: typed(c, t) for c, t in types.items() if c in out.columns and t != "string" and not (contract and c == learner)}) if types else out
    out = out.distinct()
    out = hook(out).distinct() if hook else out
    out = duplicates.keep_one(out, keys, order or out.columns) if keys else out
    return terms.label_order(out, term, drop_unmapped=False) if term else out


def clean_all(frames: Mapping[str, DataFrame], specs: Mapping[str, Mapping]) -> dict[str, DataFrame]:
    return {n: clean(df, **specs.get(n, {})) for n, df in frames.items()}
