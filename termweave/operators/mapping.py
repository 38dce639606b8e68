"""The declarative mapping executor: a manifest of fields becomes one plan.

A manifest names the entity's source table and keys, an optional grain policy, and fields. A field takes a column of that
table (with an optional filter, others become null) or of another one (filtered, ordered, one or the n-th row a key,
joined on the entity keys), runs steps, and is reduced to one value an entity. Fields of the entity's own table share one
grouped aggregate; each other table is read, reduced and joined once for all its fields.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from termweave.functions.steps import apply_step

from . import duplicates, selection


class GrainError(ValueError):
    """The source has more rows than entities, and the manifest does not say how to reduce them."""


@dataclass
class Field:
    target: str
    column: str | None = None
    table: str | None = None
    constant: object = None
    filter: tuple[str, str, object] | None = None
    steps: Sequence[Mapping] = ()
    #: any_row, first_by, where_not_null, nth
    select: str = "any_row"
    order: Sequence[str] = ()
    n: int = 0
    #: entity key -> column of the other table
    keys: Mapping[str, str] | None = None


@dataclass
class Manifest:
    table: str
    keys: Sequence[str]
    fields: Sequence[Field]
    grain: Mapping | None = None
    one_row_per_key: bool = False
    aliases: Mapping[str, str] = field(default_factory=dict)


def required_columns(manifest: Manifest) -> dict[str, set[str]]:
    """Columns that each table must have: what a plan reads, and no more."""
    out: dict[str, set[str]] = {manifest.table: set(manifest.keys)}
    for f in manifest.fields:
        of = out.setdefault(f.table or manifest.table, set())
        of.update(([f.column] if f.column else []) + list(f.order) + ([f.filter[0]] if f.filter else []))
        if f.table and f.table != manifest.table:
            of.update((f.keys or {k: k for k in manifest.keys}).values())
        of.update(c for s in f.steps for c in s.get("extra_columns", ()))
    return out


def missing_columns(tables: Mapping[str, DataFrame], manifest: Manifest) -> dict[str, list[str]]:
    need = required_columns(manifest)
    return {t: lost for t, c in need.items() if (lost := sorted(c - set(tables[t].columns if t in tables else ())))}


def _value(f: Field, hooks) -> Column:
    out = F.col(f.column) if f.column else F.lit(f.constant)
    if f.filter:
        out = F.when(selection.filter_mask(*f.filter), out)
    for step in f.steps:
        out = apply_step(out, step, hooks)
    return out


def _orderable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_orderable(x.dataType) for x in kind)
    return kind.typeName() not in ("map", "variant", "interval", "geometry", "geography")


def _tiebreak(df: DataFrame) -> list[str]:
    """The columns of df by which rows can be ordered, as they stand."""
    return [x.name for x in df.schema if _orderable(x.dataType)]


def _total(f: Field, order: Sequence[str]) -> list[str]:
    """The field's order, then the table's columns as they stand, so that what is kept of ties does not depend on how files are read."""
    return list(dict.fromkeys([*f.order, *order]))


def _reduce(f: Field, value: Column, order: Sequence[str]) -> Column:
    """One value a group; ties take the smallest in a total order, nulls last, and any_row the smallest value."""
    by = F.struct(*(x for c in _total(f, order) for x in (F.col(c).isNull(), F.col(c))))
    if f.select == "where_not_null":
        return F.min_by(value, F.when(value.isNotNull(), by))
    if f.select == "first_by":
        return F.min_by(value, by)
    if f.select == "nth":
        return F.min(F.when(F.col(f"_at_{f.target}") == f.n + 1, value))
    return F.min(value)


def _placed(df: DataFrame, fields: Sequence[Field], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with the place of each row in its entity, for the fields that take the n-th: a window by the keys that the aggregate groups by."""
    return df.withColumns({f"_at_{f.target}": F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_last() for c in _total(f, order)))) for f in fields if f.select == "nth"})


def execute(tables: Mapping[str, DataFrame], manifest: Manifest, hooks: Mapping[str, Callable[..., Column]] | None = None) -> DataFrame:
    """The target table: entity keys (under their aliases) and fields, one row an entity."""
    if lost := missing_columns(tables, manifest):
        raise ValueError(f"missing columns: {lost}")
    keys = list(manifest.keys)
    source = tables[manifest.table].dropna(subset=keys)
    if manifest.grain:
        source = duplicates.resolve(source, {"keys": keys, **manifest.grain})
    if manifest.one_row_per_key and not duplicates.duplicate_groups(source, keys).isEmpty():
        raise GrainError(f"{manifest.table} has several rows for a key of {keys}")
    own = [f for f in manifest.fields if f.table in (None, manifest.table)]
    order = _tiebreak(source)
    prepared = _placed(source.select(*source.columns, *(_value(f, hooks).alias(f"_{f.target}") for f in own)), own, keys, order)
    out = prepared.groupBy(*keys).agg(F.count("*").alias("_n"), *(_reduce(f, F.col(f"_{f.target}"), order).alias(f.target) for f in own)).drop("_n")
    for table in dict.fromkeys(f.table for f in manifest.fields if f.table not in (None, manifest.table)):
        some = [f for f in manifest.fields if f.table == table]
        names = some[0].keys or {k: k for k in keys}
        order = _tiebreak(tables[table])
        other = tables[table].select(*tables[table].columns, *(_value(f, hooks).alias(f"_{f.target}") for f in some))
        other = _placed(other, some, list(names.values()), order)
        kinds = dict(out.dtypes)
        reduced = other.groupBy(*(F.col(names[k]).cast(kinds[k]).alias(f"_k_{k}") for k in names)).agg(*(_reduce(f, F.col(f"_{f.target}"), order).alias(f.target) for f in some))
        on = [F.col(k) == F.col(f"_k_{k}") for k in names]
        out = out.join(reduced, on, "left").drop(*(f"_k_{k}" for k in names))
    return out.select(*(F.col(k).alias(manifest.aliases.get(k, k)) for k in keys), *(f.target for f in manifest.fields))


def uniqueness_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, duplicated keys and their rows."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return sizes.agg(count("n").alias("n_rows"), F.count("*").alias("n_keys"), F.count(F.when(F.col("n") > 1, 1)).alias("n_duplicated_keys"), count(F.when(F.col("n") > 1, F.col("n"))).alias("n_duplicated_rows"))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    over = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_n", F.row_number().over(over)).where("_n = 1").drop("_n")
