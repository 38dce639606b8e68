"""Names of columns and features: pure driver-side functions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame


#: Punctuation that parts words, and marks that vanish.
PARTING, VANISHING = "!()*+,-./:;<=>?[]^_{|}~", "'\"`"


def snake_case(name: str) -> str:
    """Words of a name, lower-cased and joined by underscores: parted by punctuation, and before capitals, digits and other signs."""
    name = name.translate(str.maketrans(PARTING, " " * len(PARTING), VANISHING))
    return "_".join(re.sub(r"(?<![A-Z])(?=[A-Z])|(?=[A-Z][a-z])|(?<![0-9])(?=[0-9])|(?<!\W)(?=\W)", " ", name).lower().split())


def plain_name(name: str) -> str:
    """Lower case with an underscore for every blank or dash."""
    return re.sub(r"[\s-]+", "_", name.strip().lower())


def unique(values: Iterable) -> list:
    """Distinct values in order of appearance."""
    return list(dict.fromkeys(values))


def collisions(names: Iterable[str], rule=snake_case) -> dict[str, list[str]]:
    """New names that several of the given ones would get."""
    out: dict[str, list[str]] = {}
    for n in names:
        out.setdefault(rule(n), []).append(n)
    return {k: v for k, v in out.items() if len(v) > 1}


def rename_all(df: DataFrame, rule=snake_case) -> DataFrame:
    """df with every column renamed by rule; raises where two would get one name."""
    if found := collisions(df.columns, rule):
        raise ValueError(f"names that collide: {found}")
    return df.toDF(*map(rule, df.columns))


def rename_some(df: DataFrame, mapping: dict[str, str], overrides: dict[str, str] | None = None) -> DataFrame:
    """df with the present columns of mapping (and overrides, which win) renamed."""
    return df.withColumnsRenamed({k: v for k, v in (mapping | (overrides or {})).items() if k in df.columns})


def feature_family(name: str) -> str:
    """A feature's name without its cum..., num_ or frac_ prefixes."""
    return re.sub(r"^(?:cum[a-z]*_)?(?:in_\d+_creds_+)?(?:num_|frac_)?", "", name)


def base_feature(name: str) -> str:
    """The source column of a one-hot or missing-flag feature."""
    return re.sub(r"_missing_flag$", "", name.split(".", 1)[0])


def java_regex(pattern: str) -> str:
    """A Python pattern as the JVM takes it: groups without names, and {0,n} for {,n}."""
    return re.sub(r"\{,(\d+)\}", r"{0,\1}", re.sub(r"\(\?P<\w+>", "(", pattern))
