"""Sets of values over several tables: distinct unions, differences, and the check that no value is unknown."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unknown values that an error names.
NAMED = 10


def distinct_union(tables: Sequence[tuple[DataFrame, str]], name: str) -> DataFrame:
    """The values of several columns together, each once (null too), as a column ``name``; each table is cut to its own distinct values before they meet."""
    parts = [df.select(F.col(c).alias(name)).distinct() for df, c in tables]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def values_except(values: DataFrame, known: DataFrame, name: str, known_name: str | None = None) -> DataFrame:
    """The distinct values of a column that another table does not have; null is a value like any other."""
    theirs = known.select(F.col(known_name or name).alias("_known")).distinct()
    return values.select(name).distinct().join(theirs, F.col(name).eqNullSafe(F.col("_known")), "left_anti")


def check_known(values: DataFrame, known: DataFrame, name: str, known_name: str | None = None) -> None:
    """Raise, naming some, if a column has values that another table does not have. Null is let pass."""
    unknown = values_except(values, known, name, known_name).where(F.col(name).isNotNull())
    if found := [r[0] for r in unknown.orderBy(name).limit(NAMED + 1).collect()]:
        raise ValueError(f"unknown values in {name}: {found[:NAMED]}{' and more' if len(found) > NAMED else ''}")
