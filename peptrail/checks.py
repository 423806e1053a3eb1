"""Checks that end a run: a clear error before anything wrong is written."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DataError(ValueError):
    """Input that breaks a rule of the data model."""


def require(ok: bool, message: str) -> None:
    if not ok:
        raise DataError(message)


def require_columns(df: DataFrame, names: Iterable[str], what: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    require(not missing, f"{what} lacks the columns {missing}")


def require_none(df: DataFrame, bad: Column, message: str, show: int = 5) -> None:
    """No row may fulfil ``bad``; the error shows a few that do."""
    rows = df.where(bad).limit(show).collect()
    require(not rows, f"{message}: {[r.asDict() for r in rows]}")


def require_unique(df: DataFrame, keys: list[str], what: str) -> None:
    doubled = df.groupBy(*keys).count().where(F.col("count") > 1)
    require_none(doubled, F.lit(True), f"{what} holds a key more than once")


def once(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``df``, whose use is an error if a key stands more than once: the many-to-one check of a join, in its own plan.

    Rows are grouped by the join's key, which they are dealt by anyway, so no job is added.
    """
    others = [F.any_value(F.col(f"`{c}`")).alias(c) for c in df.columns if c not in keys]
    held = df.groupBy(*keys).agg(F.count("*").alias("__n"), *others)
    told = F.concat(F.lit(f"{what} holds a key more than once: "), F.to_json(F.struct(*keys)))
    first = F.when(F.col("__n") > 1, F.raise_error(told).cast(df.schema[keys[0]].dataType)).otherwise(F.col(keys[0]))
    return held.withColumn(keys[0], first).select(*[F.col(f"`{c}`") for c in df.columns])


def require_fraction(df: DataFrame, names: Iterable[str], what: str, slack: float = 1e-8) -> None:
    for name in names:
        require_none(df, (F.col(name) < -slack) | (F.col(name) > 1 + slack), f"{what}: {name} is not a fraction")
