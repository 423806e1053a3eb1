"""Places and running sums over a whole table in an order, without gathering it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peptrail.plans.stages import staged


def _part() -> Column:
    """The range of a row: in Spark's numbers the partition stands above 33 bits, the row's place below."""
    return F.shiftright(F.col("__id"), 33)


def _ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` dealt by ranges of ``order`` and sorted, written with the ``__id`` of each row."""
    return staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "ranged")


def _met(ranged: DataFrame, totals: list[tuple], kind: str) -> DataFrame:
    """Rows with the ``__start`` of their range: the totals of all ranges before it. There is one total a range."""
    starts, total = [], 0.0 if kind == "double" else 0
    for part, own in sorted(totals):
        starts.append((part, total))
        total += own
    offset = ranged.sparkSession.createDataFrame(starts, f"__part long, __start {kind}")
    return ranged.join(F.broadcast(offset), _part() == F.col("__part"))


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with each row's place (from 0) in ``order``: its place in its range after all rows of the ranges before.

    Rows that the order leaves equal stand in any order. The ranges are written once.
    """
    ranged = _ranged(df, order)
    met = _met(ranged, [tuple(r) for r in ranged.groupBy(_part().alias("part")).agg(F.count("*")).collect()], "long")
    return met.select(*df.columns, (F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def running_sum(df: DataFrame, value: str, order: Sequence[Column], before: str, after: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before a row (0 for the first) and up to it.

    Two levels: rows are dealt by ranges of ``order``, which must be total, each range is summed by itself, and the
    ranges' own sums, one number a range, give what comes before each. The sum before a row is the very number
    that the row before has up to itself. Nulls count as 0. The ranges are written once, for the sums and the rows
    must see the same ones.
    """
    ranged = _ranged(df, order)
    along = Window.partitionBy(_part()).orderBy("__id")
    upto = F.sum(F.coalesce(F.col(value), F.lit(0))).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = ranged.withColumn("__upto", upto).withColumn("__before", F.coalesce(F.lag("__upto").over(along), F.lit(0)))
    exact = dict(df.dtypes)[value] in ("int", "bigint")  # whole numbers have one sum in any order; of others the last one is taken
    totals = ranged.groupBy(_part().alias("part")).agg(F.sum(value).alias("n")) if exact else summed.groupBy(_part().alias("part")).agg(F.max_by("__upto", "__id").alias("n"))
    met = _met(summed, [(k, n or 0) for k, n in totals.collect()], dict(summed.dtypes)["__upto"])
    return met.select(*df.columns, (F.col("__start") + F.col("__before")).alias(before), (F.col("__start") + F.col("__upto")).alias(after))
