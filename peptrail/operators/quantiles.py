"""Exact quantiles of any number of groups of any size, from ranks in one distributed order.

No buffer holds a group: values are sorted by ranges, counted in two levels, and the rows at the wanted ranks are
looked up. Two kinds of groups that are mostly alike are never written out: those whose other values are 0, and
those that share a base and differ from it in a few values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peptrail.operators.ordered import numbered, running_sum
from peptrail.plans.stages import staged


def _ends(n: Column, p: Column) -> Column:
    """The two ranks (from 0) around the place of quantile ``p`` among ``n`` values, and the weight of the upper one."""
    place = p * (n - 1)
    low = F.floor(place).cast("long")
    return F.array(
        F.struct(F.lit(0).alias("end"), low.alias("rank"), (1 - (place - low)).alias("weight")),
        F.struct(F.lit(1).alias("end"), F.ceil(place).cast("long").alias("rank"), (place - low).alias("weight")),
    )


def wanted_ranks(totals: DataFrame) -> DataFrame:
    """``totals`` (with columns ``n`` and ``p``) once for each rank that the quantile needs; none where ``n`` is 0."""
    kept = [c for c in totals.columns if c != "p"]
    return totals.where("n > 0").select(*kept, "p", F.explode(_ends(F.col("n"), F.col("p"))).alias("e")).select(*kept, "p", "e.*")


def _met(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Quantiles from the values at their ranks."""
    return found.groupBy(*keys, "p").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def at_ranks(values: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """``wanted`` (``keys, rank, ...``) with the ``value`` that stands at each rank of its group in ``values(keys, value)``.

    Ranks count from 0 and must exist; null values take no part.
    """
    lines = values.where("value is not null").select(*keys, "value")
    ranked = numbered(lines, [F.asc(k) for k in keys] + [F.asc("value")], "__index")
    starts = ranked.groupBy(*keys).agg(F.min("__index").alias("__start"))
    asked = wanted.join(starts, list(keys)).withColumn("__index", F.col("__start") + F.col("rank")).drop("__start")
    return asked.join(ranked.select("__index", "value"), "__index").drop("__index")


def in_groups(values: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """``keys, p, weight, value`` at the wanted ranks, for many groups of which none is too long for one task to sort.

    Each group is sorted where its rows meet, by the sort that spills, and only the wanted rows go on.
    """
    keys = list(keys)
    asked = wanted.groupBy(*keys).agg(F.collect_list(F.struct("p", "rank", "weight")).alias("__asked"))  # two a quantile
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("value")) - 1
    ranked = values.where("value is not null").select(*keys, "value").withColumn("__place", place)
    here = F.inline(F.filter("__asked", lambda a: a["rank"] == F.col("__place")))
    return ranked.join(asked, keys).select(*keys, "value", here).drop("rank")


def quantiles(values: DataFrame, keys: Sequence[str], probabilities: Sequence[float], many: bool = False) -> DataFrame:
    """``keys, p, value`` of each group of ``values(keys, value)``, interpolated between its ranks; nulls are left out.

    A few long groups are sorted together over all tasks; of ``many`` groups each is sorted in one.
    """
    every = F.explode(F.array(*map(F.lit, probabilities))).alias("p")
    totals = values.groupBy(*keys).agg(F.count("value").alias("n")).select("*", every)
    return _met((in_groups if many else at_ranks)(values, keys, wanted_ranks(totals)), keys)


def zero_filled(values: DataFrame, keys: Sequence[str], totals: DataFrame) -> DataFrame:
    """``keys, p, value`` for groups of ``n`` values of which ``values(keys, value)`` holds those above 0.

    ``totals(keys, n, p)`` has every group and quantile; groups with ``n`` = 0 give no row.
    """
    own = values.where("value > 0")
    n_own = own.groupBy(*keys).agg(F.count("*").alias("n_own"))
    zeros = F.col("n") - F.coalesce("n_own", F.lit(0))
    wanted = staged(wanted_ranks(totals).join(n_own, list(keys), "left").withColumn("rank", F.col("rank") - zeros), "wanted")
    above = in_groups(own, keys, wanted.where("rank >= 0"))
    return _met(above.select(*keys, "p", "value", "weight").unionAll(wanted.where("rank < 0").select(*keys, "p", F.lit(0.0), "weight")), keys)


def changed(base: DataFrame, scope: Sequence[str], changes: DataFrame, keys: Sequence[str], totals: DataFrame) -> DataFrame:
    """``keys, p, value`` for groups that hold the values of ``base(scope, value)`` but for some ``changes(keys, value, weight)``.

    A change takes a value away (weight -1, one that the base has) or adds one (+1), as many of each; ``scope`` is
    part of ``keys``, and ``totals(keys, n, p)`` has every group, ``n`` the size of its base. What is sorted and shuffled
    are the base, once, and the changes. With L values of the base below a changed value x, E of them at x and a sum S of
    the weights up to x, a group has L + E + S values up to x: the first x where that exceeds a rank is either the
    value at that rank, or the base's value at (rank - S of the x before) lies below it.
    """
    scope, keys = list(scope), list(keys)
    own = base.where("value is not null").select(*scope, "value")
    lines = changes.select(*keys, "value", "weight").withColumn("__base", F.lit(0)).unionByName(own.withColumn("__base", F.lit(1)), allowMissingColumns=True)
    counted = running_sum(lines, "__base", [*[F.asc(k) for k in scope], F.asc("value"), F.asc("__base")], "__below", "__upto")
    # counts run over all scopes: those of one begin where it begins
    starts = counted.groupBy(*scope).agg(F.min("__below").alias("__start"))
    placed = counted.join(starts, scope).withColumn("__low", (F.col("__below") - F.col("__start")).cast("long"))
    held = placed.where("__base = 1").select(*scope, "__low", "value")
    at = own.groupBy(*scope, "value").agg(F.count("*").alias("__equal"))
    moved = placed.where("__base = 0").join(at, [*scope, "value"], "left").fillna(0, ["__equal"])
    # rows of a group meet once, for the sums by value and for those along the values
    net = moved.repartition(*keys).groupBy(*keys, "value").agg(F.sum("weight").alias("weight"), F.first("__low").alias("__low"), F.first("__equal").alias("__equal"))
    order_in = Window.partitionBy(*keys).orderBy("value")
    steps = (
        net.where("weight <> 0")
        .withColumn("__sum", F.sum("weight").over(order_in.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("__sum_before", F.col("__sum") - F.col("weight"))
        .withColumn("__reach", F.col("__low") + F.col("__equal") + F.col("__sum"))
        .withColumn("__reach_before", F.coalesce(F.lag("__reach").over(order_in), F.lit(0)))
        .select(*keys, F.col("value").alias("__x"), "__low", "__sum_before", "__reach", "__reach_before")
    )
    wanted = wanted_ranks(totals)
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"w.{k}") == F.col(f"t.{k}"))
    here = (F.col("w.rank") >= F.col("t.__reach_before")) & (F.col("w.rank") < F.col("t.__reach"))
    met = wanted.alias("w").join(steps.alias("t"), same & here, "left").select("w.*", "t.__x", "t.__low", "t.__sum_before")
    index = F.col("rank") - F.coalesce("__sum_before", F.lit(0))
    in_base = F.col("__x").isNull() | (index < F.col("__low"))
    looked = met.withColumn("__at", F.when(in_base, index))
    found = looked.join(held.withColumnsRenamed({"__low": "__at", "value": "__found"}), [*scope, "__at"], "left")
    return _met(found.withColumn("value", F.coalesce("__found", "__x")), keys)
