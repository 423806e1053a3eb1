"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of documents, and each block is a unit of work with a release time and a
deadline that follow from the source's weight w: block j may run from slot floor(j / w) on and must run
before slot ceil((j + 1) / w). Earliest deadline first on one processor meets all of these, so after any
number of slots a source has had its share to within less than one block. Weights are used as they are,
as exact fractions, for every source. The schedule is made on the driver, one row a block, so blocks grow
with the table: a table of over ``MOST_BLOCKS`` times ``BLOCK_ROWS`` rows has blocks of more rows, and never
more than about ``MOST_BLOCKS`` of them and one a source.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 64
MOST_BLOCKS = 1 << 20
TEMPERATURE = 0.5
PLACES = ("mix_block", "mix_slot", "mix_position")


def exact_weights(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights."""
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*(w.denominator for w in exact))
    out = [int(w * scale) for w in exact]
    shared = math.gcd(*out)
    return [w // shared for w in out]


def block_schedule(weights: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int]]:
    """Earliest-deadline-first schedule of all blocks, by exact weights: ``(source, block, slot)``.

    Slots of sources that have run out stay empty unless another block may run in them.
    """
    total = sum(weights)
    coming = [(0, i, 0) for i, n in enumerate(blocks) if n]  # release, source, block
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    heapq.heapify(coming)
    t = 0
    while coming or ready:
        if not ready:
            t = max(t, coming[0][0])
        while coming and coming[0][0] <= t:
            _, i, j = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[i]), i, j))
        deadline, i, j = heapq.heappop(ready)
        if deadline <= t:
            raise RuntimeError("a deadline was missed")
        yield i, j, t
        if j + 1 < blocks[i]:
            heapq.heappush(coming, ((j + 1) * total // weights[i], i, j + 1))
        t += 1


def mix(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", key: str = "doc_id",
    block_rows: int = BLOCK_ROWS, temperature: float = TEMPERATURE, most_blocks: int = MOST_BLOCKS,
) -> DataFrame:
    """All rows and columns of ``docs`` and their place in the mix: ``mix_block, mix_slot, mix_position``.

    Columns of ``docs`` with these three names are replaced; other names may be anything.
    Without ``weights`` a source's target weight is its number of rows to the power ``temperature``;
    sources that ``weights`` leaves out get the least weight named. A null source is a source. Inside a
    source rows are ordered by a hash of ``key``, then ``key``; rows of one key, null too, in any order. No
    row is dropped or repeated: once a source has run out its slots stay empty, and the others keep their
    proportions to each other. A block has ``block_rows`` rows, or as many more as keep the number of blocks
    at ``most_blocks``. An empty table gives an empty one. A weight must be over 0.

    A source's rows are numbered in buckets of about 256 rows, or the root of its rows if that is more:
    counts of buckets are summed before the rows are, so a source that holds most rows is spread.
    """
    held, apart = _apart(docs)
    placed = _placed(held, weights, apart.get(source, source), apart.get(key, key), block_rows, temperature, most_blocks)
    kept = [F.col(f"`{apart.get(c, c)}`").alias(c) for c in docs.columns if c not in PLACES]
    return placed.select(*kept, *[F.col(f"__{c}").alias(c) for c in PLACES])


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns that are named as helpers are under free names, and which names those are."""
    apart: dict[str, str] = {}
    for c in docs.columns:
        if c.startswith("__mix_"):
            free = f"kept {c}"
            while free in docs.columns or free in apart.values():
                free = f"kept {free}"
            apart[c] = free
    return docs.withColumnsRenamed(apart), apart


def _placed(docs, weights, source, key, block_rows, temperature, most_blocks) -> DataFrame:
    """``docs`` with the columns ``PLACES`` under names that begin with two underscores."""
    spark = docs.sparkSession
    name = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    counts = docs.groupBy(name.alias("__mix_name")).count()
    if any(not w > 0 for w in (weights or {}).values()):
        raise ValueError("a weight must be over 0")
    named = {("n" if k is None else "s" + k): float(w) for k, w in (weights or {}).items()}
    weight = F.pow(F.col("count").cast("double"), F.lit(temperature))
    if named:
        known = spark.createDataFrame(list(named.items()), "__mix_name string, w double")
        counts = counts.join(F.broadcast(known), "__mix_name", "left")  # as many rows as the caller names
        weight = F.coalesce(F.col("w"), F.lit(min(named.values())))
    top = counts.select("__mix_name", "count", weight.alias("w")).orderBy(F.desc("w"), "__mix_name").collect()  # a row a source
    sizes = [r["count"] for r in top]
    block_rows = max(block_rows, -(-sum(sizes) // most_blocks))
    plan = _plan_table(spark, exact_weights([r["w"] for r in top]) if top else [], [-(-n // block_rows) for n in sizes])
    buckets = [math.ceil(n / max(256, math.isqrt(n))) for n in sizes]
    places = _places_table(spark, [r["__mix_name"] for r in top], buckets)
    rows = docs.withColumn("__mix_name", name).join(places, "__mix_name")
    rows = rows.withColumn("__mix_hash", F.xxhash64(key)).withColumn("__mix_bucket", F.pmod("__mix_hash", F.col("__mix_buckets")).cast("int"))
    before = Window.partitionBy("__mix_group").orderBy("__mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("__mix_group", "__mix_bucket").count()
        .select("__mix_group", "__mix_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__mix_start"))
    )
    inside = Window.partitionBy("__mix_group", "__mix_bucket").orderBy("__mix_hash", key)
    numbered = (
        rows.withColumn("__mix_rank", F.row_number().over(inside) - 1)
        .join(starts, ["__mix_group", "__mix_bucket"])
        .withColumn("__mix_ordinal", F.col("__mix_start") + F.col("__mix_rank"))
        .withColumn("__mix_block", F.expr(f"__mix_ordinal div {block_rows}"))
    )
    return numbered.join(plan, ["__mix_group", "__mix_block"]).withColumn(
        "__mix_position", F.col("__mix_slot") * block_rows + F.pmod("__mix_ordinal", F.lit(block_rows))
    ).select(*[F.col(f"`{c}`") for c in docs.columns], "__mix_block", "__mix_slot", "__mix_position")


def _plan_table(spark: SparkSession, weights: list[int], blocks: list[int]) -> DataFrame:
    """``__mix_group, __mix_block, __mix_slot``, a row a block; Spark broadcasts it by its size or sorts."""
    flat = np.fromiter((v for row in block_schedule(weights, blocks) for v in row), np.int64).reshape(-1, 3)
    table = pa.table([flat[:, 0].astype(np.int32), flat[:, 1], flat[:, 2]], ["__mix_group", "__mix_block", "__mix_slot"])
    return spark.createDataFrame(table)


def _places_table(spark: SparkSession, names: list[str], buckets: list[int]) -> DataFrame:
    """``__mix_name, __mix_group, __mix_buckets``, a row a source."""
    return spark.createDataFrame([(name, g, n) for g, (name, n) in enumerate(zip(names, buckets, strict=True))], "__mix_name string, __mix_group int, __mix_buckets long")


def in_order(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` in the order of the mix: partitions hold ranges of positions, each sorted; adaptive execution joins small ones."""
    held, apart = _apart(docs)
    placed = _placed(held, weights, apart.get(source, source), apart.get(key, key), BLOCK_ROWS, TEMPERATURE, MOST_BLOCKS)
    ordered = placed.repartitionByRange("__mix_position").sortWithinPartitions("__mix_position")
    return ordered.select(*[F.col(f"`{apart.get(c, c)}`").alias(c) for c in docs.columns])
