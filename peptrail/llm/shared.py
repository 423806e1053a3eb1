"""Small pieces that several operators use: the shared folder, worker caches and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes that the cache of a Python worker may take
CACHE_BYTES = 64 << 20
#: longest word that is remembered; longer ones are worked out each time
CACHED_CHARS = 64

_HELD: dict[str, Callable[[], None]] = {}


def claim_cache(name: str, clear: Callable[[], None]) -> None:
    """Keep an operator's cache in this Python worker and drop those of other operators.

    Workers outlive stages, and the stages of a pipeline would else hold all their caches at once.
    """
    for other in [k for k in _HELD if k != name]:
        _HELD.pop(other)()
    _HELD[name] = clear


class WordCache:
    """Values of words, in at most about ``most`` bytes: a young half and an old one.

    Once the young half is full it becomes the old one; words met again move back to the young half.
    """

    ENTRY = 150  # a word and its value without their contents, and their place in a dict

    def __init__(self, most: int = CACHE_BYTES, weigh: Callable[[list], int] = lambda values: sum(map(len, values))):
        self.weigh = weigh
        self.half, self.young, self.old, self.size = most // 2, {}, {}, 0
        self.passing: list[str] = []

    def clear(self) -> None:
        self.young, self.old, self.size, self.passing = {}, {}, 0, []

    def holding(self, words: set[str], learn: Callable[[list[str]], list]) -> dict:
        """A dict that holds all these words for now; ``learn`` gives the values of new ones."""
        for w in self.passing:
            del self.young[w]
        self.passing = []
        new = words.difference(self.young)
        if not new:
            return self.young
        if self.size > self.half:
            self.old, self.young, self.size, new = self.young, {}, 0, words
        young, old = self.young, self.old
        again = list(new & old.keys())
        fresh = list(new.difference(again)) if again else list(new)
        values = [old[w] for w in again] + (learn(fresh) if fresh else [])
        again += fresh
        young.update(zip(again, values, strict=True))
        self.size += self.ENTRY * len(again) + 2 * sum(map(len, again)) + self.weigh(values)
        if max(map(len, fresh), default=0) > CACHED_CHARS:
            self.passing = [w for w in fresh if len(w) > CACHED_CHARS]
            self.size -= sum(self.ENTRY + 2 * len(w) for w in self.passing) + self.weigh([young[w] for w in self.passing])
        return young

    def bytes(self) -> int:
        """Bytes that words, values and the dicts take."""
        return sum(getsizeof(d) + sum(map(getsizeof, d)) + sum(map(getsizeof, d.values())) for d in (self.young, self.old))


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder; on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="peptrail-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def text_groups(batch: pa.RecordBatch, column: int = 1, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts take about ``most`` bytes together; one text at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


@contextmanager
def frugal(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted as soon as it is done, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def in_files(df: DataFrame, narrow: bool = False) -> DataFrame:
    """``df`` in as many partitions as it takes files; fewer stay as they are.

    Shuffle partitions are sized for sorting texts; a file takes four of them, of a ``narrow`` table, a few
    numbers a document, sixteen, as long as every core has one. For each file in a local folder Hadoop starts
    processes, and one that the JVM is just starting counts as large as the JVM.
    """
    spark = df.sparkSession
    cores, partitions = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(cores, partitions // 16) if narrow else max(2 * cores, partitions // 4))


def staged(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder, ``in_files``, and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df = in_files(df, narrow)
    with frugal(spark):
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``staged`` that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def min_components(nodes: DataFrame, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of long ids by alternating large-star and small-star steps.

    ``nodes(id)`` are all ids, ``links(a, b)`` undirected links. Returns ``(id, component)`` with the
    smallest reachable id. Every step takes only minima per key (combined before the shuffle) and
    equi-joins, so a hub with many links is never gathered. Each round is written to the shared
    folder, and what it read is deleted. Null ids take no part; duplicate links and self links are allowed.
    """
    edges = staged(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links", narrow=True,
    )
    # what is joined is written first: a join of two plain tables can be split where a hub is hot
    for _ in range(max_rounds):
        both = staged(edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both", narrow=True)
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low", narrow=True)
        # large star: every larger neighbour of u, and u itself, points at the least of them
        large = staged(
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionAll(low.where("u <> m").select("u", F.col("m").alias("v")))
            .distinct(),
            "large", narrow=True,
        )
        # small star: all smaller neighbours of u, and u itself, point at the least of them
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least", narrow=True)
        discard(edges, both, low)
        edges = staged(
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v")))
            .distinct(),
            "links", narrow=True,
        )
        discard(large, least)
        # done when every node points at one root and no root points anywhere
        n, sources = edges.agg(F.count("*"), F.countDistinct("u")).first()
        if n == sources and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return nodes.select("id").distinct().join(
        edges.select(F.col("u").alias("id"), F.col("v").alias("least")), "id", "left"
    ).select("id", F.coalesce("least", "id").alias("component"))
