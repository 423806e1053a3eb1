"""Stage tables: written once to the folder that driver and executors share, then read by everything after."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from peptrail.checks import require


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session that names none gets a temporary folder, on a cluster it is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        require(context.master.startswith("local") and not context.master.startswith("local-cluster"), "set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="peptrail-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


class Scratch:
    """Stage tables that are deleted once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.made: list[tuple[str, str]] = []

    def drop(self, *but: str) -> None:
        """Delete the tables made so far, except those with these names."""
        context = self.spark.sparkContext
        for name, path in [m for m in self.made if m[0] not in but]:
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
            self.made.remove((name, path))


_OPEN: list[Scratch] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Stage tables made inside are deleted at the end, and shuffle files as soon as what made them is done.

    For work that is written as a whole inside: what is still lazy at the end would read deleted tables.
    """
    made, before = Scratch(spark), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
        made.drop()


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table: its plan is cut, and what several relations use is computed once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].made.append((name, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
