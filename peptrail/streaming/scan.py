"""The protein scan over a growing folder of FASTA files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from peptrail.operators.search import scan
from peptrail.sources.fasta import cut_records, parse_records


def protein_stream(spark: SparkSession, folder: str, files_a_batch: int = 64) -> DataFrame:
    """``protein_rep_id, sequence`` of FASTA files as they arrive in a folder."""
    raw = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_a_batch).text(folder)
    return parse_records(cut_records(raw)).withColumnRenamed("id", "protein_rep_id")


def stream_hits(proteins: DataFrame, peptides: DataFrame, out: str, checkpoint: str, cutoff: int = 50) -> StreamingQuery:
    """Append the scan's rows of each micro-batch to Parquet, once each; ends when what is there is done."""
    return (
        scan(proteins, peptides, cutoff).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
