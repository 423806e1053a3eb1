"""Watch a growing protein catalogue for a set of peptides.

    python -m jobs.watch_catalogue --tables FOLDER --out FOLDER --checkpoint FOLDER [--config FILE]

Each run scans the catalogue's files that came since the last one (a file stream with a checkpoint) and ends.
Four tables stand under ``--out``:

* ``peptides``: the candidates and the limit of Grantham's distance that the first run took; a later run with
  others is refused, for what was scanned before would lack them
* ``scanned/batch=N/kind=hit|ambiguous``: windows found in the files of one micro-batch
* ``counts/batch=N``: proteins, residues, hits and ambiguous windows of a micro-batch
* ``evidence/as_of=N``: what is known of each peptide after micro-batch N

A micro-batch that is run again after a failure overwrites its own partitions with the same rows, so nothing is
counted twice; a run without new files changes nothing. Protein records are scanned as they come: a record
delivered in two files counts twice, as two records of one file do.
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.inputs import CONFIGS, config_of, relation, shown_log, written
from peptrail.checks import require
from peptrail.operators.search import HIT_SCHEMA, scan
from peptrail.settings import TIERS
from peptrail.sources.fasta import checked_peptides

log = logging.getLogger("watch_catalogue")
SCANNED = HIT_SCHEMA + ", batch int, kind string"


def fixed_peptides(spark: SparkSession, peptides: DataFrame, cutoff: int, out: str) -> DataFrame:
    """The candidates of all runs: written by the first, compared by later ones."""
    asked = checked_peptides(peptides).withColumn("conservative_grantham_max", F.lit(cutoff))
    known = written(spark, f"{out}/peptides")
    if known is None:
        asked.write.mode("overwrite").parquet(f"{out}/peptides")
        known = spark.read.parquet(f"{out}/peptides")
        log.info("took %d peptides", known.count())
    else:
        known = known.select(*asked.columns)
        changed = known.exceptAll(asked).unionAll(asked.exceptAll(known))
        require(changed.isEmpty(), f"the peptides or the distance differ from those of the first run into {out}; watch them in a folder of their own")
    return known


def evidence(peptides: DataFrame, scanned: DataFrame, counts: DataFrame) -> DataFrame:
    """One row a peptide: hits in each tier, proteins, the fewest substitutions, and how much was searched."""
    hit = F.col("kind") == "hit"
    found = scanned.groupBy("peptide_id").agg(
        F.count_if(hit).alias("n_hits"), F.count_distinct(F.when(hit, F.col("protein_rep_id"))).alias("n_proteins"),
        F.count_if(~hit).alias("n_ambiguous"), F.min("n_substitutions").alias("least_substitutions"),
        *[F.coalesce(F.sum(t), F.lit(0)).alias(f"n_{t}") for t in TIERS],
    )
    searched = counts.agg(F.sum("proteins").alias("proteins_searched"), F.sum("residues").alias("residues_searched"))
    whole = ["n_hits", "n_proteins", "n_ambiguous", *[f"n_{t}" for t in TIERS]]
    return peptides.select("peptide_id", "sequence", "length").join(found, "peptide_id", "left").fillna(0, whole).crossJoin(searched)  # one row


def watch(spark: SparkSession, tables: str, out: str, checkpoint: str, config: dict) -> int:
    """Scan what is new in the catalogue; returns how many protein records that was."""
    cutoff = int(config.get("conservative_grantham_max", 50))
    peptides = fixed_peptides(spark, relation(spark, config, "peptides", tables), cutoff, out)
    catalogue = relation(spark, config, "proteins", tables, stream=config["stream"])
    new: list[int] = []

    def take(proteins: DataFrame, batch: int) -> None:
        read = Observation()
        kind = F.when(F.col("ambiguous"), "ambiguous").otherwise("hit")
        rows = scan(proteins, peptides, cutoff, read=read).withColumns({"batch": F.lit(batch), "kind": kind}).drop("ambiguous")
        own = {"partitionOverwriteMode": "dynamic"}
        rows.write.partitionBy("batch", "kind").mode("overwrite").options(**own).parquet(f"{out}/scanned")
        totals = read.get
        held = spark.read.schema(SCANNED).parquet(f"{out}/scanned").where(F.col("batch") == batch)
        hit = F.col("kind") == "hit"
        held.agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("ambiguous_windows")).select(
            F.lit(batch).alias("batch"), F.lit(totals["proteins"]).alias("proteins"), F.lit(totals["residues"]).cast("long").alias("residues"), "hits", "ambiguous_windows"
        ).write.partitionBy("batch").mode("overwrite").options(**own).parquet(f"{out}/counts")
        new.append(totals["proteins"])
        log.info("batch %d: read %d proteins of %d residues, wrote %s", batch, totals["proteins"], totals["residues"], f"{out}/scanned/batch={batch}")

    catalogue.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    counts = written(spark, f"{out}/counts")
    if counts is None:
        log.info("the catalogue is empty")
        return 0
    last = counts.agg(F.max("batch")).first()[0]
    made = evidence(peptides, spark.read.schema(SCANNED).parquet(f"{out}/scanned"), counts).withColumn("as_of", F.lit(last))
    made.write.partitionBy("as_of").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{out}/evidence")
    log.info("read %d new proteins; evidence of %d peptides stands in %s", sum(new), peptides.count(), f"{out}/evidence/as_of={last}")
    return sum(new)


def report(spark: SparkSession, out: str) -> DataFrame:
    """All that the runs found: each peptide's latest evidence with its hits; one row for a peptide without any."""
    known = spark.read.parquet(f"{out}/evidence")
    latest = known.join(known.agg(F.max("as_of").alias("as_of")), "as_of", "left_semi").drop("as_of")
    hits = spark.read.schema(SCANNED).parquet(f"{out}/scanned").where("kind = 'hit'")
    return latest.join(hits.select("peptide_id", "protein_rep_id", "protein_start_1based", "matched_sequence", "n_substitutions", "substitutions", "max_grantham"), "peptide_id", "left")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="watch_catalogue", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("tables", "out", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(CONFIGS / "watch_catalogue.json"))
    args = p.parse_args(argv)
    shown_log()
    spark = SparkSession.builder.appName("watch_catalogue").getOrCreate()
    try:
        watch(spark, args.tables, args.out, args.checkpoint, config_of(args.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
