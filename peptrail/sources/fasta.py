"""FASTA files as DataFrames, split-safe: a record starts at a line whose first sign is '>'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.checks import require, require_none, require_unique
from peptrail.functions.aminoacids import RESIDUES
from peptrail.settings import Settings
from peptrail.sinks.folders import find, first_character


def _sequence(body: Column, protein: bool) -> Column:
    plain = F.upper(F.regexp_replace(body, r"\s+", ""))
    return F.regexp_replace(plain, "[*]+$", "") if protein else plain


def parse_records(raw: DataFrame, column: str = "value", protein: bool = True) -> DataFrame:
    """``id, sequence`` of raw records (header line, then sequence lines, the leading '>' optional).

    The id is the header's first word; blanks and white space in sequences go, letters become capitals,
    and a protein loses its trailing '*'. A record without sequence lines has an empty one.
    """
    text = F.regexp_replace(F.col(column), "^\\s*>", "")
    header = F.regexp_extract(text, "^([^\\r\\n]*)", 1)
    body = F.regexp_replace(text, "^[^\\r\\n]*", "")
    return raw.select(F.regexp_extract(header, r"^\s*(\S+)", 1).alias("id"), _sequence(body, protein).alias("sequence"))


def cut_records(raw: DataFrame) -> DataFrame:
    """Raw records of text read with the line separator line feed and '>': cut at indented headers too, empty ones left out."""
    return raw.select(F.explode(F.split("value", "\n\\s*>")).alias("value")).where(F.col("value").rlike(r"\S"))


def read_fasta(spark: SparkSession, path: str, protein: bool = True, partitions: int | None = None) -> DataFrame:
    """Records of one file, a folder or a pattern; packed files are read by one task each, then dealt out again.

    A header may be indented. A file whose first text is no header is an error at once; a header
    without an id is one when the records are used.
    """
    files = find(spark, path)
    if partitions is None and any(f.name.endswith((".gz", ".bz2", ".zst")) for f in files):
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for file in files:
        require(first_character(spark, file.uri) in (">", ""), f"{file.uri} has text before its first header")
    records = parse_records(cut_records(spark.read.option("lineSep", "\n>").text(path)), protein=protein)
    checked = records.withColumn(
        "id", F.when(F.col("id") == "", F.raise_error(F.lit("a FASTA header has no id")).cast("string")).otherwise(F.col("id"))
    )
    if partitions:
        checked = checked.repartition(partitions)
    return checked


def peptide_problems(peptides: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``peptides(peptide_id, sequence)`` with ``length, n_same_id, bad_residues, length_ok, valid``."""
    same = peptides.groupBy("peptide_id").agg(F.count("*").alias("n_same_id"))
    bad = F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace("sequence", f"[{RESIDUES}]", ""), ""))), ",")
    size = F.length("sequence")
    return (
        peptides.join(same, "peptide_id")
        .withColumn("length", size)
        .withColumn("bad_residues", bad)
        .withColumn("length_ok", size.between(settings.min_peptide_length, settings.max_peptide_length))
        .withColumn("valid", (F.col("n_same_id") == 1) & (F.col("bad_residues") == "") & F.col("length_ok"))
        .select("peptide_id", "sequence", "length", "n_same_id", "bad_residues", "length_ok", "valid")
    )


def checked_peptides(peptides: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Valid candidates ``peptide_id, sequence, length``, or an error that names the first problems."""
    require(not peptides.isEmpty(), "there are no candidate peptides")
    require_unique(peptides, ["peptide_id"], "the candidate peptides")
    found = peptide_problems(peptides, settings)
    require_none(found, F.col("bad_residues") != "", "a candidate holds other than the standard residues")
    require_none(found, ~F.col("length_ok"), "a candidate's length is outside the range")
    return found.select("peptide_id", "sequence", F.col("length").cast("int").alias("length"))


def read_peptides(spark: SparkSession, path: str, settings: Settings = Settings()) -> DataFrame:
    return checked_peptides(read_fasta(spark, path, protein=False).withColumnRenamed("id", "peptide_id"), settings)
