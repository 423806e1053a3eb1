"""Species labels of reference genomes: by id, by id without version, by a pure cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peptrail.checks import once
from peptrail.functions.text import version_stripped

SOURCE = "UHGG"


def host_labels(labels: DataFrame) -> DataFrame:
    """``genome_id, species`` of the labels that come from the catalogue itself."""
    return labels.where(F.col("data_source") == SOURCE).select("genome_id", "species").dropDuplicates(["genome_id"])


def label_exact(genomes: DataFrame, labels: DataFrame) -> DataFrame:
    return genomes.select("genome_id").join(host_labels(labels), "genome_id")


def unique_bases(labels: DataFrame) -> DataFrame:
    """``genome_base, base_species`` of ids without version that stand for one species."""
    return (
        host_labels(labels).groupBy(version_stripped(F.col("genome_id")).alias("genome_base"))
        .agg(F.min("species").alias("base_species"), F.max("species").alias("other"))
        .where("base_species = other")
        .select("genome_base", "base_species")
    )


def direct_labels(genomes: DataFrame, labels: DataFrame) -> DataFrame:
    """``genomes`` with the label of their id, else of their id without version (``species``, ``mapping_source``)."""
    return (
        once(genomes, ["genome_id"], "the genome metadata").withColumn("genome_base", version_stripped(F.col("genome_id")))
        .join(host_labels(labels).withColumnRenamed("species", "exact_species"), "genome_id", "left")
        .join(unique_bases(labels), "genome_base", "left")
        .withColumn("species", F.coalesce("exact_species", "base_species"))
        .withColumn(
            "mapping_source",
            F.when(F.col("exact_species").isNotNull(), "genome_exact").when(F.col("base_species").isNotNull(), "genome_base").otherwise("unmapped"),
        )
        .drop("genome_base", "exact_species", "base_species")
    )


def label_base(genomes: DataFrame, labels: DataFrame) -> DataFrame:
    return direct_labels(genomes, labels).where(F.col("mapping_source") == "genome_base").select("genome_id", "species")


def modal_species(direct: DataFrame, min_purity: float) -> DataFrame:
    """Each cluster's most frequent label (ties by name), its share of the cluster's labels, and whether that is enough."""
    cluster = Window.partitionBy("species_rep")
    return (
        direct.where(F.col("species") != "")
        .groupBy("species_rep", "species").agg(F.count("*").alias("n_overlap"))
        .withColumn("n_cluster_overlap", F.sum("n_overlap").over(cluster))
        .withColumn("place", F.row_number().over(cluster.orderBy(F.desc("n_overlap"), F.asc("species"))))
        .where("place = 1")
        .withColumn("mapping_purity", F.col("n_overlap") / F.col("n_cluster_overlap"))
        .withColumn("mapping_accepted", F.col("mapping_purity") >= min_purity)
        .drop("place")
    )


def genome_labels(genomes: DataFrame, labels: DataFrame, min_purity: float) -> DataFrame:
    """``genomes`` with ``species_key`` and where it came from; a direct label is never overridden."""
    direct = direct_labels(genomes, labels)
    modal = modal_species(direct, min_purity).select(
        "species_rep", F.col("species").alias("cluster_modal_species"), "mapping_purity", "n_cluster_overlap",
        F.col("mapping_accepted").alias("cluster_fallback_accepted"),
    )
    fallback = F.col("species").isNull() & F.coalesce("cluster_fallback_accepted", F.lit(False))
    return (
        direct.join(modal, "species_rep", "left")
        .withColumn("species_key", F.when(fallback, F.col("cluster_modal_species")).otherwise(F.col("species")))
        .withColumn("mapping_source", F.when(fallback, "cluster_fallback").otherwise(F.col("mapping_source")))
        .withColumn("mapping_accepted", F.col("species_key").isNotNull())
        .drop("species")
    )


def with_quality(genomes: DataFrame, min_completeness: float, max_contamination: float) -> DataFrame:
    """``high_quality``: complete and clean enough; a missing value is not."""
    good = (F.col("completeness") >= min_completeness) & (F.col("contamination") <= max_contamination)
    known = ~F.isnan("completeness") & ~F.isnan("contamination")
    return genomes.withColumn("high_quality", F.coalesce(good & known, F.lit(False)))


def panel_genomes(labelled: DataFrame, panel: DataFrame) -> DataFrame:
    return labelled.join(panel.where("selected").select("species_key"), "species_key", "left_semi")


def species_genome_counts(genomes: DataFrame, panel: DataFrame) -> DataFrame:
    """The panel's species with their numbers of genomes by quality and by source of label; without genomes 0."""
    by_source = {f"n_mapped_{s}": F.sum((F.col("mapping_source") == s).cast("int")) for s in ("genome_exact", "genome_base", "cluster_fallback")}
    counts = genomes.groupBy("species_key").agg(
        F.count_distinct("genome_id").alias("n_uhgg_genomes_all"),
        F.sum(F.col("high_quality").cast("int")).alias("n_uhgg_genomes_hq"),
        F.min("mapping_purity").alias("cluster_mapping_purity_min"),
        F.min("n_cluster_overlap").alias("cluster_overlap_min"),
        F.count_distinct("species_rep").alias("n_uhgg_species_clusters"),
        *[v.alias(k) for k, v in by_source.items()],
    )
    zero = ["n_uhgg_genomes_all", "n_uhgg_genomes_hq", "n_uhgg_species_clusters", *by_source]
    return once(panel.where("selected"), ["species_key"], "the panel").join(counts, "species_key", "left").fillna(0, zero)


# -- aliases of genomes


def _aliases(genomes: DataFrame) -> DataFrame:
    given = F.array("genome_id", version_stripped(F.col("genome_id")), "original_genome_id", version_stripped(F.col("original_genome_id")))
    return (
        genomes.select("genome_id", F.explode(given).alias("alias"))
        .withColumn("alias", F.trim("alias"))
        .where((F.col("alias") != "") & ~F.lower("alias").isin("nan", "none"))
        .distinct()
        .groupBy("alias").agg(F.min("genome_id").alias("genome_id"), F.count("*").alias("n_genomes"))
    )


def alias_map(genomes: DataFrame) -> DataFrame:
    """``alias, genome_id`` of the names that stand for one genome."""
    return _aliases(genomes).where("n_genomes = 1").select("alias", "genome_id")


def ambiguous_aliases(genomes: DataFrame) -> DataFrame:
    return _aliases(genomes).where("n_genomes > 1").select("alias", "n_genomes")


def resolved(found: DataFrame, aliases: DataFrame) -> DataFrame:
    """``found`` (with a column alias) and ``genome_id``: of the alias, else of the alias without version, else null."""
    exact = aliases.select("alias", F.col("genome_id").alias("exact_genome"))
    base = aliases.select(F.col("alias").alias("alias_base"), F.col("genome_id").alias("base_genome"))
    return (
        found.withColumn("alias_base", version_stripped(F.col("alias")))
        .join(exact, "alias", "left").join(base, "alias_base", "left")
        .withColumn("genome_id", F.coalesce("exact_genome", "base_genome"))
        .drop("alias_base", "exact_genome", "base_genome")
    )


# -- what the panel covers in each sample


def panel_sample_qc(shares: DataFrame, samples: DataFrame, counts: DataFrame) -> DataFrame:
    """Each sample's abundance inside and outside the panel, and of panel species by their genomes."""
    kind = counts.select(F.col("species_key").alias("species"), "n_uhgg_genomes_all", "n_uhgg_genomes_hq")
    part = lambda test: F.coalesce(F.sum(F.when(test, F.col("abundance"))), F.lit(0.0))
    sums = shares.join(kind, "species").groupBy("sample_name").agg(
        F.sum("abundance").alias("panel_abundance"),
        part(F.col("n_uhgg_genomes_all") == 0).alias("panel_no_mapped_genomes_abundance"),
        part((F.col("n_uhgg_genomes_all") > 0) & (F.col("n_uhgg_genomes_hq") == 0)).alias("panel_no_hq_genomes_abundance"),
        part(F.col("n_uhgg_genomes_hq") > 0).alias("hq_species_abundance_before_membership_qc"),
    )
    out = samples.select("sample_name").join(sums, "sample_name", "left").fillna(0.0)
    return out.withColumn("outside_panel_abundance", 1 - F.col("panel_abundance"))


def hq_ceiling(shares: DataFrame, samples: DataFrame, labelled: DataFrame) -> DataFrame:
    """Each sample's abundance of species, in the panel or not, that have a high-quality genome."""
    held = labelled.where("high_quality and mapping_accepted").select(F.col("species_key").alias("species")).distinct()
    sums = shares.join(held, "species", "left_semi").groupBy("sample_name").agg(F.sum("abundance").alias("attainable"))
    return samples.select("sample_name").join(sums, "sample_name", "left").fillna(0.0)


def mapping_source_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("mapping_source").agg(F.count("*").alias("n_genomes"))


