"""From relative abundances of genomes to a normalised abundance of labelled bacterial species in each sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peptrail.checks import once, require_none, require_unique
from peptrail.functions.text import RANKS, lineage_rank, share
from peptrail.operators.ordered import running_sum


def with_ranks(host: DataFrame) -> DataFrame:
    """Host taxonomy with a column for each rank of the lineage."""
    return host.withColumns({name: lineage_rank(F.col("lineage_gtdb_r207_updated"), letter) for letter, name in RANKS.items()})


def bacterial_labels(host: DataFrame) -> DataFrame:
    """``genome_id, data_source, species`` of bacterial genomes that have a species."""
    return with_ranks(host).where((F.col("domain") == "Bacteria") & (F.col("species") != "")).select("genome_id", "data_source", "species")


def bulk_prokaryotes(abundance: DataFrame, check: bool = False) -> DataFrame:
    """Rows of bulk samples and prokaryotic genomes; on request, each amount must be finite and not negative."""
    rows = abundance.where((F.col("sample_type") == "bulk") & (F.col("genome_type") == "prok")).select("sample_name", "genome", "relative_abundance")
    if check:
        amount = F.col("relative_abundance")
        bad = amount.isNull() | F.isnan(amount) | (amount < 0) | (amount == float("inf"))
        require_none(rows, bad, "a bulk prokaryotic abundance is missing, infinite, negative or no number")
    return rows


def labelled(prokaryotes: DataFrame, labels: DataFrame) -> DataFrame:
    """``sample_name, species, relative_abundance``: summed over a species' genomes."""
    return (
        prokaryotes.join(once(labels.select(F.col("genome_id").alias("genome"), "species"), ["genome"], "the host taxonomy"), "genome")
        .groupBy("sample_name", "species")
        .agg(F.sum("relative_abundance").alias("relative_abundance"))
    )


def renormalised(amounts: DataFrame) -> DataFrame:
    """Labelled amounts as shares of their sample's total (``abundance``); samples without any go."""
    total = F.sum("relative_abundance").over(Window.partitionBy("sample_name"))
    return (
        amounts.withColumn("total", total).where(F.col("total") > 0)
        .select("sample_name", "species", "relative_abundance", (F.col("relative_abundance") / F.col("total")).alias("abundance"))
    )


def shares_and_totals(prokaryotes: DataFrame, labels: DataFrame) -> DataFrame:
    """``renormalised`` of ``labelled`` in one pass, with each sample's ``all_amount``, unlabelled genomes too."""
    known = once(labels.select(F.col("genome_id").alias("genome"), "species"), ["genome"], "the host taxonomy")
    amounts = prokaryotes.join(known, "genome", "left").groupBy("sample_name", "species").agg(F.sum("relative_abundance").alias("relative_abundance"))
    sample = Window.partitionBy("sample_name")
    total = F.sum(F.when(F.col("species").isNotNull(), F.col("relative_abundance"))).over(sample)
    return (
        amounts.withColumn("total", total).withColumn("all_amount", F.sum("relative_abundance").over(sample)).where("species is not null and total > 0")
        .select("sample_name", "species", "relative_abundance", (F.col("relative_abundance") / F.col("total")).alias("abundance"), "all_amount")
    )


def fraction_of_shares(shares: DataFrame) -> DataFrame:
    """``labelled_fraction`` of the samples of ``shares_and_totals``."""
    sums = shares.groupBy("sample_name").agg(F.sum("relative_abundance").alias("labelled_amount"), F.max("all_amount").alias("all_amount"))
    return sums.select("sample_name", share(F.col("labelled_amount"), F.col("all_amount")).alias("labelled_bacterial_fraction_of_input_prokaryotic_abundance"))


def labelled_fraction(prokaryotes: DataFrame, labels: DataFrame) -> DataFrame:
    """Each sample's labelled share of all its prokaryotic abundance; undefined where that is 0 or nothing is labelled."""
    known = labels.select(F.col("genome_id").alias("genome"), F.lit(1).alias("known"))
    return (
        prokaryotes.join(known, "genome", "left")
        .groupBy("sample_name")
        .agg(F.sum("relative_abundance").alias("all_amount"), F.sum(F.when(F.col("known") == 1, F.col("relative_abundance"))).alias("labelled_amount"))
        .select("sample_name", share(F.col("labelled_amount"), F.col("all_amount")).alias("labelled_bacterial_fraction_of_input_prokaryotic_abundance"))
    )


def project_conflicts(samples: DataFrame) -> DataFrame:
    """Samples that are given more than one project (a missing one counts as '')."""
    project = F.trim(F.coalesce("bioproject_id", F.lit("")))
    return samples.groupBy("sample_name").agg(F.count_distinct(project).alias("n_projects")).where(F.col("n_projects") > 1)


def sample_projects(samples: DataFrame, check: bool = False) -> DataFrame:
    """One row a sample: its project ('' if unknown) and how many rows of it there were."""
    if check:
        require_none(samples, F.coalesce(F.trim("sample_name"), F.lit("")) == "", "a sample has no name")
        require_none(project_conflicts(samples), F.lit(True), "samples have conflicting projects")
    project = F.trim(F.coalesce("bioproject_id", F.lit("")))
    return samples.groupBy("sample_name").agg(F.max(project).alias("bioproject_id"), F.count("*").alias("n_rows"))


def included_samples(shares: DataFrame, projects: DataFrame, fractions: DataFrame) -> DataFrame:
    """The samples with labelled abundance, their project and their labelled fraction."""
    return (
        shares.select("sample_name").distinct()
        .join(once(projects.select("sample_name", "bioproject_id"), ["sample_name"], "the sample metadata"), "sample_name", "left")
        .join(fractions, "sample_name", "left")
        .withColumn("bioproject_id", F.coalesce("bioproject_id", F.lit("")))
    )


def species_stats(shares: DataFrame, samples: DataFrame) -> DataFrame:
    """Abundance, prevalence and projects by species; samples without a species count as 0 in its mean."""
    n, there = F.col("__samples"), F.col("abundance") > 0
    return (
        shares.join(once(samples.select("sample_name", "bioproject_id"), ["sample_name"], "the included samples"), "sample_name")
        .groupBy(F.col("species").alias("species_key"))
        .agg(
            F.sum("abundance").alias("abundance_sum"),
            F.max("abundance").alias("max_abundance"),
            F.count_distinct(F.when(there, F.col("sample_name"))).alias("n_samples"),
            F.count_distinct(F.when(there & (F.col("bioproject_id") != ""), F.col("bioproject_id"))).alias("n_bioprojects_detected"),
        )
        .crossJoin(samples.agg(F.count("*").alias("__samples")))  # one row
        .select(
            "species_key", "abundance_sum", "max_abundance", (F.col("abundance_sum") / n).alias("mean_abundance"),
            (F.col("n_samples") / n).alias("prevalence_any"), "n_bioprojects_detected",
        )
    )


def select_panel(stats: DataFrame, target: float) -> DataFrame:
    """``stats`` with ``cumulative_mean_abundance`` and ``selected``: the smallest leading set that reaches the target.

    Species stand by falling mean, then by name. The running sum is taken within ranges of that order and then over
    the ranges, so no task gathers all species.
    """
    summed = running_sum(stats, "mean_abundance", (F.desc("mean_abundance"), F.asc("species_key")), "__reached", "cumulative_mean_abundance")
    return summed.select(*stats.columns, "cumulative_mean_abundance", (F.col("__reached") < target).alias("selected"))


def abundance_matrix(shares: DataFrame, samples: DataFrame, panel: DataFrame) -> DataFrame:
    """Included samples by panel species, wide, 0 where a sample has none of a species; for exports.

    The names of the panel's species, some hundreds, become columns.
    """
    names = [r.species_key for r in panel.where("selected").orderBy("species_key").select("species_key").collect()]
    wide = shares.groupBy("sample_name").pivot("species", names).agg(F.sum("abundance"))
    return samples.select("sample_name").join(wide, "sample_name", "left").fillna(0.0)


def check_host(host: DataFrame) -> None:
    require_unique(host, ["genome_id"], "the host taxonomy")
