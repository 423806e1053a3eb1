"""A study's relations as lazy DataFrames: every stage from inputs to coverage, shared by queries and runs."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Observation

from peptrail.operators import abundance as ab
from peptrail.operators import carriage as ca
from peptrail.operators import coverage as co
from peptrail.operators import labels as la
from peptrail.operators import search as se
from peptrail.plans.stages import staged
from peptrail.settings import Settings


@dataclass
class Study:
    abundance: DataFrame
    host: DataFrame
    genomes: DataFrame
    samples: DataFrame
    proteins: DataFrame
    peptides: DataFrame
    membership: DataFrame
    settings: Settings = field(default_factory=Settings)
    _read: Observation = field(default_factory=Observation, init=False)

    # -- preparation
    @cached_property
    def host_rows(self) -> DataFrame:
        """The taxonomy, dealt: a small file is few splits, and its lineages would be parsed by as few tasks."""
        return staged(self.host.repartition("genome_id"), "host_rows")

    @cached_property
    def genome_rows(self) -> DataFrame:
        """The genome metadata, dealt like the taxonomy."""
        return staged(self.genomes.repartition("genome_id"), "genome_rows")

    @cached_property
    def labels(self) -> DataFrame:
        return staged(ab.bacterial_labels(self.host_rows), "labels")

    @cached_property
    def prokaryotes(self) -> DataFrame:
        return ab.bulk_prokaryotes(self.abundance)

    @cached_property
    def labelled(self) -> DataFrame:
        return ab.labelled(self.prokaryotes, self.labels)

    @cached_property
    def _shares(self) -> DataFrame:
        return staged(ab.shares_and_totals(self.prokaryotes, self.labels), "shares")

    @cached_property
    def shares(self) -> DataFrame:
        return self._shares.drop("all_amount")

    @cached_property
    def fractions(self) -> DataFrame:
        return ab.labelled_fraction(self.prokaryotes, self.labels)

    @cached_property
    def included(self) -> DataFrame:
        return staged(ab.included_samples(self.shares, ab.sample_projects(self.samples), ab.fraction_of_shares(self._shares)), "included")

    @cached_property
    def stats(self) -> DataFrame:
        return ab.species_stats(self.shares, self.included)

    @cached_property
    def panel(self) -> DataFrame:
        return staged(ab.select_panel(self.stats, self.settings.target_community_coverage), "panel")

    @cached_property
    def genome_labels(self) -> DataFrame:
        found = la.genome_labels(self.genome_rows, self.labels, self.settings.cluster_mapping_min_purity)
        return staged(la.with_quality(found, self.settings.min_completeness, self.settings.max_contamination), "genome_labels")

    @cached_property
    def panel_genomes(self) -> DataFrame:
        return la.panel_genomes(self.genome_labels, self.panel)

    @cached_property
    def species_counts(self) -> DataFrame:
        return la.species_genome_counts(self.panel_genomes, self.panel)

    @cached_property
    def panel_qc(self) -> DataFrame:
        return la.panel_sample_qc(self.shares, self.included, self.species_counts)

    @cached_property
    def ceiling(self) -> DataFrame:
        return la.hq_ceiling(self.shares, self.included, self.genome_labels)

    # -- search
    @cached_property
    def aliases(self) -> DataFrame:
        return staged(la.alias_map(self.genome_rows), "aliases")

    @cached_property
    def inventory(self) -> DataFrame:
        return ca.membership_inventory(self.genome_rows, self.membership, self.aliases)

    @cached_property
    def evaluable(self) -> DataFrame:
        return staged(ca.evaluable_genomes(self.panel_genomes, self.inventory), "evaluable")

    @cached_property
    def scanned(self) -> DataFrame:
        return staged(se.scan(self.proteins, self.peptides, self.settings.conservative_grantham_max, read=self._read), "scanned")

    @cached_property
    def search_counts(self) -> DataFrame:
        return se.search_counts(self.scanned, self._read.get)

    @cached_property
    def hits(self) -> DataFrame:
        return se.hits(self.scanned)

    @cached_property
    def pairs(self) -> DataFrame:
        found = self.hits.select("protein_rep_id")
        return ca.rep_genome_pairs(ca.named_lines(self.membership, found), found, self.aliases, self.evaluable)

    @cached_property
    def presence(self) -> DataFrame:
        return ca.genome_presence(self.hits, self.pairs, self.evaluable)

    @cached_property
    def species(self) -> DataFrame:
        return staged(ca.species_evaluability(self.species_counts, self.evaluable), "species")

    @cached_property
    def breadth(self) -> DataFrame:
        return staged(ca.species_breadth(self.peptides, self.species, self.presence, self.settings), "breadth")

    @cached_property
    def examples(self) -> DataFrame:
        return se.hit_examples(self.hits, self.settings.sanity_hits_per_peptide)

    # -- summary
    @cached_property
    def quality(self) -> DataFrame:
        return staged(co.sample_evaluability(self.shares, self.included, self.panel_qc, self.species), "quality")

    @cached_property
    def quality_summary(self) -> DataFrame:
        return co.evaluability_summary(self.quality)

    @cached_property
    def patterns(self) -> tuple[DataFrame, DataFrame]:
        return co.patterns(self.breadth)

    @cached_property
    def sums(self) -> DataFrame:
        return co.pattern_sums(self.shares, self.quality, self.patterns[1])

    @cached_property
    def coverage(self) -> DataFrame:
        return co.coverage_measures(self.sums, self.patterns[0])

    @cached_property
    def summary(self) -> DataFrame:
        return staged(co.pattern_quantiles(self.sums, self.quality, self.patterns[0]), "summary")

    @cached_property
    def projects(self) -> DataFrame:
        return co.project_medians(self.summary)

    @cached_property
    def extended(self) -> DataFrame:
        return co.extended_summary(self.peptides, self.summary, self.projects, self.quality)

    @cached_property
    def concise(self) -> DataFrame:
        return co.concise_summary(self.extended)

    @cached_property
    def thresholds(self) -> DataFrame:
        return co.threshold_qc(self.peptides, self.summary, self.breadth)

    def abundance_matrix(self) -> DataFrame:
        return ab.abundance_matrix(self.shares, self.included, self.panel)
