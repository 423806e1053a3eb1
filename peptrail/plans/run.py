"""The three stages of a run from files to summaries: prepare, search, summarize.

Every stage writes Parquet tables, their tab-separated exports (``exports/``) and a receipt into the run's
folder, on any file system that Spark writes; a later stage reads those tables and refuses to go on if what
it needs was changed or made with other settings.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from peptrail.checks import require, require_none, require_unique
from peptrail.operators import abundance as ab
from peptrail.operators import carriage as ca
from peptrail.operators import coverage as co
from peptrail.operators import labels as la
from peptrail.operators import search as se
from peptrail.plans.stages import staged
from peptrail.settings import TIERS, Settings
from peptrail.sinks import manifests as mf
from peptrail.sinks.export import listed, write_tsv, write_workbook
from peptrail.sinks.folders import Folder, find
from peptrail.sources import fasta, tables


@dataclass(frozen=True)
class Inputs:
    peptides: str
    relative_abundance: str | None = None
    sample_metadata: str | None = None
    host_genomes_info: str | None = None
    uhgg_metadata: str | None = None
    uhgp_faa: str | None = None
    uhgp_membership: str | None = None


#: exports of a few rows, as one file
SMALL = ("concise_summary", "extended_summary", "evaluability_summary", "broad_hq_threshold_qc", "hit_examples")


class Run:
    def __init__(self, spark: SparkSession, inputs: Inputs, outdir: str, settings: Settings = Settings(), reuse: bool = False):
        self.spark, self.inputs, self.settings, self.reuse = spark, inputs, settings, reuse
        self.folder = Folder(spark, outdir)
        self._known: dict[tuple, dict] = {}

    # -- stage tables
    def _write(self, df: DataFrame, name: str, export: bool = True) -> DataFrame:
        df.write.mode("overwrite").parquet(self.folder.uri(name))
        table = self.table(name)
        if export:
            small = name in SMALL
            write_tsv(table, self.folder.uri(f"exports/{name}"), one_file=small, gzip=not small)
        return table

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.folder.uri(name))

    def _peptides(self) -> DataFrame:
        return fasta.read_peptides(self.spark, self.inputs.peptides, self.settings)

    def _identity(self, name: str, whole: bool = True) -> dict:
        """An input's identity, taken once as long as its files keep their sizes and times."""
        pattern = getattr(self.inputs, name)
        key = (pattern, whole, tuple(find(self.spark, pattern)))
        if key not in self._known:
            self._known[key] = mf.identity(self.spark, pattern, whole)
        return self._known[key]

    def _prepare_inputs(self) -> dict:
        names = ("peptides", "relative_abundance", "sample_metadata", "host_genomes_info", "uhgg_metadata")
        kept = ("target_community_coverage", "min_completeness", "max_contamination", "cluster_mapping_min_purity")
        return {
            "sources": {n: self._identity(n) for n in names},
            "parameters": {k: v for k, v in asdict(self.settings).items() if k in kept} | {"labels": "genome, then version-free id, then pure cluster"},
        }

    def _inventory_inputs(self) -> dict:
        return {"membership": self._identity("uhgp_membership", whole=False), "uhgg_metadata": self._identity("uhgg_metadata")}

    def _scan_inputs(self, peptides: DataFrame) -> dict:
        return {
            "peptides": mf.table_digest(peptides.select("peptide_id", "sequence")), "proteins": self._identity("uhgp_faa", whole=False),
            "conservative_grantham_max": self.settings.conservative_grantham_max,
        }

    def standing(self) -> dict[str, bool]:
        """Which finished stages a run with these inputs and settings would take over.

        The mapping of hits to genomes is not among them: what it needs is known once the scan is done.
        """
        needs = {"prepare": self._prepare_inputs(), "inventory": self._inventory_inputs(), "scan": self._scan_inputs(self._peptides())}
        return {stage: mf.stands(self.folder, stage, needed) for stage, needed in needs.items()}

    # -- prepare
    def prepare(self) -> None:
        inputs = self._prepare_inputs()
        if self.reuse and mf.stands(self.folder, "prepare", inputs):
            return
        mf.tear(self.folder, "prepare")
        s, spark = self.settings, self.spark
        peptides = self._write(self._peptides(), "candidate_peptides")
        host = tables.read_host(spark, self.inputs.host_genomes_info)
        labels = ab.bacterial_labels(host)
        prok = ab.bulk_prokaryotes(tables.read_abundance(spark, self.inputs.relative_abundance), check=True)
        shares = self._write(ab.renormalised(ab.labelled(prok, labels)), "species_abundance", export=False)
        require(not shares.isEmpty(), "no labelled bacterial abundance is left")
        projects = ab.sample_projects(tables.read_samples(spark, self.inputs.sample_metadata), check=True)
        samples = self._write(ab.included_samples(shares, projects, ab.labelled_fraction(prok, labels)), "included_samples")
        panel = self._write(ab.select_panel(ab.species_stats(shares, samples), s.target_community_coverage), "all_species_abundance")
        metadata, found = tables.read_metadata(spark, self.inputs.uhgg_metadata)
        direct = la.direct_labels(metadata, labels)
        self._write(la.modal_species(direct, s.cluster_mapping_min_purity), "cluster_mapping")
        genomes = self._write(la.with_quality(la.genome_labels(metadata, labels, s.cluster_mapping_min_purity), s.min_completeness, s.max_contamination), "genome_labels")
        chosen = self._write(la.panel_genomes(genomes, panel), "selected_genomes")
        counts = self._write(la.species_genome_counts(chosen, panel), "selected_species")
        quality = self._write(la.panel_sample_qc(shares, samples, counts), "preparation_sample_qc")
        self._write(ab.abundance_matrix(shares, samples, panel), "selected_species_abundance_matrix")
        ceiling = la.hq_ceiling(shares, samples, genomes)
        stat = lambda df, c: {k: v for k, v in co.statistics(df, [c]).first().asDict().items() if k != "metric"}
        self.folder.write_json("preparation_diagnostics.json", {
            "bulk_metagenome_samples_n": samples.count(), "selected_species_n": counts.count(),
            "target_community_coverage": s.target_community_coverage,
            "panel_coverage": stat(quality, "panel_abundance"),
            "all_species_hq_mappable_abundance_before_membership_qc": stat(ceiling, "attainable"),
            "samples_excluded_no_labelled_bacterial_abundance": prok.select("sample_name").distinct().count() - samples.count(),
            "samples_missing_bioproject": samples.where("bioproject_id = ''").count(),
            "sample_metadata_duplicate_rows_collapsed": projects.agg(F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0))).first()[0],
            "high_quality_definition": {"min_completeness": s.min_completeness, "max_contamination": s.max_contamination},
            "mapped_genomes_by_source": {r.mapping_source: r.n_genomes for r in la.mapping_source_counts(genomes).collect()},
            "uhgg_metadata_detected_columns": found, "candidate_peptides_n": peptides.count(),
        })
        names = ["candidate_peptides", "species_abundance", "included_samples", "all_species_abundance", "cluster_mapping", "genome_labels", "selected_genomes",
                 "selected_species", "selected_species_abundance_matrix", "preparation_sample_qc", "preparation_diagnostics.json"]
        mf.give(self.folder, "prepare", inputs, names)

    def _prepared(self) -> dict:
        inputs = mf.needed_by(self.folder, "prepare")
        given, held = self._peptides(), self.table("candidate_peptides")
        require(given.exceptAll(held).isEmpty() and held.exceptAll(given).isEmpty(), "the candidate peptides differ from the prepared ones; run prepare again")
        return inputs

    # -- search
    def search(self) -> None:
        prepared = self._prepared()
        s, folder = self.settings, self.folder
        require(self._identity("uhgg_metadata") == prepared["sources"]["uhgg_metadata"], "the genome metadata differ from the prepared ones")
        mf.tear(folder, "search")
        peptides = self.table("candidate_peptides")
        metadata, _ = tables.read_metadata(self.spark, self.inputs.uhgg_metadata)
        aliases = la.alias_map(metadata)
        lines = tables.read_membership(self.spark, self.inputs.uhgp_membership)
        inventory_inputs = self._inventory_inputs()
        if not (self.reuse and mf.stands(folder, "inventory", inventory_inputs)):
            mf.tear(folder, "inventory")
            inventory = self._write(ca.membership_inventory(metadata, lines, aliases), "genome_inventory")
            require(not inventory.where("in_uhgp_membership").isEmpty(), "the membership names no genome of the metadata")
            unknown = ca.unresolved_aliases(lines, aliases)
            folder.write_json("inventory_qc.json", ca.inventory_counts(lines).first().asDict() | {
                "resolved_genomes_n": inventory.where("in_uhgp_membership").count(), "unresolved_recognized_alias_n": unknown.count(),
                "unresolved_alias_examples": [r.alias for r in unknown.orderBy("alias").limit(50).collect()],
            })
            mf.give(folder, "inventory", inventory_inputs, ["genome_inventory", "inventory_qc.json"])
        genomes = ca.evaluable_genomes(self.table("selected_genomes"), self.table("genome_inventory"))
        require_none(genomes, F.col("in_uhgp_membership").isNull(), "the inventory does not cover all selected genomes")
        genomes = self._write(genomes, "selected_genome_membership")
        scan_inputs = self._scan_inputs(peptides)
        if not (self.reuse and mf.stands(folder, "scan", scan_inputs)):
            mf.tear(folder, "scan")
            proteins = fasta.read_fasta(self.spark, self.inputs.uhgp_faa).withColumnRenamed("id", "protein_rep_id")
            read = Observation()
            scanned = self._write(se.scan(proteins, peptides, s.conservative_grantham_max, read=read), "scanned_windows")
            folder.write_json("search_qc.json", se.search_counts(scanned, read.get).first().asDict())
            mf.give(folder, "scan", scan_inputs, ["scanned_windows", "search_qc.json"])
        hits = se.hits(self.table("scanned_windows"))
        representatives = hits.select("protein_rep_id").distinct()
        # the membership's pass for hits: taken over where the same proteins were hit and the same genomes selected
        mapping_inputs = inventory_inputs | {"representatives": mf.table_digest(representatives), "genomes": mf.table_digest(genomes.select("genome_id"))}
        if not (self.reuse and mf.stands(folder, "mapping", mapping_inputs)):
            mf.tear(folder, "mapping")
            named = ca.named_lines(lines, representatives)
            missing = ca.missing_representatives(named, representatives)
            n, lost = representatives.count(), missing.count()
            folder.write_json("membership_mapping_qc.json", {
                "hit_representatives_n": n, "hit_representatives_seen_n": n - lost, "missing_hit_representatives_n": lost,
                "hit_representatives_seen_fraction": (n - lost) / n if n else None,
                "missing_hit_representative_examples": [r[0] for r in missing.orderBy("protein_rep_id").limit(20).collect()],
            })
            require(lost == 0, f"{lost} of {n} hit proteins are not in the membership; see membership_mapping_qc.json")
            self._write(ca.rep_genome_pairs(named, representatives, aliases, genomes), "hit_rep_to_selected_genome")
            mf.give(folder, "mapping", mapping_inputs, ["hit_rep_to_selected_genome", "membership_mapping_qc.json"])
        pairs = self.table("hit_rep_to_selected_genome")
        presence = self._write(ca.genome_presence(hits, pairs, genomes), "peptide_genome_tier_presence")
        species = self._write(ca.species_evaluability(self.table("selected_species"), genomes), "species_evaluability")
        self._write(ca.species_breadth(peptides, species, presence, s), "peptide_species_breadth")
        self._write(se.hit_examples(hits, s.sanity_hits_per_peptide), "hit_examples")
        folder.write_json("search_breadth_qc.json", {
            "conservative_grantham_max": s.conservative_grantham_max, "broad_breadth": s.broad_breadth, "min_hq_genomes_for_broad": s.min_hq_genomes_for_broad,
            "selected_hq_genomes": genomes.where("high_quality").count(), "selected_evaluable_hq_genomes": genomes.where("evaluable_hq").count(),
        })
        names = ["selected_genome_membership", "species_evaluability", "peptide_species_breadth", "hit_examples", "peptide_genome_tier_presence", "search_breadth_qc.json"]
        needed = {"preparation": prepared, "scan": scan_inputs, "inventory": inventory_inputs, "broad_breadth": s.broad_breadth, "min_hq_genomes_for_broad": s.min_hq_genomes_for_broad}
        mf.give(folder, "search", needed, names)

    def _check_samples(self) -> None:
        """Each stage table must speak of the same samples, each once."""
        held = {n: self.table(n).select("sample_name") for n in ("included_samples", "selected_species_abundance_matrix", "preparation_sample_qc")}
        for name, samples in held.items():
            require_unique(samples, ["sample_name"], name)
        first, *others = held.items()
        for name, samples in others:
            for a, b in ((first[1], samples), (samples, first[1])):
                require_none(a.join(b, "sample_name", "left_anti"), F.lit(True), f"the samples of {first[0]} and {name} differ; run prepare again")
        require_none(
            self.table("species_abundance").join(held["included_samples"], "sample_name", "left_anti"), F.lit(True), "an abundance belongs to no included sample; run prepare again"
        )

    # -- summarize
    def summarize(self, expect: dict | None = None) -> list[str]:
        """Write all summaries; ``expect`` holds settings that the search must have had. Returns warnings."""
        prepared, folder = self._prepared(), self.folder
        inputs = mf.needed_by(folder, "search")
        require(inputs["preparation"] == prepared, "the preparation changed since the search; run search again")
        searched = folder.read_json("search_breadth_qc.json")
        for name, value in (expect or {}).items():
            require(value is None or searched[name] == value, f"{name} was {searched[name]} in the search")
        warnings = [] if searched["selected_evaluable_hq_genomes"] else ["no high-quality genome can be evaluated; coverage has no support"]
        shares, samples, peptides = self.table("species_abundance"), self.table("included_samples"), self.table("candidate_peptides")
        breadth, species = self.table("peptide_species_breadth"), self.table("species_evaluability")
        self._check_samples()
        require(breadth.count() == peptides.count() * species.count(), "the grid of peptides and species is incomplete")
        for t in TIERS:
            b = F.col(f"breadth_hq_{t}")
            require_none(breadth, (b < 0) | (b > 1), "a breadth is outside [0, 1]")
        quality = self._write(co.sample_evaluability(shares, samples, self.table("preparation_sample_qc"), species, check=True), "sample_evaluability")
        members, patterns = co.patterns(breadth)
        sums = co.pattern_sums(shares, quality, patterns)
        coverage = self._write(co.coverage_measures(sums, members), "peptide_sample_coverage")
        found = staged(co.pattern_quantiles(sums, quality, members), "summary")
        projects = self._write(co.project_medians(found), "bioproject_coverage")
        extended = self._write(co.extended_summary(peptides, found, projects, quality), "extended_summary")
        concise = self._write(co.concise_summary(extended), "concise_summary")
        thresholds = self._write(co.threshold_qc(peptides, found, breadth), "broad_hq_threshold_qc")
        summary = self._write(co.evaluability_summary(quality), "evaluability_summary")
        notes = {
            "prepared": folder.read_json("preparation_diagnostics.json"), "search": searched, "protein_search_qc": folder.read_json("search_qc.json"),
            "membership_inventory": folder.read_json("inventory_qc.json"), "hit_mapping": folder.read_json("membership_mapping_qc.json"),
            "samples_zero_evaluable_n": quality.where("evaluable_species_abundance = 0").count(), "warnings": warnings,
        }
        folder.write_json("run_diagnostics.json", notes)
        facts = self.spark.createDataFrame(listed(notes), "parameter string, value string")
        sheets = {
            "Concise summary": (concise, "concise_summary"), "Extended summary": (extended, "extended_summary"), "Evaluability": (summary, "evaluability_summary"),
            "Species breadth": (breadth, "peptide_species_breadth"), "Selected species QC": (species, "species_evaluability"),
            "Sample evaluability": (quality, "sample_evaluability"), "Per-sample coverage": (coverage, "peptide_sample_coverage"),
            "Project coverage": (projects, "bioproject_coverage"), "Broad carrier QC": (thresholds, "broad_hq_threshold_qc"),
            "Hit examples": (self.table("hit_examples"), "hit_examples"), "Run & QC": (facts, "run_diagnostics.json"),
        }
        exported = {title: (df, f"exports/{name}" if "." not in name else name) for title, (df, name) in sheets.items()}
        write_workbook(folder, "summary.xlsx", exported, self.settings.excel_max_rows)
        return warnings

    def all(self) -> list[str]:
        self.prepare()
        self.search()
        return self.summarize()
