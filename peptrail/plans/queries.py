"""Registered queries over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.functions.aminoacids import DISTANCE, RESIDUES
from peptrail.functions.text import RANKS
from peptrail.operators import abundance as ab
from peptrail.operators import carriage as ca
from peptrail.operators import coverage as co
from peptrail.operators import labels as la
from peptrail.operators import search as se
from peptrail.plans.fixtures import Fixtures, duckdb_views
from peptrail.plans.study import Study
from peptrail.settings import TIERS
from peptrail.plans.stages import shared_folder
from peptrail.sinks.export import leaves, listed, omitted_rows
from peptrail.sources import tables
from peptrail.sources.fasta import parse_records, peptide_problems, read_fasta

DIGITS = 8


def study(spark: SparkSession, folder: str) -> Study:
    f = Fixtures(spark, folder)
    return Study(f.abundance, f.host, f.genomes, f.samples, f.proteins, f.peptides, f.membership)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to eight digits (sums differ in the last bit by partition), whole numbers as bigint."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        out.append(F.round(c, DIGITS).alias(name) if kind == "double" else c.cast("long").alias(name) if kind == "int" else c)
    return df.select(*out)


def _sql_rounded(columns: dict[str, str], source: str) -> str:
    shown = {"d": "round({0}, 8)", "i": "cast({0} as bigint)", "s": "{0}"}
    return "select " + ", ".join(f"{shown[k].format(_name(n))} as {_name(n)}" for n, k in columns.items()) + f" from {source}"


def _name(n: str) -> str:
    return f'"{n}"' if n in ("order", "offset", "class") else n


def _kinds(text: str) -> dict[str, str]:
    """'a:s b:d' as names and kinds."""
    return dict(p.split(":") for p in text.split())


def _clip(x: str) -> str:
    return f"case when {x} is not null then greatest(0e0, least(1e0, {x})) end"


_LINEAGE = ", ".join(
    f"trim(coalesce(list_extract(regexp_extract_all(lineage_gtdb_r207_updated, '(?:^|;)\\s*{c}__([^;]*)', 1), -1), '')) as \"{n}\"" for c, n in RANKS.items()
)
_TIER_TESTS = {
    "exact": "n_substitutions = 0", "cons_le1": "n_substitutions <= 1 and n_nonconservative = 0", "cons_le2": "n_substitutions <= 2 and n_nonconservative = 0",
    "cons_le3": "n_nonconservative = 0", "unrestricted_le1": "n_substitutions <= 1", "unrestricted_le2": "n_substitutions <= 2",
}
_GRANTHAM = ", ".join(f"('{a}', '{b}', {DISTANCE[i, j]})" for i, a in enumerate(RESIDUES) for j, b in enumerate(RESIDUES) if i != j)
_each = lambda text: ", ".join(text.format(t=t) for t in TIERS)

#: relations in order of use; each may name the ones before it
RELATIONS = {
    **duckdb_views(),
    "ranks": f"select *, {_LINEAGE} from fx_host",
    "labels": "select genome_id, data_source, species from ranks where domain = 'Bacteria' and species <> ''",
    "prok": "select sample_name, genome, relative_abundance from fx_abundance where sample_type = 'bulk' and genome_type = 'prok'",
    "labelled": "select sample_name, species, sum(relative_abundance) as relative_abundance from prok join labels on genome = genome_id group by all",
    "totals": "select sample_name, sum(relative_abundance) as total from labelled group by all having sum(relative_abundance) > 0",
    "shares": "select sample_name, species, relative_abundance, relative_abundance / total as abundance from labelled join totals using (sample_name)",
    "fractions": """select sample_name, sum(relative_abundance) filter (where genome_id is not null) / nullif(sum(relative_abundance), 0) as fraction
        from prok left join labels on genome = genome_id group by sample_name""",
    "projects": """select sample_name, max(trim(coalesce(bioproject_id, ''))) as bioproject_id, count(*) as n_rows from fx_samples group by sample_name""",
    "included": """select t.sample_name, coalesce(p.bioproject_id, '') as bioproject_id, fraction from totals t
        left join projects p using (sample_name) left join fractions using (sample_name)""",
    "stats": """select species as species_key, sum(abundance) as abundance_sum, max(abundance) as max_abundance,
        sum(abundance) / (select count(*) from included) as mean_abundance,
        count(distinct case when abundance > 0 then sample_name end) / (select count(*) from included) as prevalence_any,
        count(distinct case when abundance > 0 and bioproject_id <> '' then bioproject_id end) as n_bioprojects_detected
        from shares join included using (sample_name) group by species""",
    "summed": "select *, sum(mean_abundance) over (order by mean_abundance desc, species_key rows unbounded preceding) as cumulative_mean_abundance from stats",
    "panel": "select *, coalesce(lag(cumulative_mean_abundance) over (order by mean_abundance desc, species_key), 0) < 0.95 as selected from summed",
    "catalogue": "select distinct genome_id, species from labels where data_source = 'UHGG'",
    "bases": """select regexp_replace(genome_id, '[.][0-9]+$', '') as genome_base, min(species) as species from catalogue group by 1 having min(species) = max(species)""",
    "direct": """select u.*, coalesce(e.species, b.species) as species,
        case when e.species is not null then 'genome_exact' when b.species is not null then 'genome_base' else 'unmapped' end as direct_source
        from fx_uhgg u left join catalogue e using (genome_id) left join bases b on regexp_replace(u.genome_id, '[.][0-9]+$', '') = b.genome_base""",
    "label_counts": "select species_rep, species, count(*) as n_overlap, sum(count(*)) over (partition by species_rep) as n_cluster_overlap from direct where species <> '' group by 1, 2",
    "modal": """select species_rep, species, n_overlap, n_cluster_overlap, n_overlap / n_cluster_overlap as mapping_purity,
        n_overlap / n_cluster_overlap >= 0.9 as mapping_accepted from label_counts
        qualify row_number() over (partition by species_rep order by n_overlap desc, species) = 1""",
    "genomes": """select d.genome_id, d.original_genome_id, d.species_rep, completeness, contamination,
        case when d.species is null and mapping_accepted then m.species else d.species end as species_key,
        case when d.species is null and mapping_accepted then 'cluster_fallback' else direct_source end as mapping_source,
        m.species as cluster_modal_species, mapping_purity, n_cluster_overlap, mapping_accepted as cluster_fallback_accepted,
        coalesce(completeness >= 90 and contamination <= 5, false) as high_quality
        from direct d left join modal m using (species_rep)""",
    "panel_genomes": "select * from genomes where species_key in (select species_key from panel where selected)",
    "counts": """select species_key, count(distinct genome_id) as n_all, sum(high_quality::int) as n_hq, min(mapping_purity) as purity, min(n_cluster_overlap) as overlap,
        count(distinct species_rep) as n_clusters, sum((mapping_source = 'genome_exact')::int) as n_exact, sum((mapping_source = 'genome_base')::int) as n_base,
        sum((mapping_source = 'cluster_fallback')::int) as n_fallback from panel_genomes group by 1""",
    "species_counts": """select p.*, coalesce(n_all, 0) as n_uhgg_genomes_all, coalesce(n_hq, 0) as n_uhgg_genomes_hq, purity as cluster_mapping_purity_min,
        overlap as cluster_overlap_min, coalesce(n_clusters, 0) as n_uhgg_species_clusters, coalesce(n_exact, 0) as n_mapped_genome_exact,
        coalesce(n_base, 0) as n_mapped_genome_base, coalesce(n_fallback, 0) as n_mapped_cluster_fallback
        from panel p left join counts using (species_key) where selected""",
    "panel_qc": """select i.sample_name, coalesce(sum(abundance) filter (where c.species_key is not null), 0) as panel_abundance,
        1 - coalesce(sum(abundance) filter (where c.species_key is not null), 0) as outside_panel_abundance,
        coalesce(sum(abundance) filter (where n_uhgg_genomes_all = 0), 0) as panel_no_mapped_genomes_abundance,
        coalesce(sum(abundance) filter (where n_uhgg_genomes_all > 0 and n_uhgg_genomes_hq = 0), 0) as panel_no_hq_genomes_abundance,
        coalesce(sum(abundance) filter (where n_uhgg_genomes_hq > 0), 0) as hq_species_abundance_before_membership_qc
        from included i left join shares s using (sample_name) left join species_counts c on s.species = c.species_key group by 1""",
    "alias_all": """select alias, min(genome_id) as genome_id, count(distinct genome_id) as n_genomes from (
        select genome_id, trim(unnest([genome_id, regexp_replace(genome_id, '[.][0-9]+$', ''), original_genome_id, regexp_replace(original_genome_id, '[.][0-9]+$', '')])) as alias
        from fx_uhgg) where alias <> '' and lower(alias) not in ('nan', 'none') group by alias""",
    "alias_map": "select alias, genome_id from alias_all where n_genomes = 1",
    "line_alias": "select distinct unnest(regexp_extract_all(line, '(MGYG[0-9]{9}(?:[.][0-9]+)?|GUT_GENOME[0-9]{6,9})', 1)) as alias from fx_membership",
    "line_genome": """select l.alias, coalesce(e.genome_id, b.genome_id) as genome_id from line_alias l left join alias_map e using (alias)
        left join alias_map b on regexp_replace(l.alias, '[.][0-9]+$', '') = b.alias""",
    "inventory": "select genome_id, genome_id in (select genome_id from line_genome where genome_id is not null) as in_uhgp_membership from fx_uhgg",
    "seeds": """select peptide_id, p as part, p * (length(sequence) // 4) + least(p, length(sequence) % 4) as start,
        substr(sequence, cast(p * (length(sequence) // 4) + least(p, length(sequence) % 4) + 1 as bigint), cast(length(sequence) // 4 + (p < length(sequence) % 4)::int as bigint)) as seed
        from fx_peptides, (select unnest(range(4)) as p)""",
    "kmers": """select protein_rep_id, sequence, spot, substr(sequence, spot, 3) as head
        from (select protein_rep_id, sequence, unnest(range(1, length(sequence) - 1)) as spot from fx_proteins)""",
    "proposed": """select distinct s.peptide_id, k.protein_rep_id, k.spot - s.start as place from kmers k join seeds s
        on k.head = substr(s.seed, 1, 3) and substr(k.sequence, k.spot, length(s.seed)) = s.seed""",
    "windows": """select p.peptide_id, q.sequence as query_sequence, p.protein_rep_id, p.place as protein_start_1based,
        substr(r.sequence, p.place, length(q.sequence)) as matched_sequence
        from proposed p join fx_peptides q using (peptide_id) join fx_proteins r using (protein_rep_id)
        where p.place >= 1 and p.place + length(q.sequence) - 1 <= length(r.sequence)""",
    "ambiguous": "select peptide_id, protein_rep_id, protein_start_1based from windows where not regexp_full_match(matched_sequence, '[ACDEFGHIKLMNPQRSTVWY]+')",
    "close": """select *, hamming(query_sequence, matched_sequence) as n_substitutions from windows
        where regexp_full_match(matched_sequence, '[ACDEFGHIKLMNPQRSTVWY]+') and hamming(query_sequence, matched_sequence) <= 3""",
    "grantham": f"select * from (values {_GRANTHAM}) g(a, b, d)",
    "substituted": """select c.*, i, d, a, b from close c, (select unnest(range(1, 26)) as i) join grantham on true
        where i <= length(query_sequence) and substr(query_sequence, i, 1) = a and substr(matched_sequence, i, 1) = b""",
    "graded": """select peptide_id, protein_rep_id, protein_start_1based, sum((d <= 50)::int) as n_conservative, string_agg(concat(a, i, b, ':', d), ';' order by i) as substitutions,
        max(d) as max_grantham, sum(d) as grantham_sum from substituted group by all""",
    "classed": """select c.*, coalesce(n_conservative, 0) as n_conservative, n_substitutions - coalesce(n_conservative, 0) as n_nonconservative,
        coalesce(substitutions, '') as substitutions, coalesce(max_grantham, 0) as max_grantham, coalesce(grantham_sum, 0) as grantham_sum
        from close c left join graded using (peptide_id, protein_rep_id, protein_start_1based)""",
    "hits": "select *, " + ", ".join(f"({v})::int as {k}" for k, v in _TIER_TESTS.items()) + " from classed",
    "pairs": """select distinct m.rep as protein_rep_id, coalesce(e.genome_id, b.genome_id) as genome_id
        from (select distinct rep, coalesce(nullif(regexp_extract(line, '(MGYG[0-9]{9}(?:[.][0-9]+)?)', 1), ''), nullif(regexp_extract(line, '(GUT_GENOME[0-9]{6,9})', 1), '')) as alias
          from fx_membership where rep in (select protein_rep_id from hits)) m
        left join alias_map e using (alias) left join alias_map b on regexp_replace(m.alias, '[.][0-9]+$', '') = b.alias
        where coalesce(e.genome_id, b.genome_id) in (select genome_id from panel_genomes)""",
    "evaluable": "select g.*, in_uhgp_membership, high_quality and in_uhgp_membership as evaluable_hq from panel_genomes g join inventory using (genome_id)",
    "presence": f"""select h.peptide_id, e.genome_id, e.species_key, e.high_quality, e.evaluable_hq, {_each("max({t}) as {t}")} from hits h
        join pairs p using (protein_rep_id) join evaluable e using (genome_id) where greatest({', '.join(TIERS)}) > 0 group by 1, 2, 3, 4, 5""",
    "species": """select c.*, coalesce(n1, 0) as n_genomes_in_uhgp, coalesce(n2, 0) as n_hq_genomes_in_uhgp,
        coalesce(n2, 0) / nullif(n_uhgg_genomes_hq, 0) as hq_reference_representation_fraction, coalesce(n2, 0) > 0 as hq_evaluable, coalesce(n2, 0) between 1 and 4 as low_hq_reference_n
        from species_counts c left join (select species_key, sum(in_uhgp_membership::int) as n1, sum(evaluable_hq::int) as n2 from evaluable group by 1) using (species_key)""",
    "sums": f"""select peptide_id, species_key, {_each("sum({t}) as a_{t}, sum(case when evaluable_hq then {{t}} else 0 end) as h_{t}".replace("{{t}}", "{t}"))} from presence group by 1, 2""",
    "breadth": f"""select p.peptide_id, p.sequence, p.length, s.*, {_each("coalesce(a_{t}, 0) as hit_genomes_all_{t}, coalesce(h_{t}, 0) as hit_genomes_hq_{t}, coalesce(a_{t}, 0) / nullif(n_genomes_in_uhgp, 0) as breadth_all_{t}, coalesce(h_{t}, 0) / nullif(n_hq_genomes_in_uhgp, 0) as breadth_hq_{t}, coalesce(h_{t}, 0) / nullif(n_uhgg_genomes_hq, 0) as breadth_hq_all_references_{t}, coalesce(n_hq_genomes_in_uhgp >= 1 and coalesce(h_{t}, 0) / nullif(n_hq_genomes_in_uhgp, 0) >= 0.75, false) as carrier_broad_hq_{t}")}
        from fx_peptides p cross join species s left join sums using (peptide_id, species_key)""",
    "sample_sums": """select sample_name, coalesce(sum(abundance) filter (where n_uhgg_genomes_hq > 0 and n_hq_genomes_in_uhgp = 0), 0) as absent,
        coalesce(sum(abundance) filter (where n_hq_genomes_in_uhgp > 0), 0) as e, sum(abundance * coalesce(hq_reference_representation_fraction, 0)) as r,
        coalesce(sum(abundance) filter (where n_hq_genomes_in_uhgp between 1 and 4), 0) as low from shares join species on species = species_key group by 1""",
    "quality": "select q.sample_name, " + ", ".join(f"{_clip(x)} as {n}" for n, x in {
        "panel_abundance": "panel_abundance", "outside_panel_abundance": "outside_panel_abundance", "panel_no_mapped_genomes_abundance": "panel_no_mapped_genomes_abundance",
        "panel_no_hq_genomes_abundance": "panel_no_hq_genomes_abundance", "hq_species_abundance_before_membership_qc": "hq_species_abundance_before_membership_qc",
        "panel_hq_species_absent_from_uhgp_abundance": "coalesce(absent, 0)", "evaluable_species_abundance": "coalesce(e, 0)", "unevaluable_species_abundance": "(1 - coalesce(e, 0))",
        "represented_hq_reference_weight": "coalesce(r, 0)", "unresolved_reference_weight": "(1 - coalesce(r, 0))", "partly_missing_hq_reference_weight": "(coalesce(e, 0) - coalesce(r, 0))",
        "low_n_hq_species_abundance": "coalesce(low, 0)",
    }.items()) + f", bioproject_id, fraction as {co.LABELLED} from panel_qc q left join sample_sums using (sample_name) join included using (sample_name)",
    "weights": " union all ".join(f"select peptide_id, species_key, '{t}' as tier, coalesce(breadth_hq_{t}, 0) as w, coalesce(hq_reference_representation_fraction, 0) as r, carrier_broad_hq_{t} as broad from breadth" for t in TIERS),
    "scores": """select peptide_id, sample_name, tier, sum(abundance * w) as c, sum(abundance * w * r) as low, sum(case when broad then abundance else 0 end) as broad
        from shares join weights on species = species_key group by 1, 2, 3""",
    "coverage": f"""select p.peptide_id, q.sample_name, t.tier, coalesce(c, 0) as breadth_weighted_coverage, {_clip("coalesce(c, 0) / nullif(evaluable_species_abundance, 0)")} as equal_rate_extrapolated_coverage,
        coalesce(low, 0) as missing_reference_lower, {_clip("coalesce(low, 0) + unresolved_reference_weight")} as missing_reference_upper,
        {_clip("coalesce(c, 0) + unevaluable_species_abundance")} as unevaluated_species_upper, coalesce(broad, 0) as broad_hq_thresholded_coverage, bioproject_id
        from fx_peptides p cross join quality q cross join (values {", ".join(f"('{t}')" for t in TIERS)}) t(tier) left join scores s on s.peptide_id = p.peptide_id and s.sample_name = q.sample_name and s.tier = t.tier""",
    "project_medians": """select peptide_id, tier, bioproject_id, count(*) as n_samples, median(breadth_weighted_coverage) as median_coverage,
        median(missing_reference_lower) as median_missing_reference_lower, median(missing_reference_upper) as median_missing_reference_upper
        from coverage where bioproject_id <> '' group by 1, 2, 3""",
    "project_median": "select peptide_id, tier, median(median_coverage) as median_of_bioproject_medians from project_medians group by 1, 2",
    "tier_medians": """select peptide_id, tier, median(breadth_weighted_coverage) as median_coverage, median(equal_rate_extrapolated_coverage) as median_equal_rate_extrapolated_coverage,
        quantile_cont(breadth_weighted_coverage, 0.05) as p05_coverage, median(missing_reference_lower) as median_missing_reference_lower,
        median(missing_reference_upper) as median_missing_reference_upper, median(broad_hq_thresholded_coverage) as median_thresholded_coverage
        from coverage group by 1, 2""",
    "quality_medians": "select " + ", ".join(f"median({c}) as median_{c}" for c in co.SUMMARY_MEDIANS) + " from quality",
    "extended": "select p.peptide_id, p.sequence, p.length, " + ", ".join(
        f"max({n}) filter (where tier = '{t}') as {n}_{t}" for t in TIERS for n in (
            "median_coverage", "median_equal_rate_extrapolated_coverage", "p05_coverage", "median_missing_reference_lower", "median_missing_reference_upper", "median_of_bioproject_medians")
    ) + ", " + ", ".join(f"any_value(median_{c}) as median_{c}" for c in co.SUMMARY_MEDIANS) + """ from fx_peptides p left join tier_medians using (peptide_id)
        left join project_median using (peptide_id, tier) cross join quality_medians group by 1, 2, 3""",
    "conflicting": "select sample_name, bioproject_id from fx_samples union all select concat('S', s_suppkey), 'PRJX' from supplier where s_suppkey % 10 = 0",
}


def with_relations(select: str) -> str:
    """The select with the relations that it needs, in order."""
    import re

    needed: set[str] = set()
    asked = [select]
    while asked:
        words = set(re.findall(r"[a-z_0-9]+", asked.pop()))
        for name in words & RELATIONS.keys() - needed:
            needed.add(name)
            asked.append(RELATIONS[name])
    kept = [f"{k} as {'materialized ' if k in ('windows', 'coverage', 'breadth', 'hits', 'genomes', 'shares') else ''}({v})" for k, v in RELATIONS.items() if k in needed]
    return ("with " + ",\n".join(kept) + "\n" if kept else "") + select


Q: dict[str, Callable[[Study, Fixtures], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, columns: str, source: str, query: Callable[[Study, Fixtures], DataFrame], round: bool = True) -> None:
    """A query and its SQL: the columns with their kinds (s as it is, i whole, d to eight digits) of a relation.

    One that is not to ``round`` here has done so.
    """
    kinds = _kinds(columns)
    Q[name] = lambda s, f: rounded(query(s, f).select(*kinds)) if round else query(s, f).select(*kinds)
    SQL[name] = with_relations(_sql_rounded(kinds, source))


_tier = lambda text: " ".join(text.format(t=t) for t in TIERS)
_HIT = "peptide_id:s protein_rep_id:s protein_start_1based:i "

_add("fasta_records", "id:s sequence:s", "(select protein_rep_id as id, sequence from fx_proteins)",
     lambda s, f: parse_records(f.proteins.select(F.concat(F.lit(">"), "protein_rep_id", F.lit(" about\n"), F.lower(F.substring("sequence", 1, 60)), F.lit("\n\n"), F.expr("substring(sequence, 61)"), F.lit("**\n")).alias("value"))))
_add("peptide_validation", "peptide_id:s sequence:s length:i n_same_id:i bad_residues:s length_ok:s valid:s",
     "(select peptide_id, sequence, length(sequence) as length, 1 as n_same_id, regexp_replace(sequence, '[ACDEFGHIKLMNPQRSTVWY]', '', 'g') as bad_residues, length(sequence) between 12 and 25 as length_ok, regexp_full_match(sequence, '[ACDEFGHIKLMNPQRSTVWY]{12,25}') as valid from fx_peptides)",
     lambda s, f: peptide_problems(f.peptides))
_add("lineage_ranks", "genome_id:s " + " ".join(f"{n}:s" for n in RANKS.values()), "ranks", lambda s, f: ab.with_ranks(f.host))
_add("bulk_prok_filter", "sample_name:s genome:s relative_abundance:d", "prok", lambda s, f: s.prokaryotes)
_add("labelled_abundance", "sample_name:s species:s relative_abundance:d", "labelled", lambda s, f: s.labelled)
_add("renormalised_abundance", "sample_name:s species:s abundance:d", "shares", lambda s, f: s.shares)
_add("all_prok_vs_labelled_fraction", f"sample_name:s {co.LABELLED}:d", f"(select sample_name, fraction as {co.LABELLED} from fractions)", lambda s, f: s.fractions)
_add("sample_projects", "sample_name:s bioproject_id:s n_rows:i", "projects", lambda s, f: ab.sample_projects(f.samples))
_add("project_conflicts", "sample_name:s n_projects:i", "(select sample_name, count(distinct bioproject_id) as n_projects from conflicting group by 1 having count(distinct bioproject_id) > 1)",
     lambda s, f: ab.project_conflicts(f.samples.unionAll(f.table("supplier").where("s_suppkey % 10 = 0").select(F.concat(F.lit("S"), "s_suppkey"), F.lit("PRJX")))))
_STATS = "species_key:s abundance_sum:d max_abundance:d mean_abundance:d prevalence_any:d n_bioprojects_detected:i"
_add("species_stats", _STATS, "stats", lambda s, f: s.stats)
_add("species_panel", _STATS + " cumulative_mean_abundance:d selected:s", "panel", lambda s, f: s.panel)
_add("label_exact", "genome_id:s species:s", "(select genome_id, species from direct where direct_source = 'genome_exact')", lambda s, f: la.label_exact(f.genomes, s.labels))
_add("label_base", "genome_id:s species:s", "(select genome_id, species from direct where direct_source = 'genome_base')", lambda s, f: la.label_base(f.genomes, s.labels))
_add("cluster_modal_species", "species_rep:s species:s n_overlap:i n_cluster_overlap:i mapping_purity:d mapping_accepted:s", "modal",
     lambda s, f: la.modal_species(la.direct_labels(f.genomes, s.labels), 0.9))
_add("genome_labels", "genome_id:s species_key:s mapping_source:s cluster_modal_species:s mapping_purity:d n_cluster_overlap:i cluster_fallback_accepted:s", "genomes", lambda s, f: s.genome_labels)
_add("mapping_source_counts", "mapping_source:s n_genomes:i", "(select mapping_source, count(*) as n_genomes from genomes group by 1)", lambda s, f: la.mapping_source_counts(s.genome_labels))
_add("hq_genomes", "genome_id:s species_key:s completeness:d contamination:d", "(select * from panel_genomes where high_quality)", lambda s, f: s.panel_genomes.where("high_quality"))
_COUNTS = ("species_key:s n_uhgg_genomes_all:i n_uhgg_genomes_hq:i cluster_mapping_purity_min:d cluster_overlap_min:i n_uhgg_species_clusters:i "
           "n_mapped_genome_exact:i n_mapped_genome_base:i n_mapped_cluster_fallback:i")  # fmt: skip
_add("species_genome_counts", _COUNTS, "species_counts", lambda s, f: s.species_counts)
_add("panel_sample_qc", "sample_name:s panel_abundance:d outside_panel_abundance:d panel_no_mapped_genomes_abundance:d panel_no_hq_genomes_abundance:d hq_species_abundance_before_membership_qc:d", "panel_qc", lambda s, f: s.panel_qc)
_add("hq_ceiling", "sample_name:s attainable:d", """(select i.sample_name, coalesce(sum(abundance) filter (where species in (select species_key from genomes where high_quality and species_key is not null)), 0) as attainable
     from included i left join shares using (sample_name) group by 1)""", lambda s, f: s.ceiling)
_add("alias_map", "alias:s genome_id:s", "alias_map", lambda s, f: s.aliases)
_add("ambiguous_aliases", "alias:s n_genomes:i", """(select alias, count(distinct genome_id) as n_genomes from (select genome_id, unnest([genome_id, left(original_genome_id, 15)]) as alias from fx_uhgg) group by 1 having count(distinct genome_id) > 1)""",
     lambda s, f: la.ambiguous_aliases(f.genomes.withColumn("original_genome_id", F.substring("original_genome_id", 1, 15))))
_add("membership_inventory", "genome_id:s in_uhgp_membership:s", "inventory", lambda s, f: s.inventory)
_add("unresolved_aliases", "alias:s", """(select alias from line_alias where alias not in (select alias from alias_map where genome_id in (select genome_id from fx_uhgg where contamination < 6)))""",
     lambda s, f: ca.unresolved_aliases(f.membership, la.alias_map(f.genomes.where("contamination < 6"))))
_add("seed_partition", "peptide_id:s part:i offset:i seed:s", '(select peptide_id, part, start as "offset", seed from seeds)', lambda s, f: se.seed_table(f.peptides))
_add("fuzzy_hits", _HIT + "matched_sequence:s n_substitutions:i", "hits", lambda s, f: s.hits)
_add("ambiguous_windows", _HIT.strip(), "ambiguous", lambda s, f: se.ambiguous_windows(s.scanned))
_add("seed_candidates", "peptide_id:s n_ambiguous:i n_hits:i", """(select peptide_id, (select count(*) from ambiguous a where a.peptide_id = p.peptide_id) as n_ambiguous,
     (select count(*) from hits h where h.peptide_id = p.peptide_id) as n_hits from fx_peptides p)""",
     lambda s, f: f.peptides.select("peptide_id").join(s.scanned.groupBy("peptide_id").agg(F.sum(F.col("ambiguous").cast("int")).alias("n_ambiguous"), F.sum((~F.col("ambiguous")).cast("int")).alias("n_hits")), "peptide_id", "left").fillna(0))
_add("hit_classification", _HIT + "n_substitutions:i n_conservative:i n_nonconservative:i max_grantham:i grantham_sum:i", "hits", lambda s, f: s.hits)
_add("hit_tiers", _HIT + _tier("{t}:i"), "hits", lambda s, f: s.hits)
_add("substitution_strings", _HIT + "query_sequence:s matched_sequence:s substitutions:s", "hits", lambda s, f: s.hits)
_add("hit_examples", _HIT + "n_substitutions:i max_grantham:i", """(select * from hits qualify row_number() over (partition by peptide_id order by n_substitutions, max_grantham, protein_rep_id, protein_start_1based) <= 3)""",
     lambda s, f: se.hit_examples(s.hits, 3))
_add("rep_genome_pairs", "protein_rep_id:s genome_id:s", "pairs", lambda s, f: s.pairs)
_add("missing_representatives", "protein_rep_id:s", "(select protein_rep_id from fx_proteins where protein_rep_id not in (select rep from fx_membership where rep like '%1'))",
     lambda s, f: ca.missing_representatives(ca.named_lines(f.membership.where("rep like '%1'"), f.proteins), f.proteins))
_add("genome_presence", "peptide_id:s genome_id:s species_key:s high_quality:s evaluable_hq:s " + _tier("{t}:i"), "presence", lambda s, f: s.presence)
_add("species_evaluability", _COUNTS + " n_genomes_in_uhgp:i n_hq_genomes_in_uhgp:i hq_reference_representation_fraction:d hq_evaluable:s low_hq_reference_n:s", "species", lambda s, f: s.species)
_add("species_breadth", "peptide_id:s species_key:s " + _tier("hit_genomes_all_{t}:i hit_genomes_hq_{t}:i breadth_all_{t}:d breadth_hq_{t}:d breadth_hq_all_references_{t}:d"), "breadth", lambda s, f: s.breadth)
_add("broad_carriers", "peptide_id:s species_key:s " + _tier("carrier_broad_hq_{t}:s"), "(select * from breadth where carrier_broad_hq_unrestricted_le2 or carrier_broad_hq_cons_le3)",
     lambda s, f: s.breadth.where("carrier_broad_hq_unrestricted_le2 or carrier_broad_hq_cons_le3"))
_add("sample_evaluability", "sample_name:s " + " ".join(f"{c}:d" for c in co.FRACTIONS) + f" bioproject_id:s {co.LABELLED}:d", "quality", lambda s, f: s.quality)
_add("evaluability_summary", "metric:s mean:d median:d p05:d min:d max:d",
     "(" + " union all ".join(f"select '{c}' as metric, avg({c}) as mean, median({c}) as median, quantile_cont({c}, 0.05) as p05, min({c}) as min, max({c}) as max from quality" for c in [*co.FRACTIONS, co.LABELLED]) + ")",
     lambda s, f: s.quality_summary)
_KEY = "peptide_id:s sample_name:s tier:s "
_coverage = lambda s, f: co.coverage_measures(s.sums, s.patterns[0], DIGITS)
_add("sample_coverage", _KEY + "breadth_weighted_coverage:d broad_hq_thresholded_coverage:d bioproject_id:s", "coverage", _coverage, round=False)
_add("coverage_bounds", _KEY + "missing_reference_lower:d missing_reference_upper:d unevaluated_species_upper:d", "coverage", _coverage, round=False)
_add("equal_rate", _KEY + "equal_rate_extrapolated_coverage:d", "coverage", _coverage, round=False)
_add("project_medians", "peptide_id:s tier:s bioproject_id:s n_samples:i median_coverage:d median_missing_reference_lower:d median_missing_reference_upper:d", "project_medians", lambda s, f: s.projects)
_add("median_of_project_medians", "peptide_id:s tier:s median_of_bioproject_medians:d", "project_median", lambda s, f: co.median_of_project_medians(s.projects))
_add("extended_summary", "peptide_id:s sequence:s length:i " + _tier("median_coverage_{t}:d median_equal_rate_extrapolated_coverage_{t}:d p05_coverage_{t}:d median_missing_reference_lower_{t}:d median_missing_reference_upper_{t}:d median_of_bioproject_medians_{t}:d") + " " + " ".join(f"median_{c}:d" for c in co.SUMMARY_MEDIANS), "extended", lambda s, f: s.extended)
_SHORT = {"exact": "exact", "cons_le1": "le1_conservative", "cons_le2": "le2_conservative"}
_add("concise_summary", "peptide_id:s sequence:s " + " ".join(f"median_missing_reference_lower_{t}:d median_coverage_{n}:d median_equal_rate_extrapolated_coverage_{n}:d median_missing_reference_upper_{t}:d" for t, n in _SHORT.items()) + " " + " ".join(f"median_{c}:d" for c in co.SUMMARY_MEDIANS[:4]),
     "(select *, " + ", ".join(f"median_coverage_{t} as median_coverage_{n}, median_equal_rate_extrapolated_coverage_{t} as median_equal_rate_extrapolated_coverage_{n}" for t, n in list(_SHORT.items())[1:]) + " from extended)", lambda s, f: s.concise)
_add("threshold_qc", "peptide_id:s sequence:s length:i " + _tier("median_thresholded_coverage_{t}:d n_broad_carrier_species_{t}:i"),
     "(select p.peptide_id, p.sequence, p.length, " + ", ".join(f"(select median_thresholded_coverage from tier_medians m where m.peptide_id = p.peptide_id and tier = '{t}') as median_thresholded_coverage_{t}, (select sum(carrier_broad_hq_{t}::int) from breadth b where b.peptide_id = p.peptide_id) as n_broad_carrier_species_{t}" for t in TIERS) + " from fx_peptides p)",
     lambda s, f: s.thresholds)


def _diagnostics(s: Study, f: Fixtures) -> DataFrame:
    """Nested facts of a preparation as dotted paths, numbers and texts apart."""
    facts = {
        "selected_species_n": s.panel.where("selected").count(),
        "panel_coverage": s.quality_summary.where("metric = 'panel_abundance'").first().asDict(),
        "mapped_genomes_by_source": {r.mapping_source: r.n_genomes for r in la.mapping_source_counts(s.genome_labels).collect()},
        "tiers": list(TIERS),
    }
    rows = [(".".join(path), float(v) if isinstance(v, int | float) else None, listed({"v": v})[0][1] if not isinstance(v, int | float) else None) for path, v in leaves(facts)]
    return f.spark.createDataFrame(rows, "parameter string, number double, text string")


def _omissions(s: Study, f: Fixtures) -> DataFrame:
    """Tables that a workbook of 100 rows a sheet would leave out, and all their rows."""
    found = omitted_rows({"Selected species QC": s.species, "Species breadth": s.breadth, "Broad carrier QC": s.thresholds}, 100)
    return f.spark.createDataFrame(sorted(found.items()), "sheet string, rows_counted long")


_STATISTICS = {"mean": "avg({c})", "median": "median({c})", "p05": "quantile_cont({c}, 0.05)", "min": "min({c})", "max": "max({c})"}
_add("flattened_diagnostics", "parameter:s number:d text:s", "(" + " union all ".join([
    "select 'selected_species_n' as parameter, cast(count(*) as double) as number, cast(null as varchar) as text from panel where selected",
    "select 'panel_coverage.metric', null, 'panel_abundance'",
    *[f"select 'panel_coverage.{n}', {v.format(c='panel_abundance')}, null from quality" for n, v in _STATISTICS.items()],
    "select concat('mapped_genomes_by_source.', mapping_source), cast(count(*) as double), null from genomes group by mapping_source",
    "select 'tiers', null, '[" + ", ".join(f'"{t}"' for t in TIERS) + "]'",
]) + ")", _diagnostics)
_add("excel_omissions", "sheet:s rows_counted:i", "(select * from (" + " union all ".join(
    f"select '{title}' as sheet, count(*) as rows_counted from {relation}" for title, relation in (("Selected species QC", "species"), ("Species breadth", "breadth"), ("Broad carrier QC", "fx_peptides"))
) + ") where rows_counted > 100)", _omissions)
_add("search_counts", "ambiguous_windows:i hits:i hit_representatives:i proteins:i residues:i", """(select (select count(*) from ambiguous) as ambiguous_windows, (select count(*) from hits) as hits,
     (select count(distinct protein_rep_id) from hits) as hit_representatives, (select count(*) from fx_proteins) as proteins, (select coalesce(sum(length(sequence)), 0) from fx_proteins) as residues)""",
     lambda s, f: s.search_counts)


def _melted(s: Study, f: Fixtures) -> DataFrame:
    """The wide matrix of samples by panel species, made long again."""
    wide = s.abundance_matrix()
    return wide.unpivot("sample_name", [F.col(f"`{c}`") for c in wide.columns[1:]], "species_key", "abundance")


_add("abundance_matrix", "sample_name:s species_key:s abundance:d", """(select i.sample_name, p.species_key, coalesce(s.abundance, 0) as abundance from included i cross join panel p
     left join shares s on s.sample_name = i.sample_name and s.species = p.species_key where selected)""", _melted)


def _as_file(df: DataFrame, name: str, **options: str) -> str:
    """A table as tab-separated files in the shared folder, to be read as an input is."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(sep="\t", header=True, emptyValue="", **options).csv(path)
    return path


def _as_fasta(df: DataFrame, name: str) -> str:
    """Packed FASTA files with wrapped and indented lines."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    record = F.concat(F.lit(" >"), "protein_rep_id", F.lit(" of a test\n "), F.lower(F.substring("sequence", 1, 70)), F.lit("\n\n"), F.expr("substring(sequence, 71)"), F.lit("*"))
    df.select(record).write.option("compression", "gzip").text(path)
    return path


_add("abundance_file", "sample_name:s sample_type:s genome_type:s genome:s relative_abundance:d", "fx_abundance",
     lambda s, f: tables.read_abundance(f.spark, _as_file(f.abundance, "abundance", compression="gzip")))
_add("sample_file", "sample_name:s bioproject_id:s", "(select sample_name, nullif(bioproject_id, '') as bioproject_id from fx_samples)", lambda s, f: tables.read_samples(f.spark, _as_file(f.samples, "samples")))
_add("host_file", "genome_id:s data_source:s lineage_gtdb_r207_updated:s", "fx_host", lambda s, f: tables.read_host(f.spark, _as_file(f.host, "host")))
_add("metadata_file", "genome_id:s species_rep:s completeness:d contamination:d original_genome_id:s", "fx_uhgg", lambda s, f: tables.read_metadata(f.spark, _as_file(f.genomes.select(
    F.col("genome_id").alias("MGYG accession"), F.col("species_rep").alias("Species rep."), F.col("completeness").alias("Completeness"),
    F.col("contamination").alias("CONTAMINATION"), F.col("original_genome_id").alias("original accession")), "metadata"))[0])
_add("membership_file", "line:s", "(select line from fx_membership)", lambda s, f: tables.read_membership(f.spark, _as_lines(f.membership.select("line"))))
_add("fasta_file", "id:s sequence:s", "(select protein_rep_id as id, sequence from fx_proteins)", lambda s, f: read_fasta(f.spark, _as_fasta(f.proteins, "proteins"), partitions=8))


def _as_lines(df: DataFrame) -> str:
    path = f"{shared_folder(df.sparkSession)}/lines-{uuid.uuid4().hex}"
    df.write.text(path)
    return path


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(query):
        return lambda spark, folder: query(study(spark, folder), Fixtures(spark, folder))

    return {name: bound(query) for name, query in Q.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The species panel that covers 95 % of mean abundance."""
    return queries()["species_panel"](spark, folder)
