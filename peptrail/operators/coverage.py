"""Abundance-weighted coverage of samples by peptides, its bounds, and summaries over samples and projects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.checks import require_fraction
from peptrail.functions.text import clipped, share
from peptrail.operators.quantiles import quantiles
from peptrail.plans.stages import staged
from peptrail.settings import TIERS

FRACTIONS = (
    "panel_abundance", "outside_panel_abundance", "panel_no_mapped_genomes_abundance", "panel_no_hq_genomes_abundance",
    "hq_species_abundance_before_membership_qc", "panel_hq_species_absent_from_uhgp_abundance", "evaluable_species_abundance",
    "unevaluable_species_abundance", "represented_hq_reference_weight", "unresolved_reference_weight",
    "partly_missing_hq_reference_weight", "low_n_hq_species_abundance",
)
LABELLED = "labelled_bacterial_fraction_of_input_prokaryotic_abundance"
MEASURES = (
    "breadth_weighted_coverage", "equal_rate_extrapolated_coverage", "missing_reference_lower", "missing_reference_upper",
    "unevaluated_species_upper", "broad_hq_thresholded_coverage",
)


def sample_evaluability(shares: DataFrame, samples: DataFrame, panel_qc: DataFrame, species: DataFrame, check: bool = False) -> DataFrame:
    """Each sample's abundance by what is known of its species' genomes; fractions are clipped to [0, 1]."""
    facts = species.select(
        F.col("species_key").alias("species"), "n_uhgg_genomes_hq", "n_hq_genomes_in_uhgp",
        F.coalesce("hq_reference_representation_fraction", F.lit(0.0)).alias("represented"),
    )
    a, n = F.col("abundance"), F.col("n_hq_genomes_in_uhgp")
    part = lambda test: F.coalesce(F.sum(F.when(test, a)), F.lit(0.0))
    sums = shares.join(facts, "species").groupBy("sample_name").agg(
        part((F.col("n_uhgg_genomes_hq") > 0) & (n == 0)).alias("panel_hq_species_absent_from_uhgp_abundance"),
        part(n > 0).alias("evaluable_species_abundance"),
        F.sum(a * F.col("represented")).alias("represented_hq_reference_weight"),
        part(n.between(1, 4)).alias("low_n_hq_species_abundance"),
    )
    out = (
        panel_qc.join(sums, "sample_name", "left").fillna(0.0)
        .withColumn("unevaluable_species_abundance", 1 - F.col("evaluable_species_abundance"))
        .withColumn("unresolved_reference_weight", 1 - F.col("represented_hq_reference_weight"))
        .withColumn("partly_missing_hq_reference_weight", F.col("evaluable_species_abundance") - F.col("represented_hq_reference_weight"))
    )
    if check:
        require_fraction(out, FRACTIONS, "sample quality")
    out = out.withColumns({c: clipped(F.col(c)) for c in FRACTIONS})
    return out.join(samples.select("sample_name", "bioproject_id", LABELLED), "sample_name").select("sample_name", *FRACTIONS, "bioproject_id", LABELLED)


def statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """``metric, mean, median, p05, min, max`` of each column over the rows that have it; quantiles by ranks, without buffers."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])))
    sums = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    places = quantiles(long, ["metric"], [0.5, 0.05]).groupBy("metric").agg(
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("median"), F.max(F.when(F.col("p") == 0.05, F.col("value"))).alias("p05")
    )
    return sums.join(places, "metric", "left").select("metric", "mean", "median", "p05", "min", "max")


def evaluability_summary(quality: DataFrame) -> DataFrame:
    return statistics(quality, [*FRACTIONS, LABELLED])


def weights(breadth: DataFrame) -> DataFrame:
    """``peptide_id, tier, species, breadth, represented, broad``: one row a tier, only where a species adds something."""
    rows = F.array(*[
        F.struct(
            F.lit(t).alias("tier"), F.coalesce(F.col(f"breadth_hq_{t}"), F.lit(0.0)).alias("breadth"),
            F.coalesce(F.col("hq_reference_representation_fraction"), F.lit(0.0)).alias("represented"),
            F.col(f"carrier_broad_hq_{t}").alias("broad"),
        )
        for t in TIERS
    ])
    return (
        breadth.select("peptide_id", F.col("species_key").alias("species"), F.explode(rows).alias("t"))
        .select("peptide_id", "species", "t.*").where("breadth > 0 or broad")
    )


#: how many patterns and samples meet in one task
_PATTERNS, _SAMPLES = 512, 1024
_NO_WEIGHT = -1
#: most members of a pattern that are packed together
_MEMBERS = 512
SUMS = "pattern long, sample_name string, bioproject_id string, e double, u double, v double, c double, low double, broad double"


def patterns(breadth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``peptide_id, tier, pattern`` of every peptide and tier, and what each pattern weighs.

    Peptides and tiers with equal weights in all species are one pattern (a peptide's tiers mostly are), and so are those
    without any. Of a pattern: ``pattern, species, breadth, represented, broad`` as arrays.
    """
    found = weights(breadth).groupBy("peptide_id", "tier").agg(F.sort_array(F.collect_list(F.struct("species", "breadth", "represented", F.col("broad").cast("double").alias("broad")))).alias("held"))
    found = staged(found.withColumn("digest", F.sha2(F.to_json("held"), 256)), "weights")
    kept = found.groupBy("digest").agg(F.first("held").alias("held")).withColumn("pattern", F.monotonically_increasing_id())
    kept = staged(kept.select("pattern", "digest", *[F.col(f"held.{c}").alias(c) for c in ("species", "breadth", "represented", "broad")]), "patterns")
    tiers = F.explode(F.array(*[F.lit(t) for t in TIERS])).alias("tier")
    known = found.join(kept.select("digest", "pattern"), "digest").select("peptide_id", "tier", "pattern")
    every = breadth.select("peptide_id").distinct().select("peptide_id", tiers).join(known, ["peptide_id", "tier"], "left")
    members = staged(every.select("peptide_id", "tier", F.coalesce("pattern", F.lit(_NO_WEIGHT)).alias("pattern")), "members")
    return members, kept.drop("digest")


def pattern_sums(shares: DataFrame, quality: DataFrame, kept: DataFrame) -> DataFrame:
    """``SUMS``: the product of abundance and breadth for every sample and pattern, with the sample's own shares.

    Blocks of patterns meet slices of samples, both bounded, and each pair is one product of matrices: what is
    shuffled are the samples, once for each block, and the patterns, once for each slice; nothing is made for each
    pair of a species in a sample and a peptide.
    """
    own = shares.where("abundance > 0 and species is not null").groupBy("sample_name").agg(F.collect_list("species").alias("species"), F.collect_list("abundance").alias("amount"))
    e, u, v = (F.col(c).alias(n) for c, n in (("evaluable_species_abundance", "e"), ("unresolved_reference_weight", "u"), ("unevaluable_species_abundance", "v")))
    samples = quality.select("sample_name", "bioproject_id", e, u, v).join(own, "sample_name", "left")
    n_blocks, n_slices = max(1, -(-kept.count() // _PATTERNS)), max(1, -(-quality.count() // _SAMPLES))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = (F.col("block") * n_slices + F.col("slice")).cast("int").alias("place")
    first = kept.select("*", F.pmod(F.xxhash64("pattern"), F.lit(n_blocks)).alias("block"), upto(n_slices).alias("slice")).select(
        place, F.lit(0).alias("kind"), "pattern", "species", F.col("breadth").alias("amount"), "represented", "broad"
    )
    rest = samples.select("*", F.pmod(F.xxhash64("sample_name"), F.lit(n_slices)).alias("slice"), upto(n_blocks).alias("block")).select(
        place, F.lit(1).alias("kind"), "sample_name", "bioproject_id", "e", "u", "v", "species", "amount"
    )
    met = first.unionByName(rest, allowMissingColumns=True).repartitionById(n_blocks * n_slices, "place").sortWithinPartitions("place", "kind")
    names = [c.split()[0] for c in SUMS.split(", ")]
    doubles = ("e", "u", "v", "c", "low", "broad")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, known = -1, [], None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for here in np.unique(t["place"].to_numpy()).tolist():
                if here != place:
                    place, held, known = here, [], None
                part = t.filter(pc.equal(t["place"], here))
                own, others = part.filter(pc.equal(part["kind"], 0)), part.filter(pc.equal(part["kind"], 1))
                if own.num_rows:
                    held.append(own)
                if others.num_rows and known is None:
                    known, held = _matrices(pa.concat_tables(held) if held else part.slice(0, 0), here < n_slices), []
                for at in range(0, others.num_rows, _SAMPLES):
                    some = others.slice(at, _SAMPLES)
                    number, species, stacked = known
                    row, code, amount = _flat(some, species, "amount")
                    a = np.zeros((some.num_rows, len(species)))
                    np.add.at(a, (row, code), amount)
                    c, low, broad = (a @ m for m in stacked)
                    k, n = len(number), some.num_rows
                    whole = np.tile(np.arange(n), k)  # all samples of a pattern together
                    columns = {x: pa.array(np.tile(some[x].to_numpy(), k)) for x in doubles[:3]}
                    columns |= {x: pa.array(y.T.ravel()) for x, y in zip(doubles[3:], (c, low, broad), strict=True)}
                    columns |= {x: some[x].combine_chunks().take(pa.array(whole)) for x in ("sample_name", "bioproject_id")}
                    columns["pattern"] = pa.array(np.repeat(number, n))
                    yield from pa.table({x: columns[x] for x in names}).to_batches(1 << 16)

    return met.mapInArrow(run, SUMS)


def _flat(rows: pa.Table, species: list[str], value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place among ``species`` and value of the entries of list columns; of other species nothing."""
    lists = rows["species"].combine_chunks()
    code = pc.index_in(lists.flatten(), value_set=pa.array(species, pa.string()))
    there = code.is_valid().to_numpy(zero_copy_only=False)
    amount = rows[value].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return pc.list_parent_indices(lists).to_numpy()[there], code.drop_null().to_numpy(), amount[there]


def _matrices(rows: pa.Table, first: bool) -> tuple[np.ndarray, list[str], list[np.ndarray]]:
    """Numbers of a block's patterns, its species, and species by patterns: breadth, breadth represented, broad.

    The ``first`` block has the pattern without weights too.
    """
    number = np.r_[rows["pattern"].to_numpy().astype(np.int64), np.full(int(first), _NO_WEIGHT, np.int64)]
    species = sorted(pc.unique(rows["species"].combine_chunks().flatten()).to_pylist()) if rows.num_rows else []
    out = []
    for value in ("amount", "represented", "broad"):
        m = np.zeros((len(species), len(number)))
        if rows.num_rows:
            row, code, x = _flat(rows, species, value)
            m[code, row] = x
        out.append(m)
    return number, species, [out[0], out[0] * out[1], out[2]]


def coverage_sums(shares: DataFrame, breadth: DataFrame) -> DataFrame:
    """``peptide_id, sample_name, tier, c, low, broad``: the product of abundance and breadth where it is not 0."""
    members, kept = patterns(breadth)
    null = F.lit(None).cast("double")
    samples = shares.select("sample_name").distinct().select(
        "sample_name", F.lit("").alias("bioproject_id"), *[null.alias(c) for c in ("evaluable_species_abundance", "unresolved_reference_weight", "unevaluable_species_abundance")]
    )
    sums = pattern_sums(shares, samples, kept).where("c > 0 or low > 0 or broad > 0")
    return sums.join(members, "pattern").select("peptide_id", "sample_name", "tier", "c", "low", "broad")


def coverage_measures(sums: DataFrame, members: DataFrame, digits: int | None = None) -> DataFrame:
    """``peptide_id, sample_name, tier`` and the measures, from ``pattern_sums`` and the ``members`` of its patterns.

    C = sum a k/n; T = C / E (null at E = 0); L = sum a (k/n) r; U = L + 1 - R; species upper = C + 1 - E. They are worked
    out, and rounded to ``digits`` on request, once for some ``_MEMBERS`` rows: a join with the members themselves would
    do it anew for each of a pattern's members, so they meet packed and are laid out after.
    """
    measures = {
        "breadth_weighted_coverage": F.col("c"),
        "equal_rate_extrapolated_coverage": clipped(share(F.col("c"), F.col("e"))),
        "missing_reference_lower": F.col("low"),
        "missing_reference_upper": clipped(F.col("low") + F.col("u")),
        "unevaluated_species_upper": clipped(F.col("c") + F.col("v")),
        "broad_hq_thresholded_coverage": F.col("broad"),
    }
    found = [(x if digits is None else F.round(x, digits)).alias(name) for name, x in measures.items()]
    packs = members.withColumn("pack", F.expr(f"monotonically_increasing_id() div {_MEMBERS}")).groupBy("pattern", "pack").agg(F.collect_list(F.struct("peptide_id", "tier")).alias("held"))
    met = sums.select("pattern", "sample_name", *found, "bioproject_id").join(packs, "pattern")
    return met.select("sample_name", *measures, "bioproject_id", F.inline("held")).select("peptide_id", "sample_name", "tier", *measures, "bioproject_id")


def _own_patterns(sums: DataFrame, quality: DataFrame, peptides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``coverage_sums`` as ``SUMS``: each peptide and tier is a pattern of its own, 0 where there is no row."""
    tiers = F.explode(F.array(*[F.lit(t) for t in TIERS])).alias("tier")
    members = staged(peptides.select("peptide_id").distinct().select("peptide_id", tiers).withColumn("pattern", F.monotonically_increasing_id()), "members")
    e, u, v = (F.col(c).alias(n) for c, n in (("evaluable_species_abundance", "e"), ("unresolved_reference_weight", "u"), ("unevaluable_species_abundance", "v")))
    grid = members.crossJoin(quality.select("sample_name", "bioproject_id", e, u, v))
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("c", "low", "broad")]
    found = grid.join(sums, ["peptide_id", "sample_name", "tier"], "left").select("pattern", "sample_name", "bioproject_id", "e", "u", "v", *zero)
    return found, members


def sample_coverage(sums: DataFrame, quality: DataFrame, breadth: DataFrame) -> DataFrame:
    """``coverage_measures`` of ``coverage_sums``: every combination has a row, so this is for exports."""
    return coverage_measures(*_own_patterns(sums, quality, breadth))


#: quantiles that summaries need: measure, quantile, over projects too
_ASKED = (("coverage", 0.5, True), ("coverage", 0.05, False), ("equal_rate", 0.5, False), ("lower", 0.5, True), ("upper", 0.5, True), ("broad", 0.5, False))
_MEASURES = ("coverage", "lower", "upper", "equal_rate", "broad")


def _packed(sums: DataFrame, measures: tuple[str, ...] = _MEASURES, at_once: int = 1 << 18) -> DataFrame:
    """Values of ``SUMS`` above 0 as doubles side by side: a row for each pattern and measure of some ``at_once`` rows.

    ``projects`` has what projects there are, ``sizes`` how many values each has, zeros too, ``counts`` how many of them
    stand in ``held``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for batch in batches:
            rows.append(batch)
            n += batch.num_rows
            if n >= at_once:
                yield _packs(pa.Table.from_batches(rows), measures)
                rows, n = [], 0
        if n:
            yield _packs(pa.Table.from_batches(rows), measures)

    return sums.mapInArrow(run, "pattern long, measure int, projects array<string>, sizes array<int>, counts array<int>, held binary")


def _packs(t: pa.Table, measures: tuple[str, ...]) -> pa.RecordBatch:
    project = pc.dictionary_encode(t["bioproject_id"].combine_chunks())
    names, code = project.dictionary.to_pylist(), project.indices.to_numpy(zero_copy_only=False)
    number = t["pattern"].to_numpy()
    order = np.lexsort((code, number))
    number, code = number[order], code[order]
    e, u, c, low, broad = (t[x].to_numpy()[order] for x in ("e", "u", "c", "low", "broad"))
    within = lambda x: np.clip(x, 0.0, 1.0)
    rate = np.full(len(e), np.nan)  # none where nothing could be evaluated
    np.divide(c, e, out=rate, where=e != 0)
    values = {"coverage": c, "lower": low, "upper": within(low + u), "equal_rate": within(rate), "broad": broad}
    begin = np.flatnonzero(np.r_[True, (np.diff(number) != 0) | (np.diff(code) != 0)])
    group = np.flatnonzero(np.r_[True, np.diff(number[begin]) != 0])
    out: list[list] = [[] for _ in range(6)]
    for k, name in enumerate(_MEASURES):
        if name not in measures:
            continue
        x = values[name]
        sizes, counts = (np.add.reduceat(y.astype(np.int32), begin) for y in (~np.isnan(x), x > 0))
        for i, j in zip(group.tolist(), [*group[1:].tolist(), len(begin)], strict=True):
            a, b = begin[i], begin[j] if j < len(begin) else len(x)
            mine = x[a:b]
            row = number[a], k, [names[m] for m in code[begin[i:j]]], sizes[i:j], counts[i:j], mine[mine > 0].astype("<f8").tobytes()
            for column, value in zip(out, row, strict=True):
                column.append(value)
    kinds = pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], ["pattern", "measure", "projects", "sizes", "counts", "held"])


def _zero_filled(held: np.ndarray, n: int, p: float) -> float:
    """The quantile of ``n`` values of which ``held`` are those above 0."""
    place = p * (n - 1)
    low, high, zeros = int(np.floor(place)), int(np.ceil(place)), n - len(held)
    wanted = [r - zeros for r in (low, high) if r >= zeros]
    ranked = np.partition(held, wanted) if wanted else held
    at = lambda r: float(ranked[r - zeros]) if r >= zeros else 0.0
    return at(low) * (1 - (place - low)) + at(high) * (place - low)


def _picked(rows: pa.Table) -> pa.Table:
    """Quantiles of one pattern's measure, over all samples and over each project's."""
    name = _MEASURES[rows["measure"][0].as_py()]
    parts: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}
    for projects, sizes, counts, held in zip(*(rows[c].to_pylist() for c in ("projects", "sizes", "counts", "held")), strict=True):
        values, at = np.frombuffer(held, "<f8"), 0
        for project, many, some in zip(projects, sizes, counts, strict=True):
            parts.setdefault(project, []).append(values[at : at + some])
            size[project] = size.get(project, 0) + many
            at += some
    out = []
    for measure, p, every in _ASKED:
        if measure != name:
            continue
        if sum(size.values()):
            out.append(("", name, p, _zero_filled(np.concatenate([v for x in parts.values() for v in x]), sum(size.values()), p)))
        if every:
            out += [(project, name, p, _zero_filled(np.concatenate(x), size[project], p)) for project, x in parts.items() if project and size[project]]
    columns = zip(*out, strict=True) if out else ([], [], [], [])
    kinds = pa.string(), pa.string(), pa.float64(), pa.float64()
    found = {n: pa.array(list(x), kind) for n, x, kind in zip(("scope", "measure", "p", "value"), columns, kinds, strict=True)}
    return pa.table({"pattern": pa.array([rows["pattern"][0].as_py()] * len(out), pa.int64())} | found)


def pattern_quantiles(sums: DataFrame, quality: DataFrame, members: DataFrame, measures: tuple[str, ...] = _MEASURES) -> DataFrame:
    """``scope, peptide_id, tier, n_samples, measure, p, value`` over all samples (scope '') and over each project's.

    Values of a pattern's measure meet as packed doubles, eight bytes for each sample where it is above 0, and are
    partitioned, not sorted; zeros are counted. They are on disk once, as what is shuffled. Peptides and tiers of one
    pattern take its quantiles. Of fewer ``measures`` only those are packed.
    """
    asked = _packed(sums, measures).groupBy("pattern", "measure").applyInArrow(_picked, "pattern long, scope string, measure string, p double, value double")
    scope = F.explode(F.array_distinct(F.array(F.lit(""), "bioproject_id"))).alias("scope")
    sizes = quality.select(scope).groupBy("scope").agg(F.count("*").alias("n_samples"))
    groups = members.crossJoin(sizes)
    return groups.join(asked, ["pattern", "scope"], "left").select("scope", "peptide_id", "tier", "n_samples", "measure", "p", "value")


def summary_quantiles(sums: DataFrame, quality: DataFrame, peptides: DataFrame) -> DataFrame:
    """``pattern_quantiles`` of ``coverage_sums``."""
    found, members = _own_patterns(sums, quality, peptides)
    return pattern_quantiles(found, quality, members)


def _pivoted(found: DataFrame, keys: list[str], names: dict[str, tuple[str, float]]) -> DataFrame:
    pick = lambda measure, p: F.max(F.when((F.col("measure") == measure) & (F.col("p") == p), F.col("value")))
    return found.groupBy(*keys).agg(*[pick(*of).alias(name) for name, of in names.items()])


def project_medians(found: DataFrame) -> DataFrame:
    """Medians over a project's samples, of ``summary_quantiles``; samples without a project take no part."""
    names = {"median_coverage": ("coverage", 0.5), "median_missing_reference_lower": ("lower", 0.5), "median_missing_reference_upper": ("upper", 0.5)}
    own = _pivoted(found.where("scope <> ''"), ["peptide_id", "tier", "scope", "n_samples"], names)
    return own.select("peptide_id", "tier", F.col("scope").alias("bioproject_id"), "n_samples", *names)


def median_of_project_medians(projects: DataFrame) -> DataFrame:
    found = quantiles(projects.select("peptide_id", "tier", F.col("median_coverage").alias("value")), ["peptide_id", "tier"], [0.5], many=True)
    return found.select("peptide_id", "tier", F.col("value").alias("median_of_bioproject_medians"))


def tier_medians(found: DataFrame) -> DataFrame:
    """Medians over all samples of each peptide and tier, and the 5th percentile of coverage, of ``summary_quantiles``."""
    return _pivoted(found.where("scope = ''"), ["peptide_id", "tier"], {
        "median_coverage": ("coverage", 0.5), "median_equal_rate_extrapolated_coverage": ("equal_rate", 0.5), "p05_coverage": ("coverage", 0.05),
        "median_missing_reference_lower": ("lower", 0.5), "median_missing_reference_upper": ("upper", 0.5), "median_thresholded_coverage": ("broad", 0.5),
    })


def _wide(long: DataFrame, names: list[str]) -> DataFrame:
    """One row a peptide, a column for each measure and tier."""
    return long.groupBy("peptide_id").agg(*[F.max(F.when(F.col("tier") == t, F.col(n))).alias(f"{n}_{t}") for t in TIERS for n in names])


SUMMARY_MEDIANS = ("panel_abundance", "evaluable_species_abundance", "unevaluable_species_abundance", "represented_hq_reference_weight", "unresolved_reference_weight")


def extended_summary(peptides: DataFrame, found: DataFrame, projects: DataFrame, quality: DataFrame) -> DataFrame:
    """One row a peptide: medians of every tier, and medians of what could be evaluated."""
    names = ["median_coverage", "median_equal_rate_extrapolated_coverage", "p05_coverage", "median_missing_reference_lower", "median_missing_reference_upper"]
    by_tier = _wide(tier_medians(found), names)
    by_project = _wide(median_of_project_medians(projects), ["median_of_bioproject_medians"])
    long = statistics(quality, list(SUMMARY_MEDIANS))
    medians = long.agg(*[F.max(F.when(F.col("metric") == c, F.col("median"))).alias(f"median_{c}") for c in SUMMARY_MEDIANS])
    ordered = [f"{n}_{t}" for t in TIERS for n in [*names, "median_of_bioproject_medians"]]
    return (
        peptides.select("peptide_id", "sequence", "length").join(by_tier, "peptide_id", "left").join(by_project, "peptide_id", "left").crossJoin(medians)
        .select("peptide_id", "sequence", "length", *ordered, *[f"median_{c}" for c in SUMMARY_MEDIANS])
    )


def concise_summary(extended: DataFrame) -> DataFrame:
    """The headline columns; coverage and equal-rate columns of the conservative tiers get their short names."""
    names = {"cons_le1": "le1_conservative", "cons_le2": "le2_conservative"}
    out = [F.col("peptide_id"), F.col("sequence")]
    for t in ("exact", "cons_le1", "cons_le2"):
        out.append(F.col(f"median_missing_reference_lower_{t}"))
        out += [F.col(f"{n}_{t}").alias(f"{n}_{names.get(t, t)}") for n in ("median_coverage", "median_equal_rate_extrapolated_coverage")]
        out.append(F.col(f"median_missing_reference_upper_{t}"))
    return extended.select(*out, *[f"median_{c}" for c in SUMMARY_MEDIANS[:4]])


def threshold_qc(peptides: DataFrame, found: DataFrame, breadth: DataFrame) -> DataFrame:
    """One row a peptide: the median share of broad carriers and their number, by tier."""
    medians = _wide(tier_medians(found), ["median_thresholded_coverage"])
    carriers = breadth.groupBy("peptide_id").agg(*[F.sum(F.col(f"carrier_broad_hq_{t}").cast("int")).alias(f"n_broad_carrier_species_{t}") for t in TIERS])
    return peptides.select("peptide_id", "sequence", "length").join(medians, "peptide_id", "left").join(carriers, "peptide_id", "left")

