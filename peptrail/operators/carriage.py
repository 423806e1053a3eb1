"""From protein hits to genomes and to the share of a species' genomes that carry a peptide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peptrail.checks import once, require_none
from peptrail.functions.text import all_aliases, genome_alias, share
from peptrail.operators.labels import resolved
from peptrail.plans.stages import staged
from peptrail.settings import TIERS, Settings


def line_aliases(lines: DataFrame) -> DataFrame:
    """Distinct identifiers named anywhere in the membership lines."""
    return lines.select(F.explode(all_aliases(F.col("line"))).alias("alias")).distinct()


def membership_inventory(genomes: DataFrame, lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """``genome_id, in_uhgp_membership`` of every genome."""
    present = resolved(line_aliases(lines), aliases).where("genome_id is not null").select("genome_id").distinct().withColumn("there", F.lit(True))
    return genomes.select("genome_id").distinct().join(present, "genome_id", "left").select("genome_id", F.coalesce("there", F.lit(False)).alias("in_uhgp_membership"))


def unresolved_aliases(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    return resolved(line_aliases(lines), aliases).where("genome_id is null").select("alias")


def inventory_counts(lines: DataFrame) -> DataFrame:
    filled = lines.where(F.trim("line") != "")
    return filled.agg(
        F.count("*").alias("nonempty_membership_lines"),
        F.coalesce(F.sum((F.size(all_aliases(F.col("line"))) == 0).cast("long")), F.lit(0)).alias("lines_without_recognized_alias_n"),
    )


def _tokens(line: Column) -> Column:
    """Pieces of a line between tabs, commas, semicolons and blanks."""
    return F.filter(F.split(line, "[\t,; ]+"), lambda t: t != "")


def _heads(line: Column) -> Column:
    """First words of fields that hold a separator."""
    firsts = F.filter(F.transform(F.split(line, "\t"), lambda f: F.regexp_extract(f, r"^\s*(\S+)", 1)), lambda t: t.rlike("[,;]"))
    return F.when(line.rlike("[,;]"), firsts).otherwise(F.array().cast("array<string>"))


#: wanted names that go out to the tasks that read the membership (some megabytes); more are met by a join
NAMES_SENT = 200_000


_SEPARATOR = np.isin(np.arange(256), [ord(c) for c in "\t,; "])


def _pieces(line: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Tokens and what separates them, side by side as views of the lines; which are tokens, and where each line's begin."""
    offsets = np.frombuffer(line.buffers()[1], np.int32, len(line) + 1, 4 * line.offset)
    raw = np.frombuffer(line.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    ends, apart = offsets - offsets[0], _SEPARATOR[raw]
    cuts = np.unique(np.r_[ends, np.flatnonzero(apart[1:] != apart[:-1]) + 1]).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(raw))
    return pieces, ~apart[cuts[:-1]], np.searchsorted(cuts, ends)


def _naming(lines: DataFrame, names: list[str]) -> DataFrame:
    """``line, found`` of the lines that hold one of the names, with the tokens that are names.

    Where a name holds a separator, lines with separators are kept whatever they hold.
    """
    held = pa.array(names, pa.string())
    odd = any("," in n or ";" in n for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line = batch.column(0)
            if not batch.num_rows:
                continue
            flat, token, first = _pieces(line)
            hit = np.flatnonzero(pc.is_in(flat, value_set=held).to_numpy(zero_copy_only=False) & token)
            many = np.diff(np.searchsorted(hit, first))
            kept = many > 0
            if odd:
                kept |= pc.fill_null(pc.match_substring_regex(line, "[,;]"), False).to_numpy(zero_copy_only=False)
            found = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), flat.take(pa.array(hit)))
            yield pa.RecordBatch.from_arrays([line.filter(pa.array(kept)), found.filter(pa.array(kept))], ["line", "found"])

    return lines.select("line").mapInArrow(run, "line string, found array<string>")


#: pairs that a line may give at once for each of its names and identifiers
_FOLD = 16


def named_lines(lines: DataFrame, representatives: DataFrame, most_sent: int = NAMES_SENT) -> DataFrame:
    """``line_id, protein_rep_ids, heads, aliases, direct`` of the lines that may name a wanted representative; the lines' one read.

    Up to ``most_sent`` wanted names are looked up where the lines are read, so that only lines that hold one, and
    of their tokens only those, go on; with more names every token does. Each line is one row, so long lines take linear
    space. Equal lines have one key. A line is ``direct`` if what it names is known where it is read (no wanted name holds
    a separator) and its names times its identifiers are in proportion to it.
    """
    wanted = staged(representatives.select("protein_rep_id").dropna().distinct(), "wanted")
    names = [r[0] for r in wanted.limit(most_sent + 1).collect()]
    line, sent = F.col("line"), len(names) <= most_sent
    kept = _naming(lines.where(line.isNotNull()), sorted(names)) if sent else lines.where(F.trim(line) != "").select("line", _tokens(line).alias("found"))
    settled = sent and not any("," in n or ";" in n for n in names)
    known = F.array_distinct(F.filter(F.transform(_tokens(line), genome_alias), lambda a: a.isNotNull()))
    n, m = F.size("protein_rep_ids"), F.size("aliases")
    rows = kept.select(F.md5("line").alias("line_id"), F.array_distinct("found").alias("protein_rep_ids"), _heads(line).alias("heads"), known.alias("aliases"))
    return staged(rows.withColumn("direct", F.lit(settled) & (n.cast("long") * m <= _FOLD * (n + m))), "named_lines")


def representative_lines(named: DataFrame, representatives: DataFrame) -> DataFrame:
    """``protein_rep_id, line_id``: which of the ``named_lines`` name which wanted representatives.

    A token must equal the representative; only on lines without such a token may a field's first word,
    separators included, be one.
    """
    whole = lambda names, mark: F.transform(names, lambda t: F.struct(t.alias("protein_rep_id"), F.lit(mark).alias("whole")))
    found = named.select("line_id", F.inline(F.concat(whole(F.col("protein_rep_ids"), 1), whole(F.col("heads"), 0))))
    met = found.join(representatives.select("protein_rep_id").distinct(), "protein_rep_id", "left_semi")
    best = F.max("whole").over(Window.partitionBy("line_id"))
    return met.withColumn("best", best).where("whole = best").select("protein_rep_id", "line_id").distinct()


def rep_genome_pairs(named: DataFrame, representatives: DataFrame, aliases: DataFrame, genomes: DataFrame) -> DataFrame:
    """``protein_rep_id, genome_id``: wanted representatives with the selected genomes of their ``named_lines``.

    A direct line gives its pairs where it is read. Of the others identifiers are made genomes before they meet the
    representatives of their line. A representative's own name may hold an identifier.
    """
    wanted = representatives.select("protein_rep_id").distinct()
    chosen = genomes.select("genome_id")
    found = named.where("direct").select(F.explode("protein_rep_ids").alias("protein_rep_id"), "aliases")
    told = F.array_compact(F.concat("aliases", F.array(genome_alias(F.col("protein_rep_id")))))
    pairs = found.select("protein_rep_id", F.explode(told).alias("alias")).distinct().join(wanted, "protein_rep_id", "left_semi")
    pairs = resolved(pairs, aliases).join(chosen, "genome_id", "left_semi").select("protein_rep_id", "genome_id")
    rest = named.where("not direct")
    return (pairs if rest.isEmpty() else pairs.unionByName(_met_by_line(rest, wanted, aliases, chosen))).distinct()


def _met_by_line(named: DataFrame, representatives: DataFrame, aliases: DataFrame, genomes: DataFrame) -> DataFrame:
    """``rep_genome_pairs`` of lines of any length: a join by the line's key."""
    wanted = staged(representative_lines(named, representatives), "wanted_lines")
    on_lines = named.join(wanted.select("line_id").distinct(), "line_id", "left_semi").select("line_id", F.explode("aliases").alias("alias"))
    own = wanted.select("protein_rep_id", F.concat(F.lit("own "), "protein_rep_id").alias("line_id")).distinct()
    told = on_lines.unionByName(own.select("line_id", genome_alias(F.col("protein_rep_id")).alias("alias")).where("alias is not null"))
    found = resolved(told, aliases).join(genomes, "genome_id", "left_semi").select("line_id", "genome_id").distinct()
    return wanted.unionByName(own).join(found, "line_id").select("protein_rep_id", "genome_id")


def missing_representatives(named: DataFrame, representatives: DataFrame) -> DataFrame:
    """Wanted representatives that none of the ``named_lines`` names; any makes a run's results unusable."""
    seen = representative_lines(named, representatives).select("protein_rep_id")
    return representatives.select("protein_rep_id").distinct().join(seen, "protein_rep_id", "left_anti")


def check_representatives(named: DataFrame, representatives: DataFrame) -> None:
    require_none(missing_representatives(named, representatives), F.lit(True), "hit proteins are missing from the membership", show=20)


def evaluable_genomes(genomes: DataFrame, inventory: DataFrame) -> DataFrame:
    known = once(inventory, ["genome_id"], "the inventory")
    return once(genomes, ["genome_id"], "the selected genomes").join(known, "genome_id", "left").withColumn("evaluable_hq", F.col("high_quality") & F.col("in_uhgp_membership"))


def genome_presence(hits: DataFrame, pairs: DataFrame, genomes: DataFrame) -> DataFrame:
    """Tiers in which a genome carries a peptide. A protein's windows are merged before they fan out to genomes."""
    by_protein = hits.groupBy("peptide_id", "protein_rep_id").agg(*[F.max(t).alias(t) for t in TIERS]).where(F.greatest(*TIERS) > 0)
    return (
        by_protein.join(pairs, "protein_rep_id")
        .join(once(genomes.select("genome_id", "species_key", "high_quality", "evaluable_hq"), ["genome_id"], "the selected genomes"), "genome_id")
        .groupBy("peptide_id", "genome_id", "species_key", "high_quality", "evaluable_hq")
        .agg(*[F.max(t).alias(t) for t in TIERS])
    )


def species_evaluability(panel: DataFrame, genomes: DataFrame) -> DataFrame:
    """Panel species (with their genome counts) and how many of their genomes the membership represents."""
    counts = genomes.groupBy("species_key").agg(
        F.sum(F.col("in_uhgp_membership").cast("int")).alias("n_genomes_in_uhgp"),
        F.sum(F.col("evaluable_hq").cast("int")).alias("n_hq_genomes_in_uhgp"),
    )
    n = F.col("n_hq_genomes_in_uhgp")
    return (
        once(panel, ["species_key"], "the panel").join(counts, "species_key", "left").fillna(0, ["n_genomes_in_uhgp", "n_hq_genomes_in_uhgp"])
        .withColumn("hq_reference_representation_fraction", share(n, F.col("n_uhgg_genomes_hq")))
        .withColumn("hq_evaluable", n > 0)
        .withColumn("low_hq_reference_n", n.between(1, 4))
    )


def species_breadth(peptides: DataFrame, species: DataFrame, presence: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The full grid of peptides and panel species with hits and breadth in each tier; without hits 0.

    The grid has (peptides x species) rows by definition. Breadth over no genomes is null.
    """
    sums = presence.groupBy("peptide_id", "species_key").agg(
        *[F.sum(t).alias(f"hit_genomes_all_{t}") for t in TIERS],
        *[F.sum(F.when(F.col("evaluable_hq"), F.col(t)).otherwise(0)).alias(f"hit_genomes_hq_{t}") for t in TIERS],
    )
    counted = [c for c in sums.columns if c.startswith("hit_")]
    grid = peptides.select("peptide_id", "sequence", "length").crossJoin(species).join(sums, ["peptide_id", "species_key"], "left").fillna(0, counted)
    more = {}
    for t in TIERS:
        every, good = F.col(f"hit_genomes_all_{t}"), F.col(f"hit_genomes_hq_{t}")
        more[f"breadth_all_{t}"] = share(every, F.col("n_genomes_in_uhgp"))
        more[f"breadth_hq_{t}"] = share(good, F.col("n_hq_genomes_in_uhgp"))
        more[f"breadth_hq_all_references_{t}"] = share(good, F.col("n_uhgg_genomes_hq"))
        more[f"carrier_broad_hq_{t}"] = F.coalesce(
            (F.col("n_hq_genomes_in_uhgp") >= settings.min_hq_genomes_for_broad) & (more[f"breadth_hq_{t}"] >= settings.broad_breadth), F.lit(False)
        )
    return grid.withColumns(more)
