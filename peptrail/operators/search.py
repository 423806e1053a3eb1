"""Near matches of peptides in proteins: windows that differ in at most three residues, graded by Grantham's distance.

A peptide is cut into four parts; three substitutions leave one of them whole. Proteins are scanned in
batches: parts are looked up in tables of up to five residues, for all peptides at once, and compared
whole before a window is looked at. The lookups follow the residues, the comparisons the parts that
were found, which are in proportion to residues times peptides, some 20^3 to 20^6 times fewer. Few peptides
are sent to every executor; many are a distributed side, dealt to shards by their parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from peptrail.functions.aminoacids import DISTANCE, RESIDUES, UNKNOWN, encoded
from peptrail.settings import MAX_SUBSTITUTIONS

HIT_SCHEMA = (
    "peptide_id string, query_sequence string, protein_rep_id string, protein_start_1based int, matched_sequence string, "
    "n_substitutions int, n_conservative int, n_nonconservative int, substitutions string, max_grantham int, grantham_sum int, "
    "exact int, cons_le1 int, cons_le2 int, cons_le3 int, unrestricted_le1 int, unrestricted_le2 int"
)
HIT_COLUMNS = [c.split()[0] for c in HIT_SCHEMA.split(", ")]
#: peptides that go out to every executor; more meet the proteins in shards of so many
PEPTIDES_SENT, SHARD_PEPTIDES = 20_000, 50_000
_TABLE = 5
_LETTERS = np.array(list(RESIDUES), object)
_WHOLE = {c: "Int32" for c in HIT_COLUMNS if c.startswith(("protein_start", "n_", "max_", "grantham", "exact", "cons", "unres"))}


def parts(length: int, n: int = MAX_SUBSTITUTIONS + 1) -> list[tuple[int, int]]:
    """Offsets and lengths of n parts, longer ones first."""
    n = min(max(1, n), length)
    short, longer = divmod(length, n)
    sizes = [short + (i < longer) for i in range(n)]
    return [(sum(sizes[:i]), size) for i, size in enumerate(sizes)]


def seed_table(peptides: DataFrame, n: int = MAX_SUBSTITUTIONS + 1, keep: tuple[str, ...] = ("peptide_id",)) -> DataFrame:
    """``part, offset, seed`` of each peptide, as expressions, beside the columns to keep."""
    size = F.length("sequence")
    k = F.least(F.lit(n), size)
    short, longer = F.floor(size / k).cast("int"), (size % k).cast("int")
    place = lambda i: i * short + F.least(i, longer)
    cut = F.transform(
        F.sequence(F.lit(0), k - 1),
        lambda i: F.struct(i.alias("part"), place(i).alias("offset"), F.substring(F.col("sequence"), place(i) + 1, short + F.when(i < longer, 1).otherwise(0)).alias("seed")),
    )
    return peptides.select(*keep, F.inline(cut))


class Scanner:
    """Seeded windows of a set of peptides in concatenated proteins.

    ``held`` tells which parts of each peptide are looked up here (all, unless another scanner has the rest). A part
    with other than standard residues is found nowhere.
    """

    def __init__(self, ids: list[str], sequences: list[str], held: np.ndarray | None = None):
        self.ids, self.sequences = np.array(ids, object), np.array(sequences, object)
        self.length = np.array([len(s) for s in sequences], np.int64)
        self.codes = np.full((len(sequences), int(self.length.max(initial=0))), UNKNOWN, np.uint8)
        text = encoded("".join(sequences))
        self.codes[np.arange(self.codes.shape[1]) < self.length[:, None]] = text
        #: residues that a peptide has, and those of each of its parts
        self.inside = np.arange(self.codes.shape[1]) < self.length[:, None]
        self.in_part = np.zeros((len(sequences), MAX_SUBSTITUTIONS + 1, self.codes.shape[1]), bool)
        seeds: dict[int, list[np.ndarray]] = {}
        for n in np.unique(self.length[self.length > 0]).tolist():
            some = np.flatnonzero(self.length == n)
            for part, (offset, size) in enumerate(parts(n)):
                self.in_part[some, part, offset : offset + size] = True
                own = some if held is None else some[held[some, part]]
                own = own[(self.codes[own, offset : offset + size] != UNKNOWN).all(1)]
                width = min(size, _TABLE)
                key = self.codes[own, offset : offset + width].astype(np.int64) @ 20 ** np.arange(width - 1, -1, -1)
                fixed = np.broadcast_to(np.array([[part], [offset], [size]], np.int64), (3, len(own)))
                seeds.setdefault(width, []).append(np.vstack([key, own, fixed]))
        #: by residues of the key: where each key's rows begin, which keys have any; peptide, part, offset and size of each row
        self.tables = {}
        for width, rows in seeds.items():
            rows = np.hstack(rows)
            key, *columns = rows[:, np.argsort(rows[0], kind="stable")]
            bounds = np.searchsorted(key, np.arange(20**width + 1)).astype(np.int32)
            self.tables[width] = bounds, bounds[1:] > bounds[:-1], columns

    def proposals(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, at_once: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Peptides, parts and starts of windows inside one protein that hold that part whole, about ``at_once`` at a time."""
        bad = text == UNKNOWN
        letters, odd = np.where(bad, 0, text).astype(np.int32), np.r_[0, np.cumsum(bad, dtype=np.int32)]
        keys, width = np.zeros(len(text), np.int32), 0  # of the residues from each place on, longer from table to table
        for size, (bounds, used, (peptide, part, offset, whole)) in sorted(self.tables.items()):
            n = len(text) - size + 1
            if n < 1:
                break
            while width < size:
                keys = keys[: len(text) - width] * 20 + letters[width:]
                width += 1
            places = np.flatnonzero(used[keys] & (odd[size:] == odd[:n]))
            key = keys
            low, many = bounds[key[places]].astype(np.int64), (bounds[key[places] + 1] - bounds[key[places]]).astype(np.int64)
            upto, first = np.cumsum(many), 0
            while first < len(places):
                last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + at_once, side="right")))
                m = many[first:last]
                row = np.repeat(low[first:last], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                at = np.repeat(places[first:last], m) - offset[row]
                first = last
                p = peptide[row]
                owner = np.minimum(np.searchsorted(end, np.maximum(at, 0), side="right"), len(end) - 1)
                good = (at >= start[owner]) & (at + self.length[p] <= end[owner])
                for j in range(size, int(whole.max())):  # residues of the part beyond the table's
                    some = np.flatnonzero(good & (whole[row] > j))
                    place = offset[row[some]] + j
                    good[some] = text[at[some] + place] == self.codes[p[some], place]
                yield p[good], part[row[good]], at[good]

    def search(self, names: list[str], proteins: list[str], cutoff: int) -> pd.DataFrame:
        """Rows of ``HIT_COLUMNS`` and ``ambiguous`` (a seeded window with other than a standard residue).

        A window is compared for each part that it holds whole and taken with the first of them.
        """
        codes = [encoded(s) for s in proteins]
        size = np.array([len(c) for c in codes], np.int64)
        end = np.cumsum(size + 1) - 1
        start = end - size
        text = np.full(int(size.sum() + len(size)), UNKNOWN, np.uint8)
        for a, code in zip(start.tolist(), codes, strict=True):
            text[a : a + len(code)] = code
        padded = np.r_[text, np.full(self.codes.shape[1], UNKNOWN, np.uint8)]
        found = [self._taken(peptide, part, at, padded) for peptide, part, at in self.proposals(text, start, end)]
        p, at = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        if not len(p):
            return pd.DataFrame(columns=[*HIT_COLUMNS, "ambiguous"])
        owner = np.searchsorted(end, at, side="right")
        first, n = at - start[owner], self.length[p]
        shown = [proteins[k][a : a + long] for k, a, long in zip(owner.tolist(), first.tolist(), n.tolist(), strict=True)]
        named = np.array(names, object)[owner]
        head = dict(zip(HIT_COLUMNS[:5], (self.ids[p], self.sequences[p], named, first + 1, shown), strict=True))
        return pd.DataFrame(head | self._graded(p, *self._compared(p, at, padded), cutoff))

    def _compared(self, p: np.ndarray, at: np.ndarray, padded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows as wide as the longest peptide, where they differ within their own length, and which are ambiguous."""
        window = padded[at[:, None] + np.arange(self.codes.shape[1])]
        inside = self.inside[p]
        return window, (window != self.codes[p]) & inside, ((window == UNKNOWN) & inside).any(1)

    def _taken(self, p: np.ndarray, part: np.ndarray, at: np.ndarray, padded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Peptides and starts of the windows that count: close or ambiguous, and met by the first part that they hold whole."""
        _, differs, odd = self._compared(p, at, padded)
        near = np.flatnonzero(odd | (differs.sum(1) <= MAX_SUBSTITUTIONS))
        whole = ~(differs[near, None, :] & self.in_part[p[near]]).any(2)
        near = near[whole.argmax(1) == part[near]]
        return p[near], at[near]

    def _graded(self, p: np.ndarray, window: np.ndarray, differs: np.ndarray, odd: np.ndarray, cutoff: int) -> dict[str, object]:
        """Grades of windows; an ambiguous one has none."""
        query = self.codes[p]
        differs = differs & ~odd[:, None]
        gap = np.zeros(differs.shape, np.int16)
        gap[differs] = DISTANCE[query[differs], window[differs]]
        n_sub, close = differs.sum(1), (differs & (gap <= cutoff)).sum(1)
        row, place = np.nonzero(differs)
        one = _LETTERS[query[differs]] + (place + 1).astype(str).astype(object) + _LETTERS[window[differs]] + ":" + gap[differs].astype(str).astype(object)
        rank = np.arange(len(row)) - (np.cumsum(n_sub) - n_sub)[row]
        text = np.full(len(p), "", object)
        for k in range(MAX_SUBSTITUTIONS):
            some = rank == k
            text[row[some]] = text[row[some]] + (";" if k else "") + one[some]
        text[odd] = None
        pure = n_sub == close
        grades = (n_sub, close, n_sub - close, text, gap.max(1, initial=0), gap.sum(1), n_sub == 0, *((n_sub <= m) & pure for m in (1, 2, 3)), n_sub <= 1, n_sub <= 2)
        return {c: v if v is text else pd.arrays.IntegerArray(v.astype(np.int32), odd.copy()) for c, v in zip(HIT_COLUMNS[5:], grades, strict=True)} | {"ambiguous": odd}


def _in_batches(scanner: Scanner, names: list[str], texts: list[str], cutoff: int, batch_residues: int) -> Iterator[pd.DataFrame]:
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (end == at or n + len(texts[end]) <= batch_residues):
            n += len(texts[end])
            end += 1
        yield scanner.search(names[at:end], texts[at:end], cutoff).astype(_WHOLE)
        at = end


def _both(proteins: DataFrame, peptides: DataFrame) -> tuple[DataFrame, DataFrame]:
    return proteins.select("protein_rep_id", "sequence"), peptides.select("peptide_id", "sequence").dropna()


def scan(
    proteins: DataFrame, peptides: DataFrame, cutoff: int = 50, batch_residues: int = 2_000_000, most: int = PEPTIDES_SENT, read: Observation | None = None
) -> DataFrame:
    """Hits and ambiguous windows of ``proteins(protein_rep_id, sequence)``, in one pass over them.

    Up to ``most`` peptides (under a megabyte) go out to every executor, and nothing is shuffled; more meet the
    proteins by their seeds (``exchanged``). Each protein record is scanned for itself, so records with one id give
    their hits each. Null ids, sequences and peptides take no part. ``read`` observes the records and residues that
    were read (``proteins, residues``), nulls too, in the stage that gives the rows.
    """
    proteins, peptides = _both(proteins, peptides)
    listed = peptides.limit(most + 1).collect()
    if len(listed) > most:
        return exchanged(proteins, peptides, cutoff, batch_residues, read=read)
    sent = proteins.sparkSession.sparkContext.broadcast(sorted((r.peptide_id, r.sequence) for r in listed))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner([p for p, _ in sent.value], [s for _, s in sent.value])
        for frame in frames:
            frame = frame.dropna()
            yield from _in_batches(scanner, frame.protein_rep_id.tolist(), frame.sequence.tolist(), cutoff, batch_residues)

    if read is not None:
        proteins = proteins.observe(read, F.count(F.lit(1)).alias("proteins"), F.coalesce(F.sum(F.length("sequence")), F.lit(0)).alias("residues"))
    return proteins.mapInPandas(run, HIT_SCHEMA + ", ambiguous boolean")


def seeds_by_shard(peptides: DataFrame, shards: int, most_a_seed: int) -> DataFrame:
    """``peptide_id, sequence, part, shard``: the parts of all peptides, dealt by their residues.

    Equal seeds stand in one shard, but for hot ones: a seed of over ``most_a_seed`` parts is dealt over as many
    shards as it takes.
    """
    cut = seed_table(peptides.where(F.length("sequence") > 0), keep=("peptide_id", "sequence"))
    size = cut.groupBy("seed").agg(F.ceil(F.count("*") / most_a_seed).alias("slices"))
    mark = F.pmod(F.xxhash64("seed", F.pmod(F.xxhash64("peptide_id", "part"), F.col("slices"))), F.lit(shards))
    return cut.join(size, "seed").select("peptide_id", "sequence", "part", mark.cast("int").alias("shard"))


def exchanged(
    proteins: DataFrame, peptides: DataFrame, cutoff: int = 50, batch_residues: int = 2_000_000, shard_peptides: int = SHARD_PEPTIDES, read: Observation | None = None
) -> DataFrame:
    """``scan`` for any number of peptides: their parts and the proteins meet in shards of seeds.

    A shard holds the seeds of about ``shard_peptides`` peptides; every protein goes to each shard once, whole, for
    most proteins hold seeds of all shards, and a residue takes a byte where a seeded window would take fifty. So the
    shuffle is shards times residues. Each shard is dealt over many partitions, where the seeds stand first and
    the proteins stream by: what a task holds is bounded by a shard's seeds and a batch of proteins. A window that
    several shards find is taken by the shard of its first whole part.
    """
    spark = proteins.sparkSession
    proteins, peptides = _both(proteins, peptides)
    n = peptides.count()
    shards = max(1, -(-n // shard_peptides))
    slices = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    seeds = seeds_by_shard(peptides, shards, max(1, shard_peptides // 8))
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    first = seeds.select(F.col("peptide_id").alias("name"), "sequence", F.col("part").cast("int").alias("part"), "shard", every.alias("slice"))
    dealt = proteins.withColumn("slice", F.pmod(F.monotonically_increasing_id(), F.lit(slices)).cast("int"))
    rest = dealt.select(
        F.col("protein_rep_id").alias("name"), "sequence", F.lit(-1).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "slice"
    )
    met = first.unionByName(rest).withColumn("place", F.col("shard") * slices + F.col("slice"))
    met = met.repartitionById(shards * slices, "place").sortWithinPartitions("place", F.desc("part"))
    if read is not None:
        once = (F.col("part") < 0) & (F.col("shard") == 0)
        met = met.observe(read, F.count_if(once).alias("proteins"), F.coalesce(F.sum(F.when(once, F.length("sequence"))), F.lit(0)).alias("residues"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, held, scanner = -1, [], None
        for frame in frames:
            for here, rows in frame.groupby("place"):
                if here != place:
                    place, held, scanner = here, [], None
                own, others = rows[rows.part >= 0], rows[rows.part < 0].dropna(subset=["name", "sequence"])
                if len(own):
                    held.append(own)
                if not len(others) or not (held or scanner):
                    continue
                if scanner is None:
                    scanner, held = _of_seeds(pd.concat(held)), []
                yield from _in_batches(scanner, others.name.tolist(), others.sequence.tolist(), cutoff, batch_residues)

    return met.select("place", "part", "name", "sequence").mapInPandas(run, HIT_SCHEMA + ", ambiguous boolean")


def _of_seeds(rows: pd.DataFrame) -> Scanner:
    """A scanner of the given parts; a peptide that comes several times is several peptides."""
    rows = rows.assign(copy=rows.groupby(["name", "sequence", "part"]).cumcount())
    known = rows.groupby(["name", "sequence", "copy"], sort=True)
    held = np.zeros((known.ngroups, MAX_SUBSTITUTIONS + 1), bool)
    held[known.ngroup().to_numpy(), rows.part.to_numpy()] = True
    names = known.size().index
    return Scanner(names.get_level_values(0).tolist(), names.get_level_values(1).tolist(), held)


def hits(scanned: DataFrame) -> DataFrame:
    return scanned.where(~F.col("ambiguous")).drop("ambiguous")


def ambiguous_windows(scanned: DataFrame) -> DataFrame:
    return scanned.where("ambiguous").select("peptide_id", "protein_rep_id", "protein_start_1based")


def hit_examples(found: DataFrame, n: int) -> DataFrame:
    """The first ``n`` hits of each peptide: fewest substitutions, least distance, then by protein and place."""
    from pyspark.sql import Window

    order = Window.partitionBy("peptide_id").orderBy("n_substitutions", "max_grantham", "protein_rep_id", "protein_start_1based")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


def search_counts(scanned: DataFrame, read: dict[str, int]) -> DataFrame:
    """One row of totals of a search; ``read`` holds what its scan observed, so the proteins are not read again."""
    return scanned.agg(
        F.coalesce(F.sum(F.col("ambiguous").cast("long")), F.lit(0)).alias("ambiguous_windows"),
        F.coalesce(F.sum((~F.col("ambiguous")).cast("long")), F.lit(0)).alias("hits"),
        F.count_distinct(F.when(~F.col("ambiguous"), F.col("protein_rep_id"))).alias("hit_representatives"),
    ).withColumns({name: F.lit(read[name]).cast("long") for name in ("proteins", "residues")})
