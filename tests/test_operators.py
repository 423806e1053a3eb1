import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peptrail.checks import DataError
from peptrail.functions.aminoacids import RESIDUES, distance
from peptrail.operators import abundance as ab
from peptrail.operators import carriage as ca
from peptrail.operators import coverage as co
from peptrail.operators import labels as la
from peptrail.operators import quantiles as qu
from peptrail.operators import search as se
from peptrail.operators.ordered import running_sum
from peptrail.settings import TIERS


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- distances and parts


def test_distances():
    assert (distance("I", "L"), distance("D", "W"), distance("F", "V"), distance("K", "Q"), distance("L", "V"), distance("A", "A")) == (5, 181, 50, 53, 32, 0)
    with pytest.raises(ValueError):
        distance("A", "X")


def test_parts(spark):
    assert [[n for _, n in se.parts(k)] for k in (12, 13, 14, 25)] == [[3, 3, 3, 3], [4, 3, 3, 3], [4, 4, 3, 3], [7, 6, 6, 6]]
    text = "ACDEFGHIKLMNPQ"
    got = rows(se.seed_table(spark.createDataFrame([("p", text)], "peptide_id string, sequence string")))
    assert got == [("p", i, a, text[a : a + n]) for i, (a, n) in enumerate(se.parts(14))]


# -- search


def one(query, protein, cutoff=50):
    return se.Scanner(["q"], [query]).search(["t"], [protein], cutoff)


Q = "ACDEFGHIKLMN"


def test_exact_hit():
    r = one(Q, "MM" + Q).iloc[0]
    assert (r.protein_start_1based, r.n_substitutions, r.substitutions, r.max_grantham) == (3, 0, "", 0)
    assert [r[t] for t in TIERS] == [1] * 6


@pytest.mark.parametrize(
    "window, text, tiers",
    [
        ("ACDEFGHLKLMN", "I8L:5", [0, 1, 1, 1, 1, 1]),
        ("ACWEFGHIKLMN", "D3W:181", [0, 0, 0, 0, 1, 1]),
        ("ACWEFGHLKVMN", "D3W:181;I8L:5;L10V:32", [0, 0, 0, 0, 0, 0]),
    ],
)
def test_grades(window, text, tiers):
    r = one(Q, window).iloc[0]
    assert r.substitutions == text and [r[t] for t in TIERS] == tiers


def test_cutoff_is_inclusive():
    r = one(Q, Q.replace("F", "V")).iloc[0]
    assert (r.max_grantham, r.n_conservative) == (50, 1)
    assert one(Q, Q.replace("K", "Q")).iloc[0].n_nonconservative == 1


def test_ambiguous_windows_need_a_whole_part():
    assert one(Q, "ACDEFGXIKLMN").ambiguous.tolist() == [True]
    assert len(one(Q, "AXDEWGHIWLMW")) == 0
    assert len(one(Q, Q[3:])) == 0 and len(one(Q, Q[:9])) == 0
    assert len(one(Q, "")) == 0


def brute(query, protein):
    out = []
    for a in range(len(protein) - len(query) + 1):
        w = protein[a : a + len(query)]
        d = [x != y for x, y in zip(query, w)]
        whole = any(not any(d[o : o + n]) for o, n in se.parts(len(query)))
        odd = any(c not in RESIDUES for c in w)
        if whole and (odd or sum(d) <= 3):
            out.append((a + 1, odd, None if odd else sum(d)))
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_search_is_exhaustive(seed):
    r = random.Random(seed)
    letters = RESIDUES[: r.choice([2, 4, 20])] + r.choice(["", "X*"])
    queries = ["".join(r.choice(RESIDUES[:4]) for _ in range(r.randint(12, 25))) for _ in range(3)]
    proteins = ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(3)]
    proteins.append("".join(r.choice(letters) if r.random() < 0.1 else c for c in queries[0] * 2))
    got = se.Scanner(["a", "b", "c"], queries).search(list("wxyz"), proteins, 50)
    have = sorted((p, t, a, bool(o), None if o else int(n)) for p, t, a, o, n in zip(got.peptide_id, got.protein_rep_id, got.protein_start_1based, got.ambiguous, got.n_substitutions))
    want = sorted((p, t, *x) for p, q in zip("abc", queries) for t, s in zip("wxyz", proteins) for x in brute(q, s))
    assert have == want


def test_scan_does_not_depend_on_partitions(spark):
    r = random.Random(5)
    proteins = spark.createDataFrame([(f"t{i}", "".join(r.choice(RESIDUES[:5]) for _ in range(60))) for i in range(40)] + [("t1", Q), (None, Q), ("n", None)], "protein_rep_id string, sequence string")
    peptides = spark.createDataFrame([("a", "".join(r.choice(RESIDUES[:5]) for _ in range(12))), ("b", Q)], "peptide_id string, sequence string")
    one_part, many = (rows(se.hits(se.scan(proteins.repartition(n), peptides))) for n in (1, 7))
    assert one_part == many and any(h[0] == "b" for h in many)
    assert se.scan(proteins, peptides.limit(0)).count() == 0
    assert se.scan(proteins.limit(0), peptides).count() == 0


def windows_of(r, proteins, n):
    """Peptides that stand in proteins, some of them changed."""
    out = []
    for k in range(n):
        text = r.choice(proteins)
        size = r.randint(12, 25)
        a = r.randrange(len(text) - size)
        p = list(text[a : a + size])
        for _ in range(r.choice([0, 0, 1, 2, 3, 4])):
            p[r.randrange(size)] = r.choice(RESIDUES)
        out.append((f"q{k}", "".join(p).replace("X", "A")))
    return out


def test_exchange_equals_the_scan(spark):
    """More peptides than are sent: hot seeds, repeated peptides and records, nulls; the same rows and the same counts."""
    from pyspark.sql import Observation

    r = random.Random(11)
    texts = ["".join(r.choice(RESIDUES + "X") if r.random() < 0.7 else "A" for _ in range(r.randint(40, 300))) for _ in range(60)]
    texts += ["A" * 200, texts[0], "", "ACD"]
    proteins = spark.createDataFrame([(f"t{k % 50}", t) for k, t in enumerate(texts)] + [(None, Q), ("n", None)], "protein_rep_id string, sequence string")
    asked = windows_of(r, [t for t in texts if len(t) > 30], 300) + [("a", "A" * 12), ("a2", "A" * 25), ("q3", Q), ("twice", Q), ("twice", Q), (None, Q), ("z", None), ("e", ""), ("u", "ACDEFGXHIKLM")]
    peptides = spark.createDataFrame(asked, "peptide_id string, sequence string")
    seen, met = Observation(), Observation()
    want = rows(se.scan(proteins, peptides, read=seen))
    got = rows(se.exchanged(proteins.repartition(3), peptides, shard_peptides=40, read=met))
    assert got == want and len(want) > 1000
    assert seen.get == met.get == {"proteins": len(texts) + 2, "residues": sum(map(len, texts)) + len(Q)}
    assert rows(se.scan(proteins, peptides, most=20)) == want  # chosen by the count
    shards = {(x.peptide_id, x.part): x.shard for x in se.seeds_by_shard(peptides.dropna(), 8, 5).collect()}
    assert len({v for (p, _), v in shards.items() if p in ("a", "a2")}) > 1  # a hot seed is split
    assert se.exchanged(proteins.limit(0), peptides).count() == 0 and se.exchanged(proteins, peptides.limit(0)).count() == 0


def test_two_hundred_thousand_peptides_in_one_pass(spark):
    r = random.Random(2)
    texts = ["".join(r.choices(RESIDUES, k=r.randint(60, 400))) for _ in range(120)]
    asked = windows_of(r, texts, 3_000) + [(f"r{k}", "".join(r.choices(RESIDUES, k=12 + k % 14))) for k in range(197_000)]
    proteins, peptides = spark.createDataFrame([(f"t{k}", t) for k, t in enumerate(texts)], "protein_rep_id string, sequence string"), spark.createDataFrame(asked, "peptide_id string, sequence string")
    found = se.scan(proteins, peptides)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1  # one pass
    whole = se.Scanner([p for p, _ in asked], [s for _, s in asked]).search([f"t{k}" for k in range(120)], texts, 50)
    key = ["peptide_id", "protein_rep_id", "protein_start_1based", "n_substitutions", "substitutions", "max_grantham", "cons_le2"]
    assert rows(found.select(*key)) == sorted((tuple(x) for x in whole[key].itertuples(index=False)), key=repr)
    assert len(whole) > 2_000


def test_counts_read_the_proteins_once(spark):
    """The counts of a search come with its rows: their plan reads the written rows alone."""
    from peptrail.plans import queries

    s = queries.study(spark, "/root/testdata/sf0.001")
    counts = s.search_counts
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "documents" not in plan and "Join" not in plan
    first = counts.first()
    assert (first.proteins, first.residues) == s.proteins.selectExpr("count(*)", "sum(length(sequence))").first()


def test_examples_are_ordered(spark):
    found = spark.createDataFrame([("p", 1, 5, "b", 1), ("p", 0, 0, "z", 3), ("p", 1, 5, "a", 9), ("q", 2, 9, "a", 1)], "peptide_id string, n_substitutions int, max_grantham int, protein_rep_id string, protein_start_1based int")
    assert [r[3] for r in rows(se.hit_examples(found, 2)) if r[0] == "p"] == ["z", "a"] or {r[3] for r in rows(se.hit_examples(found, 2)) if r[0] == "p"} == {"z", "a"}


# -- panel and labels


def test_lineage(spark):
    host = spark.createDataFrame([("d__Bacteria;g__X;s__A b;s__C d",), (None,), ("x; s__ E f ",)], "lineage_gtdb_r207_updated string")
    assert [(r.domain, r.genus, r.species) for r in ab.with_ranks(host).collect()] == [("Bacteria", "X", "C d"), ("", "", ""), ("", "", "E f")]


def test_running_sum_over_ranges(spark):
    """Sums before and up to each row, over several ranges, with ties, nulls and negative numbers; no task takes all rows."""
    r = random.Random(9)
    held = [(f"k{k:04}", r.choice([None, 1.0, 0.5, -2.0, r.random()]), r.randrange(5)) for k in range(700)]
    df = spark.createDataFrame(held, "name string, value double, level int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running_sum(df, "value", (F.desc("level"), F.asc("name")), "before", "upto")
        assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
        found = {x.name: x for x in got.collect()}
        ranges = got.select(F.input_file_name()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranges == 4 and len(found) == 700 and got.columns == ["name", "value", "level", "before", "upto"]
    total = last = 0.0
    for name, value, _ in sorted(held, key=lambda x: (-x[2], x[0])):
        assert found[name].before == last and math.isclose(found[name].before, total, abs_tol=1e-9)
        total, last = total + (value or 0.0), found[name].upto
    assert math.isclose(last, total, abs_tol=1e-9)
    assert running_sum(df.limit(0), "value", (F.asc("name"),), "before", "upto").count() == 0


def test_joins_refuse_doubled_keys(spark):
    """Each join that must not fan out fails where its key stands twice, as it is used and without a job of its own."""
    twice = lambda df: df.unionAll(df)
    prok = spark.createDataFrame([("s", "g", 1.0)], "sample_name string, genome string, relative_abundance double")
    labels = spark.createDataFrame([("g", "UHGG", "A")], "genome_id string, data_source string, species string")
    shares = spark.createDataFrame([("s", "A", 1.0, 1.0)], "sample_name string, species string, relative_abundance double, abundance double")
    samples = spark.createDataFrame([("s", "P", 1)], "sample_name string, bioproject_id string, n_rows int")
    fractions = spark.createDataFrame([("s", 0.5)], f"sample_name string, {co.LABELLED} double")
    genomes = spark.createDataFrame([("g", "C", "", 95.0, 1.0)], GENOMES)
    panel = spark.createDataFrame([("A", True)], "species_key string, selected boolean")
    chosen = spark.createDataFrame([("g", "A", True, "C", 1.0, 1, "genome_exact")], "genome_id string, species_key string, high_quality boolean, species_rep string, mapping_purity double, n_cluster_overlap int, mapping_source string")
    inventory = spark.createDataFrame([("g", True)], "genome_id string, in_uhgp_membership boolean")
    hits = spark.createDataFrame([("p", "r", *[1] * 6)], "peptide_id string, protein_rep_id string, " + ", ".join(f"{t} int" for t in TIERS))
    pairs = spark.createDataFrame([("r", "g")], "protein_rep_id string, genome_id string")
    evaluable = ca.evaluable_genomes(chosen, inventory)
    counts = la.species_genome_counts(chosen, panel)
    joins = [
        (lambda x: ab.labelled(prok, x), labels), (lambda x: ab.included_samples(shares, x, fractions), samples), (lambda x: ab.species_stats(shares, x), samples),
        (lambda x: la.direct_labels(x, labels), genomes), (lambda x: la.species_genome_counts(chosen, x), panel), (lambda x: ca.evaluable_genomes(x, inventory), chosen),
        (lambda x: ca.evaluable_genomes(chosen, x), inventory), (lambda x: ca.genome_presence(hits, pairs, x), evaluable), (lambda x: ca.species_evaluability(x, evaluable), counts),
    ]
    for join, side in joins:
        assert join(side).count() == 1
        with pytest.raises(Exception, match="more than once"):
            join(twice(side)).collect()


# -- quantiles


def by_numpy(groups, probabilities):
    import numpy as np

    return {(k, p): float(np.quantile(np.array(v, float), p)) for k, v in groups.items() if v for p in probabilities}


def held_by(df, keys):
    return {(tuple(r[k] for k in keys), r.p): r.value for r in df.collect()}


def assert_close(got, want):
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


def test_quantiles_equal_numpy(spark):
    r = random.Random(3)
    lines = [(f"g{r.randrange(6)}", r.choice([None, 0.0, 0.5, r.random(), -r.random()])) for _ in range(900)] + [("one", 2.0), ("none", None)]
    groups = {}
    for g, v in lines:
        groups.setdefault((g,), []).extend([] if v is None else [v])
    df = spark.createDataFrame(lines, "g string, value double").repartition(5)
    for many in (False, True):
        assert_close(held_by(qu.quantiles(df, ["g"], [0.5, 0.05, 1.0], many), ["g"]), by_numpy(groups, [0.5, 0.05, 1.0]))


def test_zero_filled_quantiles(spark):
    """Groups whose zeros are not there: all zeros, none, some, and empty ones."""
    r = random.Random(4)
    groups, lines = {}, []
    for k in range(40):
        n, own = r.choice([0, 1, 2, 7, 30]), 0
        own = r.randint(0, n)
        values = [r.choice([0.0, 0.25, r.random()]) for _ in range(own)]
        groups[(f"g{k}",)] = values + [0.0] * (n - own)
        lines += [(f"g{k}", v) for v in values]
    totals = spark.createDataFrame([(k[0], len(v), p) for k, v in groups.items() for p in (0.5, 0.05)], "g string, n long, p double")
    got = qu.zero_filled(spark.createDataFrame(lines, "g string, value double"), ["g"], totals)
    assert_close(held_by(got, ["g"]), by_numpy(groups, (0.5, 0.05)))


def test_quantiles_of_changed_bases(spark):
    """Groups over bases of several scopes, some values moved: ties with the base, to its ends and back."""
    r = random.Random(5)
    bases = {s: [round(r.random(), 1) if r.random() < 0.6 else r.random() for _ in range(n)] for s, n in (("", 25), ("a", 8), ("b", 1), ("c", 40))}
    groups, changes = {}, []
    for k in range(90):
        s = r.choice(list(bases))
        own = list(bases[s])
        for j in r.sample(range(len(own)), r.choice([0, 0, 1, len(own) // 2, len(own)])):
            new = r.choice([0.0, 1.0, own[j], round(r.random(), 1), r.random(), min(1.0, own[j] + 0.05)])
            changes += [(s, f"g{k}", own[j], -1), (s, f"g{k}", new, 1)]
            own[j] = new
        groups[(s, f"g{k}")] = own
    totals = spark.createDataFrame([(*k, len(v), p) for k, v in groups.items() for p in (0.5, 0.05, 0.9)], "s string, g string, n long, p double")
    base = spark.createDataFrame([(s, v) for s, b in bases.items() for v in b], "s string, value double")
    got = qu.changed(base, ["s"], spark.createDataFrame(changes, "s string, g string, value double, weight int"), ["s", "g"], totals)
    assert_close(held_by(got, ["s", "g"]), by_numpy(groups, (0.5, 0.05, 0.9)))


def panel(spark, means, target):
    stats = spark.createDataFrame(means, "species_key string, mean_abundance double")
    return sorted(r.species_key for r in ab.select_panel(stats, target).where("selected").collect())


def test_panel(spark):
    assert panel(spark, [("B", 0.5), ("A", 0.5)], 0.5) == ["A"]
    assert panel(spark, [("A", 0.5), ("B", 0.3)], 0.95) == ["A", "B"]
    assert panel(spark, [("A", 0.6), ("B", 0.3), ("C", 0.1)], 0.61) == ["A", "B"]


def test_projects(spark):
    frame = lambda r: spark.createDataFrame(r, "sample_name string, bioproject_id string")
    assert rows(ab.sample_projects(frame([("S1", "P1 "), ("S1", "P1"), ("S2", None)]), check=True)) == [("S1", "P1", 2), ("S2", "", 1)]
    for bad in ([("S1", "P1"), ("S1", "P2")], [(" ", "P1")], [(None, "P1")]):
        with pytest.raises(DataError):
            ab.sample_projects(frame(bad), check=True)


def test_bad_amounts(spark):
    for bad in (-1.0, float("nan"), float("inf"), None):
        frame = spark.createDataFrame([("S", "bulk", "prok", "g", bad)], "sample_name string, sample_type string, genome_type string, genome string, relative_abundance double")
        with pytest.raises(DataError):
            ab.bulk_prokaryotes(frame, check=True)


GENOMES = "genome_id string, species_rep string, original_genome_id string, completeness double, contamination double"


def test_labels(spark):
    labels = spark.createDataFrame(
        [("g1", "UHGG", "y"), *[(f"m{i}", "UHGG", "x") for i in range(19)], ("b1.1", "UHGG", "s"), ("b2.1", "UHGG", "s"), ("b2.2", "UHGG", "t"), ("o", "OTHER", "z")],
        "genome_id string, data_source string, species string",
    )
    genomes = spark.createDataFrame(
        [("g1", "C", "", 1.0, 1.0), *[(f"m{i}", "C", "", 1.0, 1.0) for i in range(19)], ("new", "C", "", 1.0, 1.0), ("b1", "D", "", 1.0, 1.0), ("b2", "E", "", 1.0, 1.0), ("o", "F", "", 1.0, 1.0)], GENOMES
    )
    got = {r.genome_id: (r.species_key, r.mapping_source) for r in la.genome_labels(genomes, labels, 0.9).collect()}
    assert got["g1"] == ("y", "genome_exact") and got["new"] == ("x", "cluster_fallback") and got["b1"] == ("s", "genome_base")
    assert got["b2"] == (None, "unmapped") and got["o"] == (None, "unmapped")


def test_modal_tie(spark):
    direct = spark.createDataFrame([("C", "y"), ("C", "x"), ("C", "y"), ("C", "x"), ("C", None)], "species_rep string, species string")
    r = la.modal_species(direct, 0.9).first()
    assert (r.species, r.mapping_purity, r.mapping_accepted) == ("x", 0.5, False)


def test_quality_and_aliases(spark):
    genomes = spark.createDataFrame([("a.1", "C", "O1", None, 1.0), ("b", "C", "O1", float("nan"), 1.0), ("c", "C", "nan", 90.0, 5.0), ("d", "C", "", 95.0, None)], GENOMES)
    assert {r.genome_id: r.high_quality for r in la.with_quality(genomes, 90, 5).collect()} == {"a.1": False, "b": False, "c": True, "d": False}
    assert rows(la.alias_map(genomes)) == [("a", "a.1"), ("a.1", "a.1"), ("b", "b"), ("c", "c"), ("d", "d")]
    assert rows(la.ambiguous_aliases(genomes)) == [("O1", 2)]


def test_membership_lines(spark):
    genomes = spark.createDataFrame([("MGYG000000001", "C", "GUT_GENOME000001", 95.0, 1.0), ("MGYG000000002.1", "C", "GUT_GENOME000002", 95.0, 1.0)], GENOMES)
    lines = spark.createDataFrame(
        [("repA\tMGYG000000001_00001,GUT_GENOME000002_00003",), ("repB\tMGYG000000002_00001; repA",), ("  ",), ("rep,C x\tMGYG000000001_1",), ("none\tMGYG999999999_1",)], "line string"
    )
    aliases = la.alias_map(genomes)
    reps = spark.createDataFrame([("repA",), ("repB",), ("rep,C",), ("lost",)], "protein_rep_id string")
    got = rows(ca.rep_genome_pairs(ca.named_lines(lines, reps), reps, aliases, genomes))
    assert got == sorted([("repA", "MGYG000000001"), ("repA", "MGYG000000002.1"), ("repB", "MGYG000000002.1"), ("rep,C", "MGYG000000001")], key=repr)
    named = spark.createDataFrame([("MGYG000000002_7",)], "protein_rep_id string")  # its own name holds an identifier
    told = lines.unionAll(spark.createDataFrame([("MGYG000000002_7\tMGYG000000001_1",)], "line string"))
    assert rows(ca.rep_genome_pairs(ca.named_lines(told, named), named, aliases, genomes)) == [("MGYG000000002_7", "MGYG000000001"), ("MGYG000000002_7", "MGYG000000002.1")]
    assert rows(ca.missing_representatives(ca.named_lines(lines, reps), reps)) == [("lost",)]
    with pytest.raises(DataError):
        ca.check_representatives(ca.named_lines(lines, reps), reps)
    assert rows(ca.unresolved_aliases(lines, aliases)) == [("MGYG999999999",)]
    assert rows(ca.membership_inventory(genomes, lines, aliases)) == [("MGYG000000001", True), ("MGYG000000002.1", True)]


def test_a_membership_line_of_many_tokens(spark):
    tokens = ", ".join(f"r{i}" for i in range(50_000)) + ";" + " ".join(f"MGYG{i:09d}_{i}" for i in range(50_000))
    lines = spark.createDataFrame([(tokens,), ("r7\tMGYG000000003",)], "line string")
    genomes = spark.createDataFrame([(f"MGYG{i:09d}", "C", "", 95.0, 1.0) for i in range(40)], GENOMES)
    reps = spark.createDataFrame([("r7",), ("r49999",), ("no",)], "protein_rep_id string")
    got = rows(ca.rep_genome_pairs(ca.named_lines(lines, reps), reps, la.alias_map(genomes), genomes))
    assert got == sorted(((r, f"MGYG{i:09d}") for r in ("r7", "r49999") for i in range(40)), key=repr)


def test_lines_are_filtered_where_they_are_read(spark):
    """Lines that name nothing wanted end where they are read; with many names wanted the join finds the same."""
    lines = spark.createDataFrame([(f"P{k}\tMGYG{k:09d}_1,MGYG{k + 1:09d}",) for k in range(20_000)], "line string")
    reps = spark.createDataFrame([(f"P{k}",) for k in range(0, 20_000, 100)] + [(None,)], "protein_rep_id string")
    named = ca.named_lines(lines, reps)
    assert rows(named.select("protein_rep_ids")) == sorted((([f"P{k}"],) for k in range(0, 20_000, 100)), key=repr)
    assert {len(r.aliases) for r in named.collect()} == {2}
    none = spark.createDataFrame([], "protein_rep_id string")
    assert ca.named_lines(lines, none).count() == 0 and ca.missing_representatives(named, none).count() == 0
    every = ca.named_lines(lines, reps, most_sent=10)  # more names than are sent: all lines go on to the join
    assert every.count() == 20_000
    assert rows(ca.representative_lines(every, reps)) == rows(ca.representative_lines(named, reps)) and named.count() == 200


# -- coverage


def test_coverage_golden(spark):
    shares = spark.createDataFrame([("1", "A", 0.6), ("1", "B", 0.3), ("1", "C", 0.1), ("2", "C", 1.0)], "sample_name string, species string, abundance double")
    facts = [("A", 4, 4, 3), ("B", 2, 1, 1), ("C", 0, 0, 0)]
    breadth = []
    for s, big_n, n, k in facts:
        row = {"peptide_id": "p", "species_key": s, "n_uhgg_genomes_hq": big_n, "n_hq_genomes_in_uhgp": n, "hq_reference_representation_fraction": n / big_n if big_n else None}
        for t in TIERS:
            row |= {f"breadth_hq_{t}": k / n if n else None, f"carrier_broad_hq_{t}": bool(n and k / n >= 0.75)}
        breadth.append(row)
    kinds = "peptide_id string, species_key string, n_uhgg_genomes_hq int, n_hq_genomes_in_uhgp int, hq_reference_representation_fraction double, " + ", ".join(f"breadth_hq_{t} double, carrier_broad_hq_{t} boolean" for t in TIERS)
    frame = spark.createDataFrame([tuple(r.values()) for r in breadth], kinds)
    samples = spark.createDataFrame([("1", "P", 1.0), ("2", "", None)], f"sample_name string, bioproject_id string, {co.LABELLED} double")
    zero = "panel_abundance double, panel_no_mapped_genomes_abundance double, panel_no_hq_genomes_abundance double, hq_species_abundance_before_membership_qc double, outside_panel_abundance double"
    qc = spark.createDataFrame([("1", 1.0, 0.0, 0.1, 0.9, 0.0), ("2", 1.0, 0.0, 1.0, 0.0, 0.0)], "sample_name string, " + zero)
    quality = co.sample_evaluability(shares, samples, qc, frame, check=True)
    got = {r.sample_name: r for r in co.sample_coverage(co.coverage_sums(shares, frame), quality, frame).where("tier = 'exact'").collect()}
    one, two = got["1"], got["2"]
    want = (0.75, 0.75 / 0.9, 0.6, 0.85, 0.85, 0.9)
    assert all(math.isclose(one[m], w) for m, w in zip(co.MEASURES, want))
    assert (two.breadth_weighted_coverage, two.equal_rate_extrapolated_coverage, two.missing_reference_lower, two.missing_reference_upper, two.unevaluated_species_upper) == (0, None, 0, 1, 1)


def test_quantile_and_project_medians(spark):
    frame = spark.createDataFrame([(v,) for v in (0.1, 0.2, 0.4, 0.9, None)], "x double")
    r = co.statistics(frame, ["x"]).first()
    assert math.isclose(r.p05, 0.115) and math.isclose(r["median"], 0.3)
    projects = spark.createDataFrame([("p", "exact", 0.3), ("p", "exact", 0.9), ("q", "exact", None)], "peptide_id string, tier string, median_coverage double")
    assert {r.peptide_id: round(r[2], 9) for r in co.median_of_project_medians(projects).collect()} == {"p": 0.6}


def test_summaries_equal_those_of_the_full_grid(spark):
    """Medians from the non-zeros against medians of every combination of peptide, sample and tier."""
    import numpy as np

    r = random.Random(12)
    samples = [(f"s{k}", r.choice(["", "P1", "P1", "P2", "P3"]), r.choice([0.0, r.random(), 0.5]), r.choice([0.0, 1.0, r.random(), 0.25])) for k in range(41)]
    peptides = [f"p{k}" for k in range(5)]
    lines = []
    for p in peptides[:4]:
        for t in TIERS:
            for name, _, _, _ in r.sample(samples, r.choice([0, 1, 5, 21, 41])):
                c = r.choice([0.0, 0.3, r.random()])
                lines.append((p, name, t, c, c * r.choice([0.0, 0.5, 1.0]), r.choice([0.0, c])))
    sums = spark.createDataFrame(lines, "peptide_id string, sample_name string, tier string, c double, low double, broad double").where("c > 0 or low > 0 or broad > 0")
    quality = spark.createDataFrame(samples, "sample_name string, bioproject_id string, evaluable_species_abundance double, unresolved_reference_weight double").withColumn("unevaluable_species_abundance", F.lit(0.0))
    asked = spark.createDataFrame([(p,) for p in peptides], "peptide_id string")
    found = co.summary_quantiles(sums, quality, asked).cache()
    grid = co.sample_coverage(sums, quality, asked).toPandas()
    middle = lambda v, q=0.5: float(np.quantile(v.dropna(), q)) if v.notna().any() else None
    same = lambda x, y: (x is None and y is None) or math.isclose(x, y, abs_tol=1e-9)
    tiers = {(x.peptide_id, x.tier): x for x in co.tier_medians(found).collect()}
    assert len(tiers) == 5 * len(TIERS)
    for key, own in grid.groupby(["peptide_id", "tier"]):
        x = tiers[key]
        assert same(x.median_coverage, middle(own.breadth_weighted_coverage)) and same(x.p05_coverage, middle(own.breadth_weighted_coverage, 0.05))
        assert same(x.median_equal_rate_extrapolated_coverage, middle(own.equal_rate_extrapolated_coverage))
        assert same(x.median_missing_reference_lower, middle(own.missing_reference_lower)) and same(x.median_missing_reference_upper, middle(own.missing_reference_upper))
        assert same(x.median_thresholded_coverage, middle(own.broad_hq_thresholded_coverage))
    projects = {(x.peptide_id, x.tier, x.bioproject_id): x for x in co.project_medians(found).collect()}
    groups = dict(list(grid[grid.bioproject_id != ""].groupby(["peptide_id", "tier", "bioproject_id"])))
    assert projects.keys() == groups.keys()
    for key, own in groups.items():
        x = projects[key]
        assert x.n_samples == len(own) and same(x.median_coverage, middle(own.breadth_weighted_coverage))
        assert same(x.median_missing_reference_lower, middle(own.missing_reference_lower)) and same(x.median_missing_reference_upper, middle(own.missing_reference_upper))


def test_equal_weights_are_one_product(spark):
    """Peptides and tiers of equal weights are summed and ranked once; each still has its rows."""
    import numpy as np

    r = random.Random(31)
    species = [f"g{k}" for k in range(7)]
    part = {p: [r.choice([0.0, 0.5, 1.0]) for _ in species] for p in "ab"}
    part |= {"c": part["a"], "d": [0.0] * len(species)}
    lines = [(p, s, 0.5, *[x for _ in TIERS for x in (w, w >= 0.75)]) for p, own in part.items() for s, w in zip(species, own)]
    kinds = "peptide_id string, species_key string, hq_reference_representation_fraction double, " + ", ".join(f"breadth_hq_{t} double, carrier_broad_hq_{t} boolean" for t in TIERS)
    breadth = spark.createDataFrame(lines, kinds)
    names = [f"s{k}" for k in range(1500)]  # more than one slice
    amount = {n: [r.choice([0.0, r.random()]) for _ in species] for n in names}
    shares = spark.createDataFrame([(n, s, a) for n, own in amount.items() for s, a in zip(species, own)], "sample_name string, species string, abundance double")
    quality = spark.createDataFrame([(n, r.choice(["", "P", "Q"]), r.choice([0.0, 0.8]), 0.25, 0.2) for n in names], "sample_name string, bioproject_id string, "
                                    "evaluable_species_abundance double, unresolved_reference_weight double, unevaluable_species_abundance double")
    members, kept = co.patterns(breadth)
    sums = co.pattern_sums(shares, quality, kept)
    assert kept.count() == 2 and members.count() == 4 * len(TIERS) and sums.count() == 3 * len(names)
    got = co.coverage_measures(sums, members).where("tier = 'cons_le2'").collect()
    assert len(got) == 4 * len(names)
    for x in got:
        want = float(np.dot(part[x.peptide_id], amount[x.sample_name]))
        assert math.isclose(x.breadth_weighted_coverage, want, abs_tol=1e-12) and math.isclose(x.missing_reference_lower, want / 2, abs_tol=1e-12)
    found = {(x.peptide_id, x.scope, x.measure, x.p): x.value for x in co.pattern_quantiles(sums, quality, members).where("tier = 'exact'").collect()}
    project = {q.sample_name: q.bioproject_id for q in quality.collect()}
    for p in part:
        for scope in ("", "P"):
            own = [x.breadth_weighted_coverage for x in got if x.peptide_id == p and (not scope or project[x.sample_name] == scope)]
            assert math.isclose(found[p, scope, "coverage", 0.5], float(np.median(own)), abs_tol=1e-12)


def test_members_of_a_pattern_are_laid_out_after_its_measures(spark):
    """Measures and their rounding belong to a pattern: its members, over one pack of them here, take them as they are."""
    sums = spark.createDataFrame([(k, f"s{j}", "P", 0.9, 0.25, 0.1, (j + k) / 7, j / 9, 0.5) for k in (0, 1) for j in range(4)], co.SUMS)
    members = spark.createDataFrame([(f"p{k}", t, int(k == 0)) for k in range(400) for t in TIERS], "peptide_id string, tier string, pattern long").coalesce(1)
    found = co.coverage_measures(sums, members, 3)
    assert "Generate inline" in found._jdf.queryExecution().executedPlan().toString()  # not a join that works them out for each member
    plain = sums.join(members, "pattern").select("peptide_id", "sample_name", "tier", F.round("c", 3).alias("c"), F.round("low", 3).alias("low"))
    assert rows(found.select("peptide_id", "sample_name", "tier", "breadth_weighted_coverage", "missing_reference_lower")) == rows(plain) and found.count() == 1600 * len(TIERS)


def test_one_split_of_metadata_is_dealt(spark):
    """A small file is one split, whose lineages and names one task would parse."""
    from peptrail.plans.study import Study

    host = spark.createDataFrame([(f"G{k}", "UHGG", f"d__Bacteria;g__X;s__X y{k % 9}") for k in range(400)], "genome_id string, data_source string, lineage_gtdb_r207_updated string").coalesce(1)
    genomes = host.select("genome_id", F.concat(F.lit("O"), "genome_id").alias("original_genome_id"), F.lit("R").alias("species_rep"), F.lit(95.0).alias("completeness"), F.lit(1.0).alias("contamination"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would join so few rows again
    try:
        study = Study(None, host, genomes, None, None, None, None)
        assert len(study.labels.inputFiles()) > 1 and len(study.genome_rows.inputFiles()) > 1
        assert rows(study.labels) == rows(ab.bacterial_labels(host)) and rows(study.aliases) == rows(la.alias_map(genomes))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_pairs_of_direct_lines_are_those_of_the_join(spark, monkeypatch):
    told = [
        "P1\tMGYG000000001_00001", "  P2 ,;P1\tGUT_GENOME000002_1;MGYG000000001.1_7 ", "", " \t ", None, "P\u00e9\u4e2d\tMGYG000000002_1", "P3", "xP1 P1x\tMGYG000000002_4",
        "\t".join(["P1", "P2"] * 40 + [f"MGYG{k:09d}_1" for k in range(1, 60)]), "MGYG000000002_9\tP4",
    ]
    lines = spark.createDataFrame([(x,) for x in told], "line string").coalesce(1)
    reps = spark.createDataFrame([(x,) for x in ("P1", "P2", "P3", "P\u00e9\u4e2d", "MGYG000000002_9", "lost", None)], "protein_rep_id string")
    genomes = spark.createDataFrame([(f"MGYG{k:09d}", f"GUT_GENOME{k:06d}") for k in range(1, 41)], "genome_id string, original_genome_id string")
    found = {}
    for fold in (16, 1, 0):
        monkeypatch.setattr(ca, "_FOLD", fold)
        named = ca.named_lines(lines, reps)
        found[fold] = sorted(tuple(r) for r in ca.rep_genome_pairs(named, reps, la.alias_map(genomes), genomes).collect()), named.where("direct").count()
    assert found[16][0] == found[1][0] == found[0][0] and len(found[0][0]) == 40 * 2 + 2
    assert found[16][1] == 6 > found[1][1] > found[0][1]


def test_shares_and_fractions_come_from_one_pass(spark):
    from peptrail.plans.study import Study

    abundance = spark.createDataFrame(
        [("a", "g1", 3.0), ("a", "g2", 1.0), ("a", "g2", 2.0), ("a", "none", 2.0), ("b", "none", 5.0), ("c", "g1", 0.0), ("c", "none", 1.0), ("d", "g1", None), ("d", "g2", 4.0), ("e", "g3", 1.0), (None, "g1", 1.0)],
        "sample_name string, genome string, relative_abundance double",
    ).selectExpr("sample_name", "'bulk' as sample_type", "'prok' as genome_type", "genome", "relative_abundance")
    host = spark.createDataFrame(
        [("g1", "UHGG", "d__Bacteria;s__X"), ("g2", "UHGG", "d__Bacteria;s__Y"), ("g3", "UHGG", "d__Bacteria;s__")], "genome_id string, data_source string, lineage_gtdb_r207_updated string"
    )
    samples = spark.createDataFrame([("a", "P"), ("d", "")], "sample_name string, bioproject_id string")
    study = Study(abundance, host, None, samples, None, None, None)
    old = ab.renormalised(ab.labelled(study.prokaryotes, study.labels))
    old_fractions = ab.labelled_fraction(study.prokaryotes, study.labels)
    old_included = ab.included_samples(old, ab.sample_projects(samples), old_fractions)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(study.shares) == rows(old) and study.shares.columns == old.columns
    study.prokaryotes = study.fractions = None  # the abundance is not read again
    assert rows(study.included) == rows(old_included) and study.included.columns == old_included.columns
    assert {r[0]: r[2] for r in rows(study.included)}["a"] == 0.75
