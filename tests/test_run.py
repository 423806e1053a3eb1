import json
import os
import zipfile
from dataclasses import replace

import duckdb
import pytest

from peptrail.checks import DataError
from peptrail.operators import carriage
from peptrail.plans import queries
from peptrail.plans.fixtures import Fixtures
from peptrail.plans.run import Inputs, Run
from peptrail.settings import TIERS
from peptrail.sinks import export, manifests, workbook
from peptrail.sinks.folders import Folder

DATA = "/root/testdata/sf0.001"


def write(path, header, rows):
    path.write_text("\n".join(["\t".join(header), *("\t".join("" if v is None else str(v) for v in r) for r in rows)]) + "\n")


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d, f = tmp_path_factory.mktemp("inputs"), Fixtures(spark, DATA)
    write(d / "abundance.tsv", f.abundance.columns, f.abundance.collect())
    write(d / "samples.tsv", f.samples.columns, f.samples.collect())
    write(d / "host.tsv", f.host.columns, f.host.collect())
    write(d / "metadata.tsv", ["Genome", "Original_name", "Species_rep", "Completeness", "Contamination"], f.genomes.select("genome_id", "original_genome_id", "species_rep", "completeness", "contamination").collect())
    (d / "proteins.faa").write_text("".join(f">{r[0]} x\n{r[1]}*\n" for r in f.proteins.collect()))
    (d / "peptides.faa").write_text("".join(f">{r[0]}\n{r[1]}\n" for r in f.peptides.limit(8).collect()))
    (d / "membership.tsv").write_text("".join(f"{r.line}\n" for r in f.membership.select("line").collect()))
    return d


def run_of(spark, d, out, reuse=False):
    return Run(spark, Inputs(str(d / "peptides.faa"), str(d / "abundance.tsv"), str(d / "samples.tsv"), str(d / "host.tsv"), str(d / "metadata.tsv"), str(d / "proteins.faa"), str(d / "membership.tsv")), str(out), reuse=reuse)


def test_whole_run(spark, files, tmp_path, monkeypatch):
    run = run_of(spark, files, f"file://{tmp_path}")
    run.all()
    want = queries.queries()["species_panel"](spark, DATA)
    got = queries.rounded(run.table("all_species_abundance")).select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    cover = run.table("peptide_sample_coverage")
    assert cover.count() == 8 * len(TIERS) * run.table("included_samples").count()
    bad = cover.where("missing_reference_lower > breadth_weighted_coverage + 1e-9 or breadth_weighted_coverage > unevaluated_species_upper + 1e-9 or unevaluated_species_upper > missing_reference_upper + 1e-9")
    assert bad.isEmpty()
    notes = json.loads((tmp_path / "run_diagnostics.json").read_text())
    assert notes["hit_mapping"]["missing_hit_representatives_n"] == 0
    exported = {p.name for p in (tmp_path / "exports").iterdir()}
    assert {"selected_species_abundance_matrix", "peptide_species_breadth", "peptide_sample_coverage", "preparation_sample_qc", "concise_summary"} <= exported
    matrix = run.table("selected_species_abundance_matrix")
    assert matrix.count() == run.table("included_samples").count() and len(matrix.columns) == 1 + run.table("selected_species").count()
    with zipfile.ZipFile(tmp_path / "summary.xlsx") as book:
        assert len([n for n in book.namelist() if "worksheets/" in n]) == 12
    # reuse leaves a finished scan and mapping alone; a changed table ends the summary
    again = run_of(spark, files, tmp_path, reuse=True)
    passes, read = [], carriage.named_lines
    monkeypatch.setattr(carriage, "named_lines", lambda *a: passes.append(1) or read(*a))
    held = {n: (tmp_path / f"{n}.json").read_text() for n in ("scan", "mapping")}
    Run(spark, again.inputs, str(tmp_path), replace(again.settings, broad_breadth=0.5), reuse=True).search()
    again.search()
    assert {n: (tmp_path / f"{n}.json").read_text() for n in held} == held and not passes
    with pytest.raises(DataError, match="broad_breadth"):
        again.summarize({"broad_breadth": 0.5})
    what_is_done_again(spark, run, tmp_path)
    (next((tmp_path / "peptide_species_breadth").glob("part-*"))).unlink()
    with pytest.raises(DataError, match="run search again"):
        again.summarize()


CASES = {
    "nothing": ({}, set()),
    "broad_breadth": ({"settings": {"broad_breadth": 0.5}}, set()),
    "min_hq_genomes_for_broad": ({"settings": {"min_hq_genomes_for_broad": 2}}, set()),
    "excel_max_rows": ({"settings": {"excel_max_rows": 50}}, set()),
    "conservative_grantham_max": ({"settings": {"conservative_grantham_max": 60}}, {"scan"}),
    "target_community_coverage": ({"settings": {"target_community_coverage": 0.5}}, {"prepare"}),
    "min_completeness": ({"settings": {"min_completeness": 80.0}}, {"prepare"}),
    "cluster_mapping_min_purity": ({"settings": {"cluster_mapping_min_purity": 0.5}}, {"prepare"}),
    "peptides": ({"input": "peptides"}, {"prepare", "scan"}),
    "relative_abundance": ({"input": "relative_abundance"}, {"prepare"}),
    "host_genomes_info": ({"input": "host_genomes_info"}, {"prepare"}),
    "uhgp_membership": ({"input": "uhgp_membership"}, {"inventory"}),
    "uhgp_faa": ({"input": "uhgp_faa"}, {"scan"}),
    "uhgg_metadata": ({"input": "uhgg_metadata"}, {"prepare", "inventory"}),
}


def what_is_done_again(spark, run, tmp_path):
    """Reuse takes over the stages that a change doesn't touch, and only those."""
    for name, (change, again) in CASES.items():
        settings, inputs = replace(run.settings, **change.get("settings", {})), run.inputs
        if field := change.get("input"):
            held = tmp_path / f"{field}.other"
            text = open(getattr(inputs, field)).read()
            held.write_text(text.split("\n>", 7)[0] + "\n" if field == "peptides" else text + (">more\nACDEFGHIKLMN\n" if field == "uhgp_faa" else text.split("\n")[-2].replace("1", "7") + "\n"))
            inputs = replace(inputs, **{field: str(held)})
        standing = Run(spark, inputs, str(tmp_path), settings, reuse=True).standing()
        assert {s for s, there in standing.items() if not there} == again, name


def test_samples_must_agree(spark, files, tmp_path):
    run = run_of(spark, files, tmp_path)
    run.prepare()
    run._check_samples()
    samples = run.table("included_samples").collect()
    spark.createDataFrame(samples[1:], run.table("included_samples").schema).write.mode("overwrite").parquet(str(tmp_path / "included_samples"))
    with pytest.raises(DataError, match="differ"):
        run._check_samples()
    spark.createDataFrame(samples + samples[:1], run.table("included_samples").schema).write.mode("overwrite").parquet(str(tmp_path / "included_samples"))
    with pytest.raises(DataError, match="more than once"):
        run._check_samples()


def test_changed_peptides_are_noticed(spark, files, tmp_path):
    run = run_of(spark, files, tmp_path / "o")
    run.prepare()
    (tmp_path / "other.faa").write_text(">z\nACDEFGHIKLMN\n")
    other = Run(spark, Inputs(**(run.inputs.__dict__ | {"peptides": str(tmp_path / "other.faa")})), str(tmp_path / "o"))
    with pytest.raises(DataError, match="differ"):
        other.search()


def test_receipts(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}/run")
    spark.range(5).write.parquet(folder.uri("t"))
    manifests.give(folder, "s", {"k": 1}, ["t"])
    assert manifests.stands(folder, "s", {"k": 1}) and not manifests.stands(folder, "s", {"k": 2})
    assert manifests.needed_by(folder, "s") == {"k": 1}
    spark.range(6).write.mode("overwrite").parquet(folder.uri("t"))
    assert not manifests.stands(folder, "s", {"k": 1})
    with pytest.raises(DataError, match="run s again"):
        manifests.needed_by(folder, "s")
    manifests.tear(folder, "s")
    with pytest.raises(DataError, match="run s first"):
        manifests.needed_by(folder, "s")
    folder.write_json("old.json", {"schema": 1})
    with pytest.raises(DataError, match="another release"):
        manifests.needed_by(folder, "old")


@pytest.mark.parametrize("whole", [True, False])
def test_identity_of_inputs(spark, tmp_path, whole):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\n" * 400_000)
    (tmp_path / "in" / "b.txt").write_text("")
    held = manifests.identity(spark, f"file://{tmp_path}/in", whole)
    assert len(held["files"]) == 2 and held == manifests.identity(spark, f"{tmp_path}/in/*.txt", whole)
    before = os.stat(tmp_path / "in" / "a.txt")
    (tmp_path / "in" / "a.txt").write_text("x\n" * 399_999 + "y\n")
    os.utime(tmp_path / "in" / "a.txt", ns=(before.st_atime_ns, before.st_mtime_ns))
    assert manifests.identity(spark, f"{tmp_path}/in", whole) != held  # the same size and time
    with pytest.raises(DataError, match="no input"):
        manifests.identity(spark, f"{tmp_path}/none", whole)


def test_exports(spark, tmp_path):
    assert export.listed({"a": {"b": 1, "c": [1, 2], "e": {}}, "d": None}) == [("a.b", "1"), ("a.c", "[1, 2]"), ("d", None)]
    frame = spark.range(7)
    export.write_tsv(frame.selectExpr("id", "cast(null as string) as n"), str(tmp_path / "t"), one_file=True, gzip=False)
    assert next((tmp_path / "t").glob("part-*")).read_text().splitlines()[:2] == ["id\tn", "0\t"]


def cells(book, number):
    from xml.etree import ElementTree

    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    out = []
    for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{number}.xml")).iter(f"{ns}row"):
        out.append([(c.get("r"), "".join(t.text or "" for t in c.iter() if t.tag in (f"{ns}v", f"{ns}t"))) for c in row])
    return out


def test_workbook(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    mixed = spark.createDataFrame([("=1+1 <&>\x07", 0.25, None, True), ("y" * 40_000, float("nan"), 3, False)], "name string, mean_coverage double, n int, ok boolean")
    facts = export.write_workbook(folder, "s.xlsx", {"Small": (mixed, "exports/small"), "Big": (spark.range(9), "exports/big")}, 5)
    assert facts == folder.read_json("excel_export_qc.json") == {"workbook": "s.xlsx", "max_data_rows_per_sheet": 5, "omitted_tables": [{"sheet": "Big", "rows": 9, "complete_folder": "exports/big"}]}
    with zipfile.ZipFile(tmp_path / "s.xlsx") as book:
        assert book.testzip() is None
        assert len(cells(book, 1)) == 1 + len(export.NOTES)
        small = cells(book, 2)
        assert small[1] == [("A2", "=1+1 <&>"), ("B2", "0.25"), ("D2", "1")]
        assert len(small[2][0][1]) == 32_760 and [c[0] for c in small[2]] == ["A3", "C3", "D3"]
        assert [c[1] for c in cells(book, 3)[1]] == ["left out for its size", "9", "exports/big"]
    assert [workbook.column_letters(n) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_omitted_rows_are_counted_whole(spark):
    frame = spark.range(7)
    assert export.omitted_rows({"big": frame, "small": frame.limit(2)}, 5) == {"big": 7}
    s = queries.study(spark, DATA)
    want = {"Selected species QC": s.species.count(), "Species breadth": s.breadth.count(), "Broad carrier QC": s.thresholds.count()}
    got = {r.sheet: r.rows_counted for r in queries.queries()["excel_omissions"](spark, DATA).collect()}
    assert got == {name: n for name, n in want.items() if n > 100} and max(got.values()) > 101


def test_every_benchmark_row_is_a_peptide(spark, tmp_path):
    rows = [(i, "Some letters of a passage that is long enough " * 3) for i in (0, 39, 40, 199)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r.peptide_id for r in Fixtures(spark, str(tmp_path)).peptides.collect()} == {"pep0", "pep39", "pep40", "pep199"}


QUICK = ["species_panel", "genome_labels", "rep_genome_pairs", "species_breadth", "sample_evaluability", "hit_classification", "substitution_strings", "flattened_diagnostics", "excel_omissions", "search_counts", "abundance_matrix",
         "abundance_file", "sample_file", "host_file", "metadata_file", "membership_file", "fasta_file"]


@pytest.mark.parametrize("name", QUICK)
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    got = queries.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r)
    assert sorted(map(key, want)) == sorted(key(tuple(r)) for r in got.select(*columns).collect())


def test_tiers_are_nested(spark):
    hits = queries.study(spark, DATA).hits
    assert hits.where("exact > cons_le1 or cons_le1 > cons_le2 or cons_le2 > cons_le3 or cons_le1 > unrestricted_le1 or unrestricted_le1 > unrestricted_le2 or cons_le2 > unrestricted_le2").isEmpty()


def test_stream_finds_what_a_batch_finds(spark, files, tmp_path):
    from peptrail.operators.search import scan
    from peptrail.sources.fasta import read_fasta, read_peptides
    from peptrail.streaming.scan import protein_stream, stream_hits

    (tmp_path / "in").mkdir()
    text = (files / "proteins.faa").read_text()
    (tmp_path / "in" / "a.faa").write_text(text)
    peptides = read_peptides(spark, str(files / "peptides.faa"))
    stream_hits(protein_stream(spark, str(tmp_path / "in")), peptides, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    want = scan(read_fasta(spark, str(files / "proteins.faa")).withColumnRenamed("id", "protein_rep_id"), peptides)
    got = spark.read.schema(want.schema).parquet(str(tmp_path / "out"))
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_command_line():
    from peptrail.cli import parser

    args = parser().parse_args(["summarize", "--peptides", "p", "--broad-breadth", "0.5"])
    assert (args.command, args.broad_breadth, args.conservative_grantham_max, args.excel_max_rows) == ("summarize", 0.5, None, 200_000)
    with pytest.raises(SystemExit):
        parser().parse_args(["search", "--peptides", "p"])
