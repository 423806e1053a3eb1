import gzip
import zipfile

import pytest

from peptrail.checks import DataError
from peptrail.settings import Settings
from peptrail.sources import fasta, tables


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_fasta_records(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">p1 x\nac de\n\nFG*\n>p2\nA*C**\n>p3\n")
    assert sorted(rows(fasta.read_fasta(spark, str(tmp_path / "a.fa")))) == [("p1", "ACDEFG"), ("p2", "A*C"), ("p3", "")]
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">q\r\nAC*\r\n>r\nDD")
    assert sorted(rows(fasta.read_fasta(spark, str(tmp_path / "b.fa.gz"), protein=False, partitions=2))) == [("q", "AC*"), ("r", "DD")]


def test_fasta_is_split_safe(spark, tmp_path):
    text = "".join(f">s{i} about\n{'ACDEFGHIKL' * (i % 7 + 1)}\n" for i in range(3000))
    (tmp_path / "a.fa").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = fasta.read_fasta(spark, str(tmp_path / "a.fa"))
        assert got.rdd.getNumPartitions() > 5
        assert {(i, len(s)) for i, s in rows(got)} == {(f"s{i}", 10 * (i % 7 + 1)) for i in range(3000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_indented_headers_and_prefaces(spark, tmp_path):
    (tmp_path / "a.fa").write_text("\n  >p1\nAC\n \t>p2 x\n D E\n\n>p3\n>p4\nF")
    assert sorted(rows(fasta.read_fasta(spark, str(tmp_path / "a.fa")))) == [("p1", "AC"), ("p2", "DE"), ("p3", ""), ("p4", "F")]
    (tmp_path / "b.fa").write_text("ACDE\n>p1\nAC\n")
    with pytest.raises(DataError, match="before its first header"):
        fasta.read_fasta(spark, str(tmp_path / "*.fa"))
    with gzip.open(tmp_path / "c.fa.gz", "wt") as f:
        f.write("\n" * 9000 + "x")
    with pytest.raises(DataError, match="before its first header"):
        fasta.read_fasta(spark, str(tmp_path / "c.fa.gz"))


def test_header_without_id_is_an_error(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">p1\nAC\n>\nDE\n")
    with pytest.raises(Exception, match="no id"):
        fasta.read_fasta(spark, str(tmp_path / "a.fa")).collect()


@pytest.mark.parametrize(
    "text, problem",
    [(">q\nACDEFGHIKLM*\n", "residues"), (">q\nACD\n", "length"), (">q\nACDEFGHIKLMN\n>q\nACDEFGHIKLMN\n", "more than once"), ("", "no candidate")],
)
def test_bad_candidates(spark, tmp_path, text, problem):
    (tmp_path / "a.fa").write_text(text)
    with pytest.raises(DataError, match=problem):
        fasta.read_peptides(spark, str(tmp_path / "a.fa"))


def test_host_from_table_and_zip(spark, tmp_path):
    text = "genome_id\tother\tdata_source\tlineage_gtdb_r207_updated\n1\tx\tUHGG\td__Bacteria;s__A b\n2\ty\tNA\t\n"
    (tmp_path / "h.tsv").write_text(text)
    with zipfile.ZipFile(tmp_path / "h.zip", "w") as z:
        z.writestr("h.tsv", text)
        z.writestr("__MACOSX/h.tsv", "junk")
    want = [("1", "UHGG", "d__Bacteria;s__A b"), ("2", None, None)]
    for name in ("h.tsv", "h.zip"):
        got = tables.read_host(spark, str(tmp_path / name)).select("genome_id", "data_source", "lineage_gtdb_r207_updated")
        assert sorted(rows(got)) == want
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:  # a cell with a tab in quotes, a row equal to the header, a short row, an empty line
        z.writestr("h.tsv", 'genome_id\tnote\tdata_source\tlineage_gtdb_r207_updated\n1\t"a\tb ""c"""\tUHGG\tx\ngenome_id\tnote\tdata_source\tlineage_gtdb_r207_updated\n\n3\n')
    got = tables.read_host(spark, str(tmp_path / "q.zip"))
    assert sorted(rows(got), key=str) == [("1", "UHGG", "x"), ("3", None, None), ("genome_id", "data_source", "lineage_gtdb_r207_updated")]
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a.tsv", text)
        z.writestr("b.tsv", text)
    with pytest.raises(DataError, match="one .tsv"):
        tables.read_host(spark, str(tmp_path / "two.zip"))
    (tmp_path / "bad.tsv").write_text("genome_id\n1\n")
    with pytest.raises(DataError, match="lacks"):
        tables.read_host(spark, str(tmp_path / "bad.tsv"))


def test_abundance_types_and_missing(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("sample_name\tsample_type\tgenome_type\tgenome\trelative_abundance\n007\tbulk\tprok\tg\t0.5\n8\tbulk\tprok\tg\tNaN\n9\tbulk\tprok\tg\tx\n")
    assert sorted((r[0], r[4]) for r in rows(tables.read_abundance(spark, str(tmp_path / "a.tsv")))) == [("007", 0.5), ("8", None), ("9", None)]


def test_metadata_columns_are_found(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("Genome\tSpecies_rep\tCompleteness\tContamination\tOriginal_name\n g1 \tr\t90\t\tGUT_GENOME000001\ng2\t\tx\t1\t\n")
    got, found = tables.read_metadata(spark, str(tmp_path / "m.tsv"))
    assert found["original_genome_id"] == "Original_name"
    assert sorted(rows(got)) == [("g1", "r", 90.0, None, "GUT_GENOME000001"), ("g2", "nan", None, 1.0, "nan")]
    best = lambda columns, field: next((c.column for c in tables.claims(columns, *tables.METADATA_COLUMNS[field])), None)
    assert best(["a_species_rep", "b species rep"], "species_rep") is None and best(["my species rep"], "species_rep") == "my species rep"
    assert best(["x", "MGYG accession", "Genome"], "genome_id") == "Genome" and best(["Original.ID", "original  name"], "original_genome_id") == "original  name"
    assert best(["Genome", "genome"], "genome_id") == "genome" and best(["original a name", "original b name"], "original_genome_id") is None


def test_settings_ranges():
    for bad in ({"min_peptide_length": 5}, {"broad_breadth": 0}, {"conservative_grantham_max": 216}, {"excel_max_rows": 2_000_000}, {"min_completeness": 101}):
        with pytest.raises(ValueError):
            Settings(**bad)
