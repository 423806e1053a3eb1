"""The jobs over growing copies of small tables: what is new is taken once, and runs repeat safely."""

import logging
import os
import shutil
import statistics
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import rank_candidates, watch_catalogue
from jobs.inputs import CONFIGS, config_of, pattern, place, relation
from peptrail.checks import DataError
from peptrail.operators import search as se
from peptrail.plans import queries
from peptrail.plans.stages import Scratch, scratch, shared_folder, staged

DATA = "/root/testdata/sf0.001"
SCANNED = ["peptide_id", "protein_rep_id", "protein_start_1based", "matched_sequence", "n_substitutions", "substitutions"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture()
def catalogue(spark, tmp_path):
    """A folder with a copy of the documents to come, and of the peptides."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    parts = [docs.where(f"doc_id % 3 = {k}") for k in range(3)]
    shutil.copy(f"{DATA}/benchmark.parquet", tmp_path / "benchmark.parquet")
    (tmp_path / "documents.parquet").mkdir()

    def deliver(k):
        held = tmp_path / f"part{k}"
        parts[k].coalesce(1).write.parquet(str(held))
        for f in held.glob("*.parquet"):
            f.rename(tmp_path / "documents.parquet" / f"delivery{k}.parquet")

    return tmp_path, deliver


def scanned_at_once(spark, folder, config):
    proteins, peptides = relation(spark, config, "proteins", str(folder)), relation(spark, config, "peptides", str(folder))
    return se.hits(se.scan(proteins, peptides)), proteins


def test_watch_takes_what_is_new_once(spark, catalogue, caplog):
    folder, deliver = catalogue
    config, out, mark = config_of(CONFIGS / "watch_catalogue.json"), str(folder / "out"), str(folder / "mark")
    config["tables"]["documents"]["options"]["maxFilesPerTrigger"] = 1

    def run():
        with caplog.at_level(logging.INFO, "watch_catalogue"):
            return watch_catalogue.watch(spark, str(folder), out, mark, config)

    assert run() == 0  # nothing there yet
    deliver(0)
    first = run()
    hits, proteins = scanned_at_once(spark, folder, config)
    assert first == proteins.count() > 0
    before = rows(watch_catalogue.report(spark, out))
    assert run() == 0 and rows(watch_catalogue.report(spark, out)) == before
    deliver(1)
    deliver(2)
    second = run()
    hits, proteins = scanned_at_once(spark, folder, config)
    assert first + second == proteins.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    after = watch_catalogue.report(spark, out)
    assert rows(after.where("protein_rep_id is not null").select(*SCANNED)) == rows(hits.select(*SCANNED))
    held = after.collect()
    assert {r.peptide_id for r in held} == {f"pep{k}" for k in range(40)}
    for r in held:
        own = [h for h in held if h.peptide_id == r.peptide_id and h.protein_rep_id]
        assert (r.n_hits, r.n_proteins, r.n_exact) == (len(own), len({h.protein_rep_id for h in own}), sum(h.n_substitutions == 0 for h in own))
        assert r.proteins_searched == first + second
    counts = spark.read.parquet(f"{out}/counts")
    assert counts.count() == 3 and counts.agg({"hits": "sum"}).first()[0] == hits.count()
    assert sum("read" in m and "wrote" in m for m in caplog.messages) >= 3


def test_watch_repeats_a_batch_that_was_lost(spark, catalogue):
    folder, deliver = catalogue
    config, out, mark = config_of(CONFIGS / "watch_catalogue.json"), str(folder / "out"), folder / "mark"
    deliver(0)
    watch_catalogue.watch(spark, str(folder), out, str(mark), config)
    want = rows(watch_catalogue.report(spark, out))
    # the driver was lost after the batch's tables were written and before the batch was marked as done
    for f in (mark / "commits").glob("*0*"):
        f.unlink()
    shutil.rmtree(folder / "out" / "evidence")
    assert watch_catalogue.watch(spark, str(folder), out, str(mark), config) > 0
    assert rows(watch_catalogue.report(spark, out)) == want


def test_watch_refuses_other_peptides(spark, catalogue):
    folder, deliver = catalogue
    config, out, mark = config_of(CONFIGS / "watch_catalogue.json"), str(folder / "out"), str(folder / "mark")
    deliver(1)
    watch_catalogue.watch(spark, str(folder), out, mark, config)
    with pytest.raises(DataError, match="differ"):
        watch_catalogue.watch(spark, str(folder), out, mark, config | {"conservative_grantham_max": 60})
    fewer = config["relations"] | {"peptides": f"select * from ({config['relations']['peptides']}) where peptide_id <> 'pep7'"}
    with pytest.raises(DataError, match="differ"):
        watch_catalogue.watch(spark, str(folder), out, mark, config | {"relations": fewer})


def test_watch_command_line(catalogue):
    folder, deliver = catalogue
    deliver(2)
    root = Path(__file__).resolve().parents[1]
    env = os.environ | {"PYTHONPATH": str(root), "PYSPARK_SUBMIT_ARGS": "--master local[2] --driver-memory 2g --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false pyspark-shell"}
    command = [sys.executable, "-m", "jobs.watch_catalogue", "--tables", str(folder), "--out", str(folder / "out"), "--checkpoint", str(folder / "mark")]
    done = subprocess.run(command, cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "evidence of 40 peptides" in done.stderr and list((folder / "out" / "evidence").glob("as_of=0/*.parquet"))


def test_rank_by_hand_and_again(spark, tmp_path):
    config, out = config_of(CONFIGS / "rank_candidates.json") | {"places": 5, "tiers": ["exact", "cons_le3"]}, str(tmp_path / "out")
    for name in config["tables"]:
        shutil.copy(f"{DATA}/{name}.parquet", tmp_path / f"{name}.parquet")
    rank_candidates.rank(spark, str(tmp_path), out, config)
    first = rows(rank_candidates.report(spark, out))
    rank_candidates.rank(spark, str(tmp_path), out, config)
    assert rows(rank_candidates.report(spark, out)) == first and first
    assert {p.name for p in (tmp_path / "out" / "shortlist").glob("bioproject_id=*")} == {f"bioproject_id={r[0]}" for r in first}
    groups = {}
    for r in queries.study(spark, DATA).coverage.collect():
        if r.bioproject_id and r.tier in config["tiers"]:
            groups.setdefault((r.bioproject_id, r.tier), {}).setdefault(r.peptide_id, []).append(r)
    want = []
    for (project, tier), peptides in groups.items():
        middle = lambda own, name: round(statistics.median(getattr(r, name) for r in own), 8)
        known = [
            (-sum(round(r.missing_reference_lower, 8) >= 0.01 for r in own), -middle(own, "breadth_weighted_coverage"), -middle(own, "missing_reference_lower"), p)
            for p, own in peptides.items()
        ]
        want += [(project, tier, p, place, -n) for place, (n, _, _, p) in enumerate(sorted(known)[:5], 1)]
    got = rank_candidates.report(spark, out).select("bioproject_id", "tier", "peptide_id", "place", "n_samples_covered")
    assert rows(got) == sorted(want, key=repr)
    # a project that is gone leaves no partition behind
    gone = first[0][0]
    fewer = config["relations"] | {"samples": f"select * from ({config['relations']['samples']}) where bioproject_id <> '{gone}'"}
    rank_candidates.rank(spark, str(tmp_path), out, config | {"relations": fewer})
    assert gone not in {r.bioproject_id for r in rank_candidates.report(spark, out).collect()}


def test_rank_leaves_no_stage_tables(spark, tmp_path, monkeypatch):
    """A run's tables go with it, the large ones as soon as carriage is known; packed values are never a table."""
    held, most, names, drop = Path(shared_folder(spark).removeprefix("file:")), [], set(), Scratch.drop

    def seen(self, *but):
        names.update(name for name, _ in self.made)
        drop(self, *but)
        most.append({name for name, _ in self.made})

    monkeypatch.setattr(Scratch, "drop", seen)
    before = {p.name for p in held.iterdir()}
    rank_candidates.rank(spark, DATA, str(tmp_path / "out"), config_of(CONFIGS / "rank_candidates.json"))
    assert {p.name for p in held.iterdir()} == before and most == [{"shares", "breadth", "quality"}, set()]
    assert "named_lines" in names and "packed" not in names
    with pytest.raises(ValueError), scratch(spark) as made:
        staged(spark.range(3), "lost")
        assert [p.name for p in held.iterdir() if p.name.startswith("lost-")] and made.made
        raise ValueError
    assert {p.name for p in held.iterdir()} == before


def test_configs_are_checked(spark, tmp_path):
    config = config_of(CONFIGS / "rank_candidates.json")
    with pytest.raises(DataError, match="tiers"):
        rank_candidates.rank(spark, DATA, str(tmp_path), config | {"tiers": ["all"]})
    with pytest.raises(DataError, match="no relation"):
        relation(spark, {"relations": {}}, "proteins", DATA)
    with pytest.raises(DataError, match="not among"):
        relation(spark, {"relations": {"a": "select 1 from {b}"}, "tables": {}}, "a", DATA)
    assert (place("/a/", "b"), place("/a", "/b"), place("x", "s3a://b/c")) == ("/a/b", "/b", "s3a://b/c")
    assert (pattern("/a/b"), pattern("/a/b*"), pattern("viewfs://x/in/b.parquet/")) == ("/a/{b}", "/a/b*", "viewfs://x/in/{b.parquet}")
