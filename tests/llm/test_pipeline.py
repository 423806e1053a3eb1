import random

import corpus_pipeline
from peptrail.llm import mixing, queries


def test_stages_keep_clean_documents_and_columns(spark, tmp_path):
    r = random.Random(1)
    words = lambda n: " ".join("".join(r.choice("bdgmn") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))
    rows, labels = [], []
    for i in range(200):
        bad = i % 4 == 0
        text = words(60) + (" vilestuff " + words(20)) * bad
        rows.append((i, text, "en", f"s{i % 3}", len(text), i))
        labels.append((i, 1, int(bad)))
    passage = words(70)
    for i, text in [(300, rows[1][1]), (301, words(50) + " " + passage), (302, words(50) + " " + passage), (303, None), (304, "")]:
        rows.append((i, text, "en", "s1", 0, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxicity_score int")
    docs = docs.drop("toxicity_score")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    held = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held, str(tmp_path)).write.parquet(str(tmp_path / name))
        held = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert held.columns == docs.columns
        seen.append({x.doc_id for x in held.collect()})
    clean = {i for i in range(200) if i % 4}
    assert clean <= seen[0] and not {i for i in range(0, 200, 4)} & seen[0]
    assert 300 in seen[0] and 300 not in seen[1] and clean <= seen[1] and ({303, 304} & seen[1]) == {303}
    assert seen[2] == seen[1] == seen[3] == seen[4]
    cut = {x.doc_id: x.text for x in spark.read.parquet(str(tmp_path / "substring_dedup")).collect()}
    assert passage in cut[301] and passage not in cut[302] and len(cut[302].split()) >= 49


def test_stages_give_few_files(spark, tmp_path):
    """Of documents in many files, with many shuffle partitions, as check_h has them."""
    rows = [(i, f"word{i} " * 20 + ("vile" if i % 4 == 0 else "fine"), "en", "s", 0) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(90)
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before, merged = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "80")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        most = max(2 * spark.sparkContext.defaultParallelism, 20)
        for name, stage in corpus_pipeline.STAGES:
            if name != "source_mixing":
                stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
                assert len(list((tmp_path / name).glob("*.parquet"))) <= most, name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 13)]


def test_stages_on_empty_tables_and_clashing_names(spark, tmp_path):
    names = "fp component id rep start end slot turn toxic mix_group mix_position drop_id cut_spans cut_mark seed label_id toxicity_score count w".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    text = "some words that are repeated here " * 12
    full = [(1, text, "en", "a", 1, *names), (2, text, "en", "a", 1, *names), (3, "other words", None, None, None, *names), (3, "other words", None, None, None, *names), (None, None, "en", "b", 0, *names)]
    for rows in ([], full):
        docs = spark.createDataFrame(rows, schema)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert k == 4 or out.columns == docs.columns
            got = out.collect()
            assert bool(got) == bool(rows)
            if rows and name in ("toxicity", "source_mixing", "bpe"):
                assert len(got) == len(rows)
    assert len(mixing.mix(spark.createDataFrame(full, schema)).columns) == 5 + len(names) + 2
