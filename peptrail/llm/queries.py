"""The ``opN_<name>`` queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.llm import bpe, fill_middle, gif_media, html_extract, license_scan, mixing, packing, simhash, substring, token_store, topk, toxicity


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.with_scores(docs, model, "score")
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mixing.mix(docs)


def op4_bit_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    back = token_store.token_store(docs, tokenizer_file())
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op6_license_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_dual_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = topk.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(data.where("id % 50 = 0"), data, k=5)


def op8_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumnsRenamed({"start": "start_word", "end": "end_word", "other_start": "other_start_word", "other_end": "other_end_word"})


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_bpe_speculative(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.digests(bpe.encode_decode(docs, tokenizer_file()))


def op11_streaming_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_swap_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file())
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_subword_toxicity, op2_html_blocks, op3_pfair_mixing, op4_bit_plane_tokens, op5_simhash_multi_index,
        op6_license_minhash, op7_dual_tree_topk, op8_collinear_passages, op9_gif_media, op10_bpe_speculative,
        op11_streaming_fill_middle, op12_swap_best_fit,
    )}


OP7_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, d.vec_id as vec_id,
         cast(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v d on q.vec_id <> d.vec_id and len(q.e) = len(d.e) where q.vec_id % 50 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""


OP11_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), u as (
  select *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as units, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
    cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from d
), r as (
  select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as high from u
), c as (
  select doc_id, text, n, array_to_string(units[1:low], '') as p, array_to_string(units[low + 1:high], '') as m, array_to_string(units[high + 1:], '') as s,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain'
      when h4 % 100 < 50 then 'spm' else 'psm' end as form from r
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from c
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_dual_tree_topk": OP7_SQL, "op11_streaming_fill_middle": OP11_SQL}
