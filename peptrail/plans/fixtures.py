"""The engine's inputs as views of the star-schema test tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: view SQL that both engines take, but for the fourth argument of regexp_replace in DuckDB (marked by GLOBAL)
VIEWS = {
    "fx_abundance": """
select concat('S', l_suppkey) as sample_name, case when l_returnflag = 'R' then 'virome' else 'bulk' end as sample_type,
  case when l_linestatus = 'F' then 'prok' else 'viral' end as genome_type,
  concat('MGYG', lpad(cast(l_partkey as string), 9, '0'), case when l_partkey % 5 = 0 then '.1' else '' end) as genome,
  l_quantity as relative_abundance from lineitem""",
    "fx_host": """
select concat('MGYG', lpad(cast(p_partkey as string), 9, '0'), case when p_partkey % 5 = 0 then '.1' else '' end) as genome_id,
  case when p_partkey % 11 = 0 then 'OTHER' else 'UHGG' end as data_source,
  concat('d__', case when p_size % 10 = 0 then 'Archaea' else 'Bacteria' end, ';p__P', p_size % 6, ';g__', p_type, ';s__',
    case when p_size % 7 = 0 then '' else concat(p_brand, ' ', p_type) end) as lineage_gtdb_r207_updated
from part where p_partkey % 4 <> 3""",
    "fx_uhgg": """
select concat('MGYG', lpad(cast(p_partkey as string), 9, '0')) as genome_id, concat('GUT_GENOME', lpad(cast(p_partkey as string), 6, '0')) as original_genome_id,
  concat('REP_', case when p_partkey % 37 = 0 then 'MIX' else concat(p_brand, '_', p_type) end) as species_rep,
  70e0 + p_size * 6e-1 as completeness, cast(p_partkey % 8 as double) as contamination from part""",
    "fx_samples": """
select concat('S', s_suppkey) as sample_name, case when s_suppkey % 9 = 0 then '' else concat('PRJ', s_nationkey) end as bioproject_id from supplier""",
    "fx_proteins": """
select concat('P', doc_id) as protein_rep_id, case when doc_id % 10 = 0
  then translate(upper(regexp_replace(text, '[^A-Za-z]', ''GLOBAL)), 'BJOUZ', 'DLKCE')
  else translate(upper(regexp_replace(text, '[^A-Za-z]', ''GLOBAL)), 'BJOUXZ', 'DLKCAE') end as sequence from documents""",
    "fx_peptides": """
select concat('pep', item_id) as peptide_id, case when item_id % 3 = 1
    then concat(substr(q, 1, 4), translate(substr(q, 5, 1), 'ILKRFYDEMV', 'LIRKYFEDVM'), substr(q, 6))
    when item_id % 3 = 2 then concat(substr(q, 1, 6), 'W', substr(q, 8)) else q end as sequence, 12 + item_id % 14 as length
from (select item_id, substr(translate(upper(regexp_replace(text, '[^A-Za-z]', ''GLOBAL)), 'BJOUXZ', 'DLKCAE'), 11, cast(12 + item_id % 14 as int)) as q
  from benchmark) t""",
    "fx_membership": """
select concat('P', l_orderkey % (select count(*) from documents)) as rep,
  concat('P', l_orderkey % (select count(*) from documents), chr(9), case when l_linenumber % 2 = 0
    then concat('MGYG', lpad(cast(l_partkey as string), 9, '0')) else concat('GUT_GENOME', lpad(cast(l_partkey as string), 6, '0')) end,
    '_', lpad(cast(l_linenumber as string), 5, '0')) as line from lineitem where l_partkey % 13 <> 0""",
}
TABLES = ("lineitem", "part", "supplier", "documents", "benchmark")


def duckdb_views() -> dict[str, str]:
    return {k: v.replace("GLOBAL", ", 'g'").strip() for k, v in VIEWS.items()}


@dataclass
class Fixtures:
    """Views over the tables of one folder."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text, tables = VIEWS[name].replace("GLOBAL", ""), {}
        for table in TABLES:
            if f"from {table}" in text:
                text = text.replace(f"from {table}", "from {" + table + "}")
                tables[table] = self.table(table)
        return self.spark.sql(text, **tables)

    @cached_property
    def abundance(self) -> DataFrame:
        return self.view("fx_abundance")

    @cached_property
    def host(self) -> DataFrame:
        return self.view("fx_host")

    @cached_property
    def genomes(self) -> DataFrame:
        return self.view("fx_uhgg")

    @cached_property
    def samples(self) -> DataFrame:
        return self.view("fx_samples")

    @cached_property
    def proteins(self) -> DataFrame:
        return self.view("fx_proteins")

    @cached_property
    def peptides(self) -> DataFrame:
        return self.view("fx_peptides")

    @cached_property
    def membership(self) -> DataFrame:
        return self.view("fx_membership")
