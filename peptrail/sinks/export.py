"""Exports: tab-separated text, and a workbook of the smaller tables."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.settings import EXCEL_ROWS
from peptrail.sinks.folders import Folder
from peptrail.sinks.workbook import Sheet, write_sheets

#: what the first sheet of a workbook says about the others
NOTES = (
    ("Extrapolated coverage", "Supported share of a sample divided by the abundance of its species that could be evaluated, before any median. It holds if species that could not be evaluated match at the same rate, and is empty where none could."),
    ("Supported coverage", "Share of all labelled bacterial abundance with a match in evaluated genomes. Evaluable and unevaluable abundance are medians of their own and do not add up with it."),
    ("Panel", "Species that together reach the target share of mean abundance, picked before any check of genome quality. A single sample may lie above or below the target."),
    ("Lower and upper values", "Coverage if whatever has no reference matched never, or always. They are extremes and no confidence limits."),
    ("Reference weight", "Abundance times the share of a species' good genomes that the protein catalogue represents."),
    ("Broad carriers", "Species in which at least the set share of enough represented good genomes carries the peptide."),
    ("Tiers", "A substitution is conservative up to the set Grantham distance. Tiers describe sequences and no binding."),
    ("Carriage", "A match lies in a cluster's representative protein; its genomes follow from membership of the cluster."),
    ("Large tables", "A table over the row limit is left out whole; its sheet names the folder that holds every row."),
)


def write_tsv(df: DataFrame, path: str, one_file: bool = False, gzip: bool = True) -> None:
    """Tab-separated files with a header, written in parallel; a folder that exists is replaced at commit."""
    rows = df.coalesce(1) if one_file else df
    rows.write.mode("overwrite").options(sep="\t", header=True, compression="gzip" if gzip else "none", emptyValue="").csv(path)


def leaves(facts: Mapping) -> Iterator[tuple[tuple[str, ...], object]]:
    """Paths and values of all that is no mapping in nested mappings, in their order; an empty mapping has none."""
    waiting = [((), facts)]
    while waiting:
        path, item = waiting.pop()
        if isinstance(item, Mapping):
            waiting += [((*path, str(k)), v) for k, v in reversed(item.items())]
        else:
            yield path, item


def listed(facts: Mapping) -> list[tuple[str, str | None]]:
    """Dotted names and values as text for a two-column table: lists as JSON, nothing as null."""
    text = lambda v: None if v is None else json.dumps(v, default=str) if isinstance(v, list | tuple) else str(v)
    return [(".".join(path), text(value)) for path, value in leaves(facts)]


def table_sizes(tables: Mapping[str, DataFrame]) -> dict[str, int]:
    """Rows of all tables, counted in one job."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return {r.name: r.n for r in reduce(DataFrame.unionAll, counts).collect()} if counts else {}


def omitted_rows(tables: Mapping[str, DataFrame], most: int) -> dict[str, int]:
    """Tables that a workbook would not hold, and all their rows."""
    return {name: n for name, n in table_sizes(tables).items() if n > min(most, EXCEL_ROWS)}


def write_workbook(folder: Folder, name: str, tables: Mapping[str, tuple[DataFrame, str]], most: int) -> dict:
    """A workbook with a sheet of notes and a sheet for each table; tables come with the folder of their full export.

    A table of over ``most`` rows gets one row that names its rows and that folder instead. Beside the
    workbook ``excel_export_qc.json`` lists what was left out; its content is returned.
    """
    left_out = omitted_rows({k: df for k, (df, _) in tables.items()}, most)
    facts = {"workbook": name, "max_data_rows_per_sheet": most, "omitted_tables": [{"sheet": k, "rows": n, "complete_folder": tables[k][1]} for k, n in left_out.items()]}
    sheets = [Sheet("README", ["item", "explanation"], NOTES)]
    for title, (df, export) in tables.items():
        if title in left_out:
            sheets.append(Sheet(title, ["status", "rows", "complete_folder"], [("left out for its size", left_out[title], export)]))
        else:
            sheets.append(Sheet(title, df.columns, (tuple(r) for r in df.toLocalIterator())))
    write_sheets(folder, name, sheets)
    folder.write_json("excel_export_qc.json", facts)
    return facts
