"""Fill-in-the-middle transformation by a streaming matcher of two passes.

The first pass counts a text's units with a lazy match iterator; the second advances a new iterator to the
two ranks and takes where those units end. Besides the text and its output only two numbers are held, however
many units there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peptrail.llm.shared import text_groups

#: a line with its line feed, or what follows the last one
LINE = r"[^\n]*\n|[^\n]+"
#: marks of prefix, suffix and middle
MARKS = ("<P>", "<S>", "<M>")


def checked_marks(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks that can be told apart in any output of texts without them: no end of one begins another or itself."""
    if len(set(marks)) < 3 or not all(marks):
        raise ValueError("three different marks are needed")
    for a in marks:
        for b in marks:
            if (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"the marks {a} and {b} overlap")
    return marks


def count_units(unit: re.Pattern, text: str) -> int:
    return sum(1 for _ in unit.finditer(text))


def ends_at(unit: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Where the first ``low`` and the first ``high`` units of a text end (0 for none of them)."""
    found = unit.finditer(text)
    first = next(islice(found, low - 1, None)).end() if low else 0
    return first, next(islice(found, high - low - 1, None)).end() if high > low else first


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits for each id: the first digits of SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_middle(
    docs: DataFrame, unit: str = LINE, marks: tuple[str, str, str] = MARKS, seed: int = 7, percent: int = 100, spm_percent: int = 50,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``id_column, n, form, prefix_chars, middle_chars, output`` of every row of ``docs``.

    ``n`` counts the matches of ``unit``, which may not match nothing. A text is cut where two drawn ranks end
    and put together as psm (mark, prefix, mark, suffix, mark, middle) or spm (suffix, prefix, middle);
    ``percent`` of the texts are transformed, ``spm_percent`` of those to spm. A text is plain, its output the
    text itself and its lengths null, if it is empty, holds a mark or is not drawn. The ranks and forms depend
    on the id alone: rows with one id draw alike, a null id draws as an empty one, and equal rows give equal
    rows. A null text is empty. Other columns are not read; an empty table gives no rows. Rows are independent,
    so there is no shuffle; a worker holds a text of any length and its output, and texts of 2 MB together.
    """
    checked_marks(marks)
    pattern = re.compile(unit)
    if pattern.fullmatch(""):
        raise ValueError("a unit may not be empty")
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(f"`{id_column}`"), seed)
    marked = F.contains(text, F.lit(marks[0])) | F.contains(text, F.lit(marks[1])) | F.contains(text, F.lit(marks[2]))
    form = F.when((text == "") | marked | (h3 % 100 >= percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_groups(batch):
                rows = []
                for text, form, a, b in zip(*(part.column(k).to_pylist() for k in range(1, 5)), strict=True):
                    n = count_units(pattern, text)
                    if form == "plain":
                        rows.append((n, None, None, text))
                        continue
                    low, high = sorted((a % (n + 1), b % (n + 1)))
                    first, last = ends_at(pattern, text, low, high)
                    before, middle, after = text[:first], text[first:last], text[last:]
                    shown = f"{p}{before}{s}{after}{m}{middle}" if form == "psm" else f"{s}{after}{p}{before}{m}{middle}"
                    rows.append((n, first, last - first, shown))
                n, first, long, shown = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), part.column(2), pa.array(first, pa.int64()), pa.array(long, pa.int64()), pa.array(shown, pa.string())],
                    ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    cut = docs.select(F.col(f"`{id_column}`").alias("id"), text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2")).mapInArrow(
        run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )
    return cut.withColumnRenamed("id", id_column)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of, from the output and its form alone."""

    def parts(first: str, second: str, third: str) -> list[Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(a) + len(second) + 1)
        b = F.substring_index(rest, third, 1)
        return [a, b, F.substr(rest, F.length(b) + len(third) + 1)]

    p, s, m = marks
    before, after, middle = parts(p, s, m)
    after_first, before_second, middle_last = parts(s, p, m)
    return F.when(form == "psm", F.concat(before, middle, after)).when(form == "spm", F.concat(before_second, middle_last, after_first)).otherwise(output)
