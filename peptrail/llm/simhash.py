"""SimHash fingerprints of word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peptrail.llm.shared import min_components, staged

BITS = 64


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a whole text's word shingles, repeats included; 0 without words.

    A-Z are lower-cased, words are runs of other than ASCII white space; fewer words than a shingle
    holds make one shingle. A bit is 1 if over half of the shingles' XXH64 have it.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:n].tolist()
    end = end[min(shingle, len(words)) - 1 :].tolist()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        h = [digest(joined[a:b], seed) for a, b in zip(start[at : at + 65_536], end[at : at + 65_536], strict=True)]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n).view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) of ``docs(doc_id, text)``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


@dataclass(frozen=True)
class Segment:
    """Bits ``[low, low + width)`` of a fingerprint, searched within ``radius`` differing bits."""

    low: int
    width: int
    radius: int

    def keys(self, fp: Column, number: int) -> list[Column]:
        """Table keys of the ball around a fingerprint's segment, its own key first."""
        own = F.shiftrightunsigned(fp, self.low).bitwiseAND(F.lit((1 << self.width) - 1))
        tag = F.lit(number << 56)
        masks = [sum(1 << b for b in bits) for r in range(self.radius + 1) for bits in combinations(range(self.width), r)]
        return [own.bitwiseXOR(F.lit(m)).bitwiseOR(tag) for m in masks]


def segments_for(n: int, distance: int) -> list[Segment]:
    """Segments of about log2(n) bits with radii that lose no pair within ``distance`` bits.

    With m segments and distance = m * r + a, a pair within the distance is within r bits in one of
    the first a + 1 segments or within r - 1 in one of the rest (none of those if r is 0).
    """
    wanted = max(1, min(distance + 1, round(BITS / max(12.0, math.log2(max(n, 2))))))
    r, a = divmod(distance, wanted)
    cut = [BITS * k // wanted for k in range(wanted + 1)]
    radii = [r if k <= a else r - 1 for k in range(wanted)]
    return [Segment(cut[k], cut[k + 1] - cut[k], radii[k]) for k in range(wanted) if radii[k] >= 0]


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that links ``(a, b)`` reach from each of n places."""
    least = np.arange(n)
    while len(a):
        x, y = least[a], least[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (up := least[least]).tobytes() != least.tobytes():
            least = up
    return least


def bucket_links(key: np.ndarray, own: np.ndarray, fp: np.ndarray, rep: np.ndarray, distance: int, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what is connected in each bucket: each rep and the least rep of its component.

    Rows come ordered by key, a bucket's table entries (``own``) before its probes. Entries meet all rows
    of their bucket, at most ``at_once`` pairs at a time.
    """
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    many = np.diff(np.r_[first, len(key)])
    entries = np.add.reduceat(own.astype(np.int64), first) if len(key) else many
    least = np.arange(len(key))
    asked = np.flatnonzero((entries > 0) & (many > 1))
    cost = entries[asked] * many[asked]
    group = np.cumsum(cost) // at_once  # buckets that fit one step together
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(asked) else asked
    for lo, hi in pairwise(cuts.tolist()):
        some = asked[lo:hi]
        start, n, m = first[some], entries[some], many[some]
        left = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # each entry's place
        wide, base = np.repeat(m, n), np.repeat(start, n)
        ends = np.cumsum(wide)
        at = 0
        while at < len(left):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2 * at_once, side="right")))
            w = wide[at:stop]
            i = np.repeat(left[at:stop], w)
            j = np.repeat(base[at:stop], w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            near = (least[i] != least[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= distance)
            i, j = least[i[near]], least[j[near]]
            if len(i):
                places, back = np.unique(np.r_[i, j], return_inverse=True)
                to = places[_joined(len(places), back[: len(i)], back[len(i) :])]
                b0, b1 = int(start[0]), int(start[-1] + m[-1])
                held = least[b0:b1]
                spot = np.minimum(np.searchsorted(places, held), len(places) - 1)
                least[b0:b1] = np.where(places[spot] == held, to[spot], held)
            at = stop
    best = rep.copy()
    np.minimum.at(best, least, rep)
    root = best[least]
    apart = root != rep
    return rep[apart], root[apart]


def _span(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """``a, b`` of rows ``key, own, fp, rep`` that are ordered by key, entries first; a bucket may go on over batches."""
    held = None  # entries of the last bucket
    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp, rep = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
        own = batch.column(1).to_numpy(zero_copy_only=False)
        if held is not None and held[0][0] == key[0]:
            key, own, fp, rep = (np.concatenate(c) for c in zip(held, (key, own, fp, rep), strict=True))
        last = np.searchsorted(key, key[-1])
        mine = np.flatnonzero(own[last:]) + last
        held = (key[mine], own[mine], fp[mine], rep[mine]) if len(mine) else None
        a, b = bucket_links(key, own, fp, rep, distance)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links_within(reps: DataFrame, distance: int, hot: int = 2048) -> DataFrame:
    """Links ``(a, b)`` between the ids of ``reps(rep, fp)`` (distinct fp) that keep every connection within ``distance`` bits.

    Each fingerprint enumerates the ball of keys in each segment and meets the table entries with such
    a key; full distances decide. A bucket gives only links that span what is connected in it, so
    near copies never make all their pairs. Of a bucket of over ``hot`` table entries, the bits beyond
    its segment are cut into distance + 1 runs, one of which is equal in each pair that is sought; what
    is over ``hot`` even then is dealt over blocks of about ``hot`` entries each.
    """
    reps = staged(reps.where("rep is not null").select("rep", "fp"), "reps", narrow=True)
    plan = segments_for(reps.count(), distance)
    keys = [F.struct(x.alias("key"), F.lit(j == 0).alias("own")) for k, s in enumerate(plan) for j, x in enumerate(s.keys(F.col("fp"), k))]
    rows = reps.select("rep", "fp", F.inline(F.array(*keys)))

    def split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        counts = staged(rows.where("own").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot), "hot", narrow=True)
        return (rows, None) if counts.isEmpty() else (rows.join(counts, "key", "left_anti"), rows.join(counts, "key"))

    rows, big = split(rows)
    if big is not None:
        finer, big = split(staged(big.select("rep", "fp", "own", F.explode(F.array(*_other_runs(plan, distance + 1))).alias("key")), "finer", narrow=True))
        rows = rows.unionByName(finer)
    if big is not None:
        chunks = F.ceil(F.col("n") / hot).cast("int")
        mine, every = F.pmod(F.xxhash64("fp"), chunks).cast("int"), F.explode(F.sequence(F.lit(0), chunks - 1))
        entries = big.where("own").select("key", "own", "rep", "fp", mine.alias("t"), every.alias("p"))
        probes = big.select("key", F.lit(False).alias("own"), "rep", "fp", every.alias("t"), mine.alias("p"))
        rows = rows.unionByName(entries.unionByName(probes).select(F.xxhash64("key", "t", "p").alias("key"), "own", "rep", "fp"))
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "own", "fp", "rep").repartition(n, "key").sortWithinPartitions(F.col("key"), F.col("own").desc())
    return dealt.mapInArrow(lambda batches: _span(batches, distance), "a long, b long")


def _other_runs(plan: list[Segment], n: int) -> list[Column]:
    """Keys of n runs of the bits outside the segment of ``key``, together with ``key``."""
    out, number = [], F.shiftrightunsigned("key", 56)
    for p in range(n):
        run = F.lit(0).cast("long")
        for k, s in enumerate(plan):
            above = F.shiftleft(F.shiftrightunsigned("fp", s.low + s.width), s.low) if s.low + s.width < BITS else F.lit(0).cast("long")
            rest = F.col("fp").bitwiseAND(F.lit((1 << s.low) - 1)).bitwiseOR(above)
            low, high = (BITS - s.width) * p // n, (BITS - s.width) * (p + 1) // n
            run = F.when(number == k, F.shiftrightunsigned(rest, low).bitwiseAND(F.lit((1 << (high - low)) - 1))).otherwise(run)
        out.append(F.xxhash64("key", F.lit(p), run))
    return out


def near_duplicates(docs: DataFrame, distance: int = 4, hot: int = 2048) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs(doc_id, text)``.

    Documents are linked where fingerprints differ in at most ``distance`` bits; ``component_id`` is the
    smallest doc_id that links reach. Null and empty texts have fingerprint 0 and are linked like any
    other; a null doc_id links nothing and has a null component; rows with one doc_id are one document.
    Exact copies meet as one fingerprint before anything is joined.
    """
    marks = staged(fingerprints(docs), "fingerprints")
    reps = staged(marks.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps", narrow=True)
    ids = marks.where("doc_id is not null").select(F.col("doc_id").alias("id"), "fp")
    links = links_within(reps, distance, hot)
    # an id with several texts holds their fingerprints together
    many = ids.groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("id")
    doubled = ids.join(many, "id", "left_semi").join(reps, "fp").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    groups = staged(min_components(reps.where("rep is not null").select(F.col("rep").alias("id")), links.unionByName(doubled)), "groups", narrow=True)
    by_fp = staged(reps.join(groups, reps.rep == groups.id, "left").select("fp", "component"), "by_fp", narrow=True)
    return marks.join(by_fp, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id")
    )


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, distance: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near duplicates the one with the smallest doc_id.

    Rows with a null doc_id stay. Of several rows with one kept doc_id the one with the least text stays
    (null before all), of equal texts the one with the least hash of all its columns.
    """
    found = near_duplicates(docs, distance).where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("__drop_id")).distinct()
    kept = docs.join(found, F.col("doc_id").cast("long") == F.col("__drop_id"), "left_anti")
    again = staged(docs.groupBy(F.col("doc_id").alias("__again_id")).agg(F.count("*").alias("__n")).where("__again_id is not null and __n > 1").select("__again_id"), "again", narrow=True)
    if again.isEmpty():
        return kept
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first(), F.xxhash64(*[f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind]))
    one = kept.join(again, F.col("doc_id") == F.col("__again_id"), "left_semi").withColumn("__row", F.row_number().over(first)).where("__row = 1").drop("__row")
    return kept.join(again, F.col("doc_id") == F.col("__again_id"), "left_anti").unionByName(one)
