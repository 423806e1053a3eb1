"""Best-fit packing of token sequences, improved by exchanges between underfull bins.

Pieces are put into bins by best fit, longest first. Then the emptiest bin gives to fuller ones: it moves one
piece or two, swaps one for one, two for one or one for two, always so that the other bin gains and still holds
them. Every exchange makes the sum of squared fills larger, and the giving bin goes once it is empty.

Groups of pieces are packed by tasks of their own; the bins that are not full go on to the next round, where
they meet those of other groups.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.llm.bpe import no_cycles
from peptrail.llm.shared import claim_cache, staged, text_groups
from peptrail.llm.token_store import LibraryEncoder

#: pieces that one task packs at once, on average
GROUP = 8_192
#: rounds over what is not full yet
ROUNDS = 3
#: bins one after another that may fail to become empty before the search of a group ends
PATIENCE = 24


def best_fit(size: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers: longest pieces first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where a bin has room r
    for i in sorted(range(len(size)), key=lambda i: -size[i]):
        fitting = rooms >> size[i]
        if fitting:
            room = size[i] + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room -= size[i]
        if room:
            if not by_room[room]:
                rooms |= 1 << room
            by_room[room].append(b)
    return bins


class Exchanges:
    """Local search over the bins of one group."""

    def __init__(self, bins: list[list[int]], size: list[int], capacity: int):
        self.bins, self.size, self.capacity = bins, size, capacity
        self.fill = [sum(size[i] for i in b) for b in bins]
        self.known: dict[int, tuple[list, list]] = {}

    def choices(self, b: int) -> tuple[list, list]:
        """Single pieces of a bin and pairs of them as ``(tokens, pieces)``, in order; one for each number of tokens."""
        if b not in self.known:
            one: dict[int, list[int]] = {}
            for i in self.bins[b]:
                one.setdefault(self.size[i], []).append(i)
            lengths = sorted(one)
            two = {}
            for j, n in enumerate(lengths):
                if len(one[n]) > 1:
                    two.setdefault(2 * n, tuple(one[n][:2]))
                for m in lengths[:j]:
                    two.setdefault(n + m, (one[m][0], one[n][0]))
            self.known[b] = [(n, (one[n][0],)) for n in lengths], sorted(two.items())
        return self.known[b]

    def best(self, donor: int, b: int, sums: list[int], given: list[tuple], singles: list[int]) -> tuple[int, tuple, tuple] | None:
        """The exchange by which bin ``b`` gains most: tokens, pieces it gets, pieces it gives."""
        room = self.capacity - self.fill[b]
        one, two = self.choices(b)
        found, most = None, 0
        k = bisect_right(sums, room) - 1
        if k >= 0:
            most, found = sums[k], (sums[k], given[k], ())
        for n, back in one:
            if most == room:
                return found
            k = bisect_right(sums, n + room) - 1
            if k >= 0 and sums[k] - n > most:
                most, found = sums[k] - n, (sums[k] - n, given[k], back)
        own = self.choices(donor)[0]
        for n, back in two:
            if most == room:
                return found
            k = bisect_right(singles, n + room) - 1
            if k >= 0 and singles[k] - n > most:
                most, found = singles[k] - n, (singles[k] - n, own[k][1], back)
        return found

    def offers(self, donor: int) -> tuple[list[int], list[tuple], list[int]]:
        """Tokens that one or two pieces of a bin have, in order; those pieces; tokens of one."""
        one, two = self.choices(donor)
        pieces = dict(two) | dict(one)
        sums = sorted(pieces)
        return sums, [pieces[n] for n in sums], [n for n, _ in one]

    def exchange(self, donor: int, b: int, tokens: int, out: tuple, back: tuple) -> None:
        self.bins[donor] = [i for i in self.bins[donor] if i not in out] + list(back)
        self.bins[b] = [i for i in self.bins[b] if i not in back] + list(out)
        self.fill[donor] -= tokens
        self.fill[b] += tokens
        for k in (donor, b):
            self.known.pop(k, None)

    def drain(self, donor: int, others: list[int]) -> bool:
        """Give from ``donor`` to fuller bins as long as one gains; whether one did."""
        ever, gained, offers = False, True, self.offers(donor)
        while gained:
            gained = False
            for b in others:
                while self.fill[donor] <= self.fill[b] < self.capacity and (move := self.best(donor, b, *offers)) is not None:
                    self.exchange(donor, b, *move)
                    ever = gained = True
                    if not self.bins[donor]:
                        return True
                    offers = self.offers(donor)
        return ever

    def run(self, patience: int = PATIENCE) -> list[list[int]]:
        """Empty bins until as few are left as the tokens need, or ``patience`` bins in a row stay."""
        least = -(-sum(self.fill) // self.capacity)
        count, failed = len(self.bins), 0
        tried: set[int] = set()
        while count > least and failed < patience:
            open_bins = [b for b in range(len(self.bins)) if self.bins[b] and self.fill[b] < self.capacity]
            donor = min((b for b in open_bins if b not in tried), key=lambda b: self.fill[b], default=None)
            if donor is None:
                break
            others = sorted((b for b in open_bins if b != donor), key=lambda b: -self.fill[b])
            if self.drain(donor, others):
                tried.clear()
            if self.bins[donor]:
                failed += 1
                tried.add(donor)
            else:
                count, failed = count - 1, 0
        return [b for b in self.bins if b]


def packed_group(size: list[int], start: list[int], capacity: int, patience: int = PATIENCE) -> list[list[int]]:
    """Bins of the pieces of one group. ``start`` names the bin of each piece so far; the result has no more bins."""
    before: dict[int, list[int]] = {}
    for i, b in enumerate(start):
        before.setdefault(b, []).append(i)
    bins = best_fit(size, capacity)
    if len(before) < len(bins):
        bins = list(before.values())
    return Exchanges(bins, size, capacity).run(patience)


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """``key, doc_id, piece, start, length, ids`` of every row: its ids and the end id, cut into pieces of ``capacity``.

    ``ids`` take two bytes each where the vocabulary allows, else four. The key is a number of the row in the
    written table.
    """
    from tokenizers import Tokenizer

    encoders: dict[str, LibraryEncoder] = {}
    narrow = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16
    kind = "<u2" if narrow else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_cache("pieces", encoders.clear)
        encode = encoders.get(tokenizer_path) or encoders.setdefault(tokenizer_path, LibraryEncoder(tokenizer_path))
        tail = np.array([end_id], kind)
        with no_cycles():
            for batch in batches:
                for part in text_groups(batch):
                    keys, piece, start, cut, ids = part.column(0).to_pylist(), [], [], [], []
                    owner = []
                    for key, raw in zip(keys, encode.encode_bytes(part.column(1).to_pylist()), strict=True):
                        whole = np.r_[np.frombuffer(raw, "<u4").astype(kind), tail]
                        for k, at in enumerate(range(0, len(whole), capacity)):
                            some = whole[at : at + capacity]
                            owner.append(key)
                            piece.append(k)
                            start.append(at)
                            cut.append(len(some))
                            ids.append(some.tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(owner, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(cut, pa.int64()), pa.array(ids, pa.binary())],
                        ["doc_id", "piece", "start", "length", "ids"],
                    )

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = cut.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")
    return pieces.withColumn("key", F.monotonically_increasing_id())


def places(lengths: DataFrame, capacity: int, group: int = GROUP, rounds: int = ROUNDS, patience: int = PATIENCE) -> DataFrame:
    """``key, sequence_id, offset`` of ``lengths(key, length)``: keys are distinct, lengths under ``capacity``.

    A sequence is named by its least key; pieces stand in it in the order of keys. Each round deals bins to
    groups of about ``group`` pieces by a hash; bins that are full, and all of the last round, stay as they are.
    No round makes more bins of the same pieces.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", ignore_index=True)
        size, key = rows.length.tolist(), rows.key.to_numpy()
        sequence, offset, full = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64), np.empty(len(rows), bool)
        for b in packed_group(size, rows.sequence_id.tolist(), capacity, patience):
            at = np.sort(np.array(b))
            long = np.array([size[i] for i in at])
            sequence[at], offset[at], full[at] = key[at[0]], np.cumsum(long) - long, long.sum() == capacity
        return pd.DataFrame({"key": key, "length": rows.length, "sequence_id": sequence, "offset": offset, "full": full})

    left = lengths.select("key", "length", F.col("key").alias("sequence_id"))
    done = None
    n_left = left.count()
    for k in range(rounds):
        n = max(1, -(-n_left // group))
        dealt = left.withColumn("part", F.pmod(F.xxhash64("sequence_id", F.lit(k)), F.lit(n)))
        packed = staged(dealt.groupBy("part").applyInPandas(run, "key long, length long, sequence_id long, offset long, full boolean"), "packed", narrow=True)
        bins, tokens, n_left = packed.where("not full").agg(
            F.coalesce(F.sum((F.col("offset") == 0).cast("long")), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0)), F.count("*")
        ).first()
        last = n == 1 or k == rounds - 1 or bins <= -(-tokens // capacity)
        kept = (packed if last else packed.where("full")).select("key", "sequence_id", "offset")
        done = kept if done is None else done.unionAll(kept)
        if last:
            break
        left = packed.where("not full").select("key", "length", "sequence_id")
    return done


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, group: int = GROUP, rounds: int = ROUNDS, patience: int = PATIENCE,
) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset`` of all pieces of ``docs(doc_id, text)``.

    ``ids`` are little-endian unsigned 32-bit integers. A document is its text's ids and ``end_id``; only one of
    over ``capacity`` tokens is cut, into whole pieces and a last one. A sequence holds ``capacity`` tokens at most,
    without gaps from offset 0. A null or empty text is the end id alone; every row is packed for itself, so
    null, repeated and equal ids keep their rows. Other columns are not read; an empty table gives no rows.
    Ids are shuffled once, to meet their places; packing sees keys and lengths only. The texts are read once
    and the pieces written to the shared folder.
    """
    pieces = staged(pieces_of(docs, tokenizer_path, end_id, capacity), "pieces")
    found = places(pieces.where(F.col("length") < capacity).select("key", "length"), capacity, group, rounds, patience)
    met = pieces.join(found.hint("shuffle_hash"), "key", "left").select(
        "doc_id", "piece", "start", "length", "ids", F.coalesce("sequence_id", "key").alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset")
    )

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_groups(batch, 4):
                lengths, packed = part.column(3).to_pylist(), part.column(4).to_pylist()
                ids = [x if len(x) == 4 * n else np.frombuffer(x, "<u2").astype("<u4").tobytes() for n, x in zip(lengths, packed, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(ids, pa.binary()), *part.columns[5:]], part.schema.names)

    return met.mapInArrow(wide, met.schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, doc_ids, lengths, ids`` of each sequence of ``pack``: what a trainer reads."""
    held = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    bound = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), held.alias("held"))
    ids = F.aggregate(F.col("held.ids"), F.lit(b""), lambda a, b: F.concat(a, b))
    return bound.select("sequence_id", "n_tokens", F.col("held.doc_id").alias("doc_ids"), F.col("held.length").alias("lengths"), ids.alias("ids"))
