"""BPE encoding and decoding by speculation and verification.

A word's tokens are proposed by greedy longest match. A sequence of tokens is the merge result
exactly if each token is the merge result of its own bytes and every adjacent pair is compatible,
i.e. merging the two tokens' bytes would stop at this same border; that test runs on numpy arrays
for all distinct pairs at once. Only words with an incompatible pair are merged step by step.
"""

from __future__ import annotations

import gc
import heapq
import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from peptrail.llm.shared import CACHE_BYTES, WordCache, claim_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: fixed values: white space as Unicode defines it (Python's own split has four control characters more)
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPACE = re.compile(f"[{WHITE_SPACE}]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: letters and numbers up to U+017F; below it texts are normalised (NFC) as they are, lower-casing goes by
#: character (but for U+0130), and no Unicode version changes a character's class
_LETTER, _NUMBER = re.compile("[a-zªµºÀ-ÖØ-öø-ſ]"), re.compile("[0-9²³¹¼-¾]")
_PLAIN = re.compile("[\t-\r -~\x85\xa0-\xac\xae-\u012f\u0131-\u017f]*")
#: fixed values: what the vocabulary file's word pattern takes off as one word after an apostrophe
_SHORT = ("s", "t", "re", "ve", "m", "ll", "d")
#: bytes of text and words that are looked up together
PIECE_BYTES = 1 << 21
PIECE_WORDS = 30_000
#: symbols of a word from which on it is merged by a queue of pairs and not in rounds with other words
LONG_WORD = 2_000


class CachedEncoder:
    """Ids of whole texts from the ids of their distinct words.

    Words of the tokenizer never cross white space and marker strings hold none. Plain Latin texts are
    cut into words here; of other texts, and of those with marker strings, each white-space separated
    chunk goes to ``_odd``. The caches are bounded in bytes.
    """

    def __init__(self, most: int = CACHE_BYTES):
        self.words, self.chunks = WordCache(most * 3 // 4), WordCache(most // 4)

    def _new(self, words: list[str]) -> list[bytes]:
        raise NotImplementedError

    def _odd(self, chunks: list[str]) -> list[bytes]:
        raise NotImplementedError

    def encode_bytes(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers; a null text is empty."""
        out: list[list[bytes]] = [[] for _ in texts]
        plain: list[tuple[int, bytes]] = []
        odd: list[tuple[int, list[str]]] = []
        size = n = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if "<|" not in text and _PLAIN.fullmatch(text):
                for piece in _pieces(text.lower(), PIECE_BYTES):
                    plain.append((i, piece.encode()))
                    size += len(piece)
                    if size >= PIECE_BYTES:
                        self._encode_plain(plain, out)
                        plain, size = [], 0
                continue
            parts = text.split() if not _ODD_SPACE.search(text) else [c for c in _SPACE.split(text) if c]
            for at in range(0, len(parts), PIECE_WORDS):
                odd.append((i, parts[at : at + PIECE_WORDS]))
                n += len(odd[-1][1])
                if n >= PIECE_WORDS:
                    self._encode_odd(odd, out)
                    odd, n = [], 0
        self._encode_plain(plain, out)
        self._encode_odd(odd, out)
        return [o[0] if len(o) == 1 else b"".join(o) for o in out]

    def _encode_plain(self, group: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        words, ends = cut_words([data for _, data in group])
        if not len(words):
            return
        # each distinct word of the group is looked up once, then ids are gathered word by word
        coded = words.dictionary_encode()
        names = _as_list(coded.dictionary)
        known = self.words.holding(set(names), self._new)
        values = [known[w] for w in names]
        size = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        flat, first = np.frombuffer(b"".join(values), "<u4"), np.cumsum(size) - size
        place = coded.indices.to_numpy()
        count = size[place]
        last = np.cumsum(count)
        ids = flat[np.repeat(first[place] - last + count, count) + np.arange(last[-1])].tobytes()
        cuts = (np.r_[0, last][ends] * 4).tolist()
        for (i, _), a, b in zip(group, [0, *cuts], cuts, strict=False):
            out[i].append(ids[a:b])

    def _encode_odd(self, group: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        known = self.chunks.holding(set(chain.from_iterable(parts for _, parts in group)), self._odd)
        for i, parts in group:
            out[i].append(b"".join(map(known.__getitem__, parts)))


def _as_list(words: pa.StringArray) -> list[str]:
    """Words without white space as a list: joined and split, which is faster than one by one."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py().split("\n")


def _pieces(text: str, most: int) -> Iterator[str]:
    """A text in pieces of about ``most`` characters that end at white space, where there is any."""
    at = 0
    while len(text) - at > most:
        space = _SPACE.search(text, at + most)
        if space is None:
            break
        yield text[at : space.start()]
        at = space.end()
    yield text[at:] if at else text


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Classes of ASCII bytes and of the two-byte characters from U+0080 to U+017F: 0 white space, 1 letters, 2 numbers, 3 others."""
    kind = lambda c: 0 if _SPACE.match(c) else 1 if _LETTER.match(c) else 2 if _NUMBER.match(c) else 3
    return np.array([kind(chr(k)) if k < 128 else 0 for k in range(256)], np.uint8), np.array([kind(chr(k)) for k in range(128, 384)], np.uint8)


def cut_words(texts: list[bytes]) -> tuple[pa.StringArray, np.ndarray]:
    """Words of plain texts in lower case (UTF-8) by the vocabulary file's pattern, and how many there are up to each text's end.

    A word is a run of letters, a number sign, a run of other characters, or a short ending that begins
    with an apostrophe; white space parts words and is dropped.
    """
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    if not len(raw):
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    kind = _ASCII_CLASS[raw]
    lead = np.flatnonzero(raw >= 0xC2)
    if len(lead):
        kind[lead] = kind[lead + 1] = _LATIN_CLASS[(raw[lead].astype(np.int64) - 0xC2) * 64 + raw[lead + 1] - 0x80]
    new = np.r_[True, kind[1:] != kind[:-1]] | (kind == 2)
    if len(lead):
        new[lead + 1] = False
    new &= kind > 0
    mark = np.flatnonzero((raw == 39) & new)
    mark = mark[(mark + 1 < len(raw)) & (kind[np.minimum(mark + 1, len(raw) - 1)] == 1)]
    if len(mark):
        padded = np.r_[raw, np.zeros(2, np.uint8)]
        taken = np.zeros(len(mark), np.int64)
        for ending in _SHORT:
            fits = np.logical_and.reduce([padded[mark + 1 + j] == ord(c) for j, c in enumerate(ending)])
            taken = np.where((taken == 0) & fits, len(ending), taken)
        mark, taken = mark[taken > 0], taken[taken > 0]
        new[mark + 1] = False
        after = mark + 1 + taken
        after = after[after < len(raw)]
        new[after] |= kind[after] == 1
    kept = kind > 0
    data = raw[kept]
    start = np.flatnonzero(new[kept])
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.r_[start, len(data)].astype(np.int32)), pa.py_buffer(data))
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return words, np.searchsorted(np.flatnonzero(new), np.cumsum(size + 1) - 1)


_ASCII_CLASS, _LATIN_CLASS = _classes()


@contextmanager
def no_cycles() -> Iterator[None]:
    """Without the cycle collector, which else walks the caches again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _byte_shown() -> dict[int, int]:
    """Bytes as byte-level BPE shows them: visible Latin-1 characters stay, others move up from U+0100."""
    kept = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    moved = [b for b in range(256) if b not in kept]
    return {b: 256 + k for k, b in enumerate(moved)}


BYTE_SHOWN = _byte_shown()


def as_shown(word: str) -> str:
    """A word without white space in byte-level characters."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_SHOWN)


class SpeculativeBpe(CachedEncoder):
    """Encoder and decoder over a tokenizers JSON file with an end-of-word suffix."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.token = np.empty(size, object)
        for text, k in [*self.vocab.items(), *self.special.items()]:
            self.token[k] = text
        self.token_bytes = [("" if t is None else t).encode() for t in self.token]
        self.result = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        # made[k]: rank of the merge that makes token k; -1 for symbols that no merge makes
        self.made = np.full(size, -1, np.int64)
        self.left = np.arange(size)
        self.right = np.arange(size)
        key, value = [], []
        for i, (a, b) in enumerate(pairs):
            k, x, y = self.vocab[a + b], self.vocab[a], self.vocab[b]
            if self.made[k] < 0:
                self.made[k], self.left[k], self.right[k] = i, x, y
            key.append(x * size + y)
            value.append(i)
        order = np.argsort(np.array(key))
        self.pair_key, self.pair_rank, self.size = np.array(key)[order], np.array(value)[order], size
        # tokens that are the merge result of their own symbols may be proposed
        ids = np.arange(size)
        merged = ids[self.made >= 0]
        own = np.ones(size, bool)
        own[merged] = self._compatible(self.left[merged], self.right[merged], self.made[merged])
        self.known = {t: k for t, k in self.vocab.items() if own[k]}
        self.longest_inner = max(len(t) for t in self.known if not (self.suffix and t.endswith(self.suffix)))
        self.longest = max(len(t) for t in self.known)
        # id of each single byte-level character inside a word and at its end
        self.inner = np.full(512, -1, np.int64)
        self.final = np.full(512, -1, np.int64)
        for t, k in self.vocab.items():
            if len(t) == 1 and ord(t) < 512:
                self.inner[ord(t)] = k
            elif len(t) == 1 + len(self.suffix) and t.endswith(self.suffix) and ord(t[0]) < 512:
                self.final[ord(t[0])] = k
        self._library = Tokenizer.from_file(path)
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.merged_words = 0

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], np.iinfo(np.int64).max)

    def _compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the border of a and b before both are complete.

        Walks both tokens' merge trees back in time: the later of the two innermost merges is
        undone, and the pair that then meets at the border must not have a merge that would have
        come first. ``until``: rank of the merge of (a, b) itself, which is then allowed.
        """
        a, b, good = a.copy(), b.copy(), np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max) if until is None else until.astype(np.int64).copy()
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            bad = self._ranks(x, y) < limit[live]
            good[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            rx, ry = self.made[x], self.made[y]
            more = (rx >= 0) | (ry >= 0)
            live, x, y, rx, ry = live[more], x[more], y[more], rx[more], ry[more]
            # of equal ranks the left one is merged first, so the right one is undone first
            undo_x = rx > ry
            # the pair at the border stood until this merge; on a tie to the left it came earlier
            limit[live] = np.where(undo_x, rx, ry + 1)
            a[live] = np.where(undo_x, self.right[x], x)
            b[live] = np.where(undo_x, y, self.left[y])
        return good

    def _greedy(self, word: str) -> list[int]:
        n, at, out, known, suffix = len(word), 0, [], self.known, self.suffix
        while at < n:
            whole = known.get(word[at:] + suffix) if n - at <= self.longest else None
            if whole is not None:
                out.append(whole)
                break
            for end in range(min(n - 1, at + self.longest_inner), at, -1):
                k = known.get(word[at:end])
                if k is not None:
                    out.append(k)
                    at = end
                    break
            else:
                return []
        return out

    def _merge(self, words: list[str]) -> list[bytes]:
        """Exact merging of many words at once: in each round every word merges its lowest-ranked
        pair, all places of it from the left; symbols without an id are left out."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        symbol = self.inner[np.minimum(code, 511)]
        last = np.cumsum(size) - 1
        symbol[last] = self.final[np.minimum(code[last], 511)]
        owner = np.repeat(np.arange(len(words)), size)
        owner, symbol = owner[symbol >= 0], symbol[symbol >= 0]
        done_owner, done_symbol = [], []
        never = np.iinfo(np.int64).max
        while len(symbol):
            rank = np.full(len(symbol), never)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inner] = self._ranks(symbol[inner], symbol[inner + 1])
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.r_[start, len(owner)]))
            over = least == never
            if over.any():
                done_owner.append(owner[over])
                done_symbol.append(symbol[over])
                owner, symbol, rank, least = owner[~over], symbol[~over], rank[~over], least[~over]
                if not len(symbol):
                    break
            hit = rank == least
            # in a run of equal symbols every other place merges
            place = np.arange(len(hit))
            run = place - np.maximum.accumulate(np.where(hit, -1, place))
            hit &= run % 2 == 1
            at = np.flatnonzero(hit)
            symbol[at] = self.result[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            owner, symbol = owner[keep], symbol[keep]
        owner, symbol = np.concatenate([*done_owner, []]), np.concatenate([*done_symbol, []]).astype("<u4")
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(1, len(words) + 1)) * 4
        data, out, before = symbol[order].tobytes(), [], 0
        for end in cut.tolist():
            out.append(data[before:end])
            before = end
        return out

    def _merge_long(self, word: str) -> bytes:
        """Exact merging of one long word: pairs wait in a heap by rank and place."""
        code = np.frombuffer(word.encode("utf-32-le"), "<u4")
        symbol = self.inner[np.minimum(code, 511)]
        symbol[-1] = self.final[min(int(code[-1]), 511)]
        symbol = symbol[symbol >= 0].tolist()
        n, never = len(symbol), np.iinfo(np.int64).max
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        ranks = self._ranks(np.array(symbol[:-1], np.int64), np.array(symbol[1:], np.int64)) if n > 1 else np.empty(0, np.int64)
        waiting = [(int(r), i, symbol[i], symbol[i + 1]) for i, r in enumerate(ranks.tolist()) if r != never]
        heapq.heapify(waiting)
        rank_of: dict[tuple[int, int], int] = {}

        def wait(i: int) -> None:
            pair = symbol[i], symbol[after[i]]
            if pair not in rank_of:
                rank_of[pair] = int(self._ranks(np.array([pair[0]]), np.array([pair[1]]))[0])
            if rank_of[pair] != never:
                heapq.heappush(waiting, (rank_of[pair], i, *pair))

        while waiting:
            rank, i, x, y = heapq.heappop(waiting)
            j = after[i] if symbol[i] == x else -1
            if j < 0 or symbol[j] != y:
                continue
            symbol[i], symbol[j] = int(self.result[rank]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                wait(i)
            if before[i] >= 0:
                wait(before[i])
        return np.array([k for k in symbol if k >= 0], "<u4").tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each byte-level word."""
        if not words:
            return []
        proposed = [self._greedy(w) for w in words]
        count = np.fromiter(map(len, proposed), np.int64, len(words))
        flat = np.fromiter((k for p in proposed for k in p), np.int64, int(count.sum()))
        bad = count == 0
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(words)), count)
            inner = owner[1:] == owner[:-1]
            key = flat[:-1][inner] * self.size + flat[1:][inner]
            distinct, back = np.unique(key, return_inverse=True)
            good = self._compatible(distinct // self.size, distinct % self.size)[back]
            bad[np.unique(owner[1:][inner][~good])] = True
        data, ends = flat.astype("<u4").tobytes(), (np.cumsum(count) * 4).tolist()
        out, at = [], 0
        wrong = np.flatnonzero(bad).tolist()
        for end in ends:
            out.append(data[at:end])
            at = end
        for k in [k for k in wrong if len(words[k]) > LONG_WORD]:
            out[k] = self._merge_long(words[k])
        wrong = [k for k in wrong if len(words[k]) <= LONG_WORD]
        for k, ids in zip(wrong, self._merge([words[k] for k in wrong]) if wrong else [], strict=True):
            out[k] = ids
        self.merged_words += int(bad.sum())
        return out

    def _new(self, words: list[str]) -> list[bytes]:
        return self.encode_words([as_shown(w) for w in words])

    def _odd(self, chunks: list[str]) -> list[bytes]:
        """Chunks as the library normalises and cuts them, with marker strings taken out first."""
        parts = []
        for chunk in chunks:
            parts.append([])
            for piece in self._split.split(chunk) if self._split and "<|" in chunk else [chunk]:
                if piece in self.special:
                    parts[-1].append(np.array([self.special[piece]], "<u4").tobytes())
                elif piece:
                    shown = self._library.normalizer.normalize_str(piece)
                    parts[-1] += [w for w, _ in self._library.pre_tokenizer.pre_tokenize_str(shown)]
        words = list({w for p in parts for w in p if isinstance(w, str)})
        ids = dict(zip(words, self.encode_words(words), strict=True))
        return [b"".join(ids[w] if isinstance(w, str) else w for w in p) for p in parts]

    def decode_bytes(self, ids: bytes) -> bytes:
        """Token strings joined with a space, as the library does for a file without a decoder."""
        table = self.token_bytes
        return b" ".join([table[k] for k in np.frombuffer(ids, "<u4").tolist()])


_OPEN: dict[str, SpeculativeBpe] = {}


def codec(path: str) -> SpeculativeBpe:
    """One codec for each Python process and file."""
    if path not in _OPEN:
        _OPEN[path] = SpeculativeBpe(path)
    return _OPEN[path]


def encode_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode and decode every text of ``docs``.

    Returns ``id_column, ids binary (little-endian 32-bit), decoded binary (UTF-8)``, one row for
    each input row. Null and empty texts give no ids; null ids of rows stay null; other columns are
    not read. Rows are independent, so there is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_cache("bpe", _OPEN.clear)
        bpe = codec(path)
        with no_cycles():
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    ids = bpe.encode_bytes(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode_bytes, ids), pa.binary())],
                        [id_column, "ids", "decoded"],
                    )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids binary, decoded binary")


def digests(encoded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Token count and SHA-256 of ids and of the decoded text of ``encode_decode``'s rows."""
    from pyspark.sql import functions as F

    return encoded.select(
        id_column,
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
