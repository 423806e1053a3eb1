"""Binary token files: fixed-size id blocks, transposed into byte or bit planes, one zstandard frame a plane.

File layout (little-endian)::

    header   4s magic "BPS1", u8 plane kind (1 byte planes, 0 bit planes), u32 ids a block
    blocks   the compressed planes of each block, one after another
    index    zstandard of: for each block u64 offset, u32 ids, u32 crc32 of the raw ids, u32 x planes sizes;
             then for each document i64 key (0 if null), u8 key is null, u64 first id, u64 ids
    trailer  u64 index offset, u64 index size, u32 blocks, u32 documents, 4s magic

A reader takes the trailer, then the index, then only the blocks that a range of ids touches.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peptrail.llm.bpe import CachedEncoder, as_shown, no_cycles
from peptrail.llm.shared import claim_cache, fresh_path, frugal

MAGIC = b"BPS1"
BLOCK_IDS = 16_384
FILE_IDS = 4_000_000


def to_planes(ids: np.ndarray, byte_planes: bool = True) -> list[bytes]:
    """Planes of a block of ids: 4 of bytes, or 32 of bits (padded to whole bytes)."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if byte_planes:
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8, n) for p in planes], 1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], 1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class TokenFileWriter:
    """Collects documents and gives the file's bytes; one file is bounded by ``FILE_IDS`` ids and a document."""

    def __init__(self, byte_planes: bool = True, block_ids: int = BLOCK_IDS):
        import zstandard

        self.pack, self.byte_planes, self.block_ids = zstandard.ZstdCompressor(level=3), byte_planes, block_ids
        self.parts = [struct.pack("<4sBI", MAGIC, byte_planes, block_ids)]
        self.size, self.blocks, self.docs = len(self.parts[0]), [], []
        self.held: list[bytes] = []
        self.held_ids = self.n_ids = 0

    def add(self, key: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.append((key or 0, key is None, self.n_ids, n))
        self.held.append(ids)
        self.held_ids += n
        self.n_ids += n
        if self.held_ids >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        whole = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for at in range(0, whole, self.block_ids):
            block = ids[at : min(at + self.block_ids, whole)]
            planes = [self.pack.compress(p) for p in to_planes(block, self.byte_planes)]
            self.blocks.append(struct.pack(f"<QII{len(planes)}I", self.size, len(block), zlib.crc32(block.tobytes()), *map(len, planes)))
            self.parts += planes
            self.size += sum(map(len, planes))
        self.held, self.held_ids = [ids[whole:].tobytes()], len(ids) - whole

    def finish(self) -> bytes:
        self._flush(True)
        keys, nulls, first, n = zip(*self.docs, strict=True) if self.docs else ((), (), (), ())
        index = self.pack.compress(
            b"".join(self.blocks)
            + np.array(keys, "<i8").tobytes() + np.array(nulls, np.uint8).tobytes()
            + np.array(first, "<u8").tobytes() + np.array(n, "<u8").tobytes()
        )
        trailer = struct.pack("<QQII4s", self.size, len(index), len(self.blocks), len(self.docs), MAGIC)
        return b"".join([*self.parts, index, trailer])


class TokenFile:
    """Reader over any random-access file object."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor()
        at, n, blocks, docs, magic = struct.unpack("<QQII4s", self._read(size - 28, 28))
        head, self.byte_planes, self.block_ids = struct.unpack("<4sBI", self._read(0, 9))
        if magic != MAGIC or head != MAGIC:
            raise ValueError("not a token file")
        index = self.unpack.decompress(self._read(at, n))
        planes = 4 if self.byte_planes else 32
        step = 16 + 4 * planes
        self.blocks = [struct.unpack_from(f"<QII{planes}I", index, k * step) for k in range(blocks)]
        rest = memoryview(index)[blocks * step :]
        self.keys = np.frombuffer(rest, "<i8", docs)
        self.null_keys = np.frombuffer(rest, np.uint8, docs, docs * 8)
        self.first = np.frombuffer(rest, "<u8", docs, docs * 9)
        self.n = np.frombuffer(rest, "<u8", docs, docs * 17)
        self._last: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            at, n, crc, *sizes = self.blocks[k]
            raw, planes = self._read(at, sum(sizes)), []
            for size in sizes:
                planes.append(self.unpack.decompress(raw[:size]))
                raw = raw[size:]
            ids = from_planes(planes, n)
            if zlib.crc32(ids.tobytes()) != crc:
                raise ValueError(f"block {k} is damaged")
            self._last = (k, ids)
        return self._last[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        parts, k = [np.empty(0, "<u4")], start // self.block_ids
        while n > 0:
            got = self.block(k)[start - k * self.block_ids :][:n]
            parts.append(got)
            start, n, k = start + len(got), n - len(got), k + 1
        return np.concatenate(parts)


class LibraryEncoder(CachedEncoder):
    """Ids by the tokenizers library; each distinct word of plain Latin texts goes to its BPE model once.

    Words come cut and in lower case, so the model is asked for them directly. Chunks beyond plain Latin
    text go through the library's whole encoder.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model

    def _odd(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]

    def _new(self, words: list[str]) -> list[bytes]:
        flat: list[int] = []
        cuts = [0]
        cut = self.model.tokenize
        for word in words:
            flat += [t.id for t in cut(as_shown(word))]
            cuts.append(4 * len(flat))
        data = np.array(flat, "<u4").tobytes()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoded(docs: DataFrame, tokenizer_path: str, cuts: list[int], narrow: bool) -> DataFrame:
    """``place, doc_id, mark, ids`` of ``docs(doc_id, text)``; ids take two bytes each if ``narrow``, else four.

    ``place`` is the range between ``cuts`` that a doc_id falls in (null in the first). A doc_id that is
    several cuts at once, for so many rows have it, is dealt over their ranges in the order of ``mark``.
    """
    edges = np.array(cuts, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_cache("tokens", _ENCODERS.clear)
        encode = _ENCODERS.get(tokenizer_path) or _ENCODERS.setdefault(tokenizer_path, LibraryEncoder(tokenizer_path))
        with no_cycles():
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    some = batch.slice(at, 512)
                    ids = encode.encode_bytes(some.column(1).to_pylist())
                    if narrow:
                        ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
                    mark = np.fromiter(map(zlib.crc32, ids), np.int64, len(ids))
                    key, none = some.column(0).fill_null(0).to_numpy(zero_copy_only=False), some.column(0).is_null().to_numpy(zero_copy_only=False)
                    low, high = np.searchsorted(edges, key, "left"), np.searchsorted(edges, key, "right")
                    place = np.where(none, 0, low + (mark * np.maximum(high - low, 1) >> 32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(place.astype(np.int32)), some.column(0), pa.array(mark), pa.array(ids, pa.binary())], ["place", "doc_id", "mark", "ids"]
                    )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "place int, doc_id long, mark long, ids binary")


def write_token_files(
    docs: DataFrame, tokenizer_path: str, out: str, end_id: int | None = 2, byte_planes: bool = True,
    partitions: int | None = None, block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encode ``docs(doc_id, text)`` in ascending doc_id order into token files under ``out``.

    Returns the manifest ``(part, seq, path, n_docs, n_ids)``, kept as Parquet beside the files: a
    retried or speculative task leaves only files that no manifest row names. Texts are encoded where
    they are read, and ids are dealt by ranges of doc_id, so that the files in (part, seq) order hold all
    documents in order. Null texts are empty, null keys come first, equal keys are ordered by a checksum
    of their ids, then the ids. A file closes after ``file_ids`` ids. No documents give no files.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = sorted(int(x) for x in keys.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()[0] or []) if n > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out)
        part, seq, tail = -1, 0, b"" if end_id is None else struct.pack("<I", end_id)
        writer = TokenFileWriter(byte_planes, block_ids)

        def close() -> pa.RecordBatch:
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.bps"
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(writer.finish())
            return pa.RecordBatch.from_pylist(
                [{"part": part, "seq": seq, "path": f"{out}/{name}", "n_docs": len(writer.docs), "n_ids": writer.n_ids}],
                schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

        store.create_dir(root, recursive=True)
        kind = "<u2" if narrow else "<u4"
        for batch in batches:
            for key, ids in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if part < 0:
                    part = batch.column(0)[0].as_py()
                writer.add(key, np.frombuffer(ids, kind).astype("<u4").tobytes() + tail)
                if writer.n_ids >= file_ids:
                    yield close()
                    writer, seq = TokenFileWriter(byte_planes, block_ids), seq + 1
        if writer.docs:
            yield close()

    from tokenizers import Tokenizer

    narrow = Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True) <= 1 << 16
    dealt = encoded(docs, tokenizer_path, cuts, narrow).repartitionById(n, "place")
    manifest = dealt.sortWithinPartitions("doc_id", "mark", "ids").select("place", "doc_id", "ids").mapInArrow(run, "part int, seq int, path string, n_docs long, n_ids long")
    with frugal(spark):
        manifest.write.parquet(f"{out}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{out}/manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents of the files in a manifest: ``doc_id, start, n_tokens, ids`` (little-endian binary).

    ``start`` counts the ids of all documents before it. The running sum is taken over one row a file.
    """
    spark = manifest.sparkSession
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = manifest.withColumn("base", F.sum("n_ids").over(order) - F.col("n_ids")).select("path", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                store, name = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(name) as f:
                    tokens = TokenFile(f, f.size())
                    for at in range(0, len(tokens.n), 500):
                        first, n = tokens.first[at : at + 500].astype(np.int64), tokens.n[at : at + 500].astype(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(tokens.keys[at : at + 500], pa.int64(), mask=tokens.null_keys[at : at + 500] == 1),
                                pa.array(first + row["base"]), pa.array(n),
                                pa.array([tokens.ids(int(a), int(b)).tobytes() for a, b in zip(first, n, strict=True)], pa.binary()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )

    dealt = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_store(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write ``docs`` as token files into the shared folder and read them back."""
    return read_token_files(write_token_files(docs, tokenizer_path, fresh_path(docs.sparkSession, "tokens")))
