"""GIF media columns: lossless storage of bytes as frames, LZW decoding, compositing and colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.llm.shared import text_groups

ROW = 192  # samples a row of a stored payload
FRAME_ROWS = 512  # rows a frame of a stored payload
MOST_PIXELS = 1 << 26  # of a canvas or frame that is decoded


def _colours() -> np.ndarray:
    """A palette of 256 colours: three bits of red, three of green, two of blue, spread over their range."""
    k = np.arange(256)
    return np.stack([(k >> 5) * 255 // 7, (k >> 2 & 7) * 255 // 7, (k & 3) * 85], 1).astype(np.uint8)


PALETTE = _colours()


@dataclass
class Frame:
    """One composited picture: RGB canvas (alpha apart), its time, and the rectangle that this frame drew."""

    canvas: np.ndarray
    opaque: np.ndarray
    delay_ms: int
    left: int
    top: int
    indices: np.ndarray
    palette: np.ndarray


# -- LZW -------------------------------------------------------------------------------------------

MOST_CODES = 4096


def _widths(n: int, min_size: int) -> np.ndarray:
    """Bits of the first n codes after a clear code: a table entry comes with each code but the first."""
    size = (1 << min_size) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.ceil(np.log2(size + 0.5)).astype(np.int64), min_size + 1, 12)


_WIDTHS = {size: _widths(2 * MOST_CODES, size) for size in range(2, 9)}


def _packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of up to 12 bits one after another, lowest bit first."""
    end = np.cumsum(widths)
    at = end - widths
    out = np.zeros(int(end[-1]) // 8 + 4, np.uint8)
    word = codes.astype(np.uint32) << (at & 7).astype(np.uint32)
    for k in range(3):  # bits of different codes never meet, so sums of bytes are unions
        out += np.bincount((at >> 3) + k, (word >> np.uint32(8 * k)) & np.uint32(255), len(out)).astype(np.uint8)
    return out[: (int(end[-1]) + 7) // 8].tobytes()


def _unpacked(raw: np.ndarray, at: int, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many whole codes of these widths as there are from bit ``at`` on, and the bits where they end."""
    end = at + np.cumsum(widths)
    n = int(np.searchsorted(end, 8 * (len(raw) - 3), side="right"))  # three spare bytes follow the stream
    end, start = end[:n], end[:n] - widths[:n]
    byte = start >> 3
    word = raw[byte].astype(np.uint32) | raw[byte + 1].astype(np.uint32) << np.uint32(8) | raw[byte + 2].astype(np.uint32) << np.uint32(16)
    return ((word >> (start & 7).astype(np.uint32)) & ((1 << widths[:n]) - 1).astype(np.uint32)).astype(np.int64), end


def lzw_compress(samples: bytes, min_size: int = 8) -> bytes:
    """LZW stream of samples under ``1 << min_size``; the table is cleared once it is full."""
    clear = 1 << min_size
    runs: list[list[int]] = []
    run: list[int] = []
    if samples:
        table: dict[int, int] = {}
        known, put = table.get, run.append
        free, most = clear + 2, MOST_CODES - 2
        code = samples[0]
        for sample in memoryview(samples)[1:]:
            key = code << 8 | sample
            longer = known(key)
            if longer is not None:
                code = longer
                continue
            put(code)
            code = sample
            if free < most:
                table[key] = free
                free += 1
            else:
                runs.append(run)
                run = []
                put = run.append
                table.clear()
                free = clear + 2
        put(code)
    runs.append(run)
    codes, widths = [np.array([clear])], [np.array([min_size + 1])]
    for k, run in enumerate(runs):
        codes.append(np.array([*run, clear if k + 1 < len(runs) else clear + 1], np.int64))
        widths.append(_WIDTHS[min_size][: len(codes[-1])])
    return _packed(np.concatenate(codes), np.concatenate(widths))


def _expanded(codes: np.ndarray, min_size: int, most: int) -> np.ndarray:
    """Samples of the codes between two clear codes; those after the code that reaches ``most`` samples are left out.

    A table entry is a code's entry and one sample more, so entries are chains of parents: their first
    samples and lengths come by doubling the steps, their samples from the last one back.
    """
    base = (1 << min_size) + 2
    made = min(len(codes) - 1, MOST_CODES - base)
    parent = np.arange(base + made)
    parent[base:] = codes[:made]
    if (codes > base - 1 + np.minimum(np.arange(len(codes)), made)).any() or (codes[0] >= base) or ((codes == base - 1) | (codes == base - 2)).any():
        raise ValueError("an LZW code outside the table")
    root, steps = parent.copy(), (parent != np.arange(len(parent))).astype(np.int64)
    while True:
        further = root[root]
        if np.array_equal(further, root):
            break
        steps += steps[root]
        root = further
    sample = root.copy()
    sample[base:] = root[codes[1 : made + 1]]  # an entry's last sample is the first one of the code that follows
    size = steps[codes] + 1
    end = np.cumsum(size)
    if end[-1] > most:
        codes, end = (x[: int(np.searchsorted(end, most)) + 1] for x in (codes, end))
    out = np.empty(int(end[-1]), np.uint8)
    at, code = end - 1, codes
    while len(code):
        out[at] = sample[code]
        more = code >= base
        at, code = at[more] - 1, parent[code[more]]
    return out


def lzw_decode(data: bytes, min_size: int, n: int) -> np.ndarray:
    """The first ``n`` samples of an LZW stream; missing ones are 0, as decoders show a cut stream."""
    if not 2 <= min_size <= 8:
        raise ValueError("an LZW code size outside 2 to 8")
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    clear, at, made, out = 1 << min_size, 0, 0, []
    widths = _WIDTHS[min_size]
    while made < n:
        codes, ends = _unpacked(raw, at, widths)
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        whole = len(codes) == len(widths)
        while whole and not len(stops) and len(codes) < n:  # a table that stays full: codes stay 12 bits wide
            more, far = _unpacked(raw, int(ends[-1]), np.full(len(codes), 12))
            whole = len(more) == len(codes)
            codes, ends = np.r_[codes, more], np.r_[ends, far]
            stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(stops[0]) if len(stops) else len(codes)
        if stop:
            out.append(_expanded(codes[:stop], min_size, n - made))
            made += len(out[-1])
        if not len(stops) or codes[stop] == clear + 1:
            break
        at = int(ends[stop])
    got = np.concatenate([*out, np.zeros(max(0, n - made), np.uint8)])
    return got[:n]


# -- container -------------------------------------------------------------------------------------


def _blocks(data: bytes) -> bytes:
    whole = len(data) // 255
    head = np.full((whole, 256), 255, np.uint8)
    head[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return head.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode_gif(
    frames: list[np.ndarray], palette: np.ndarray = PALETTE, delay_cs: int = 10, disposal: int = 1,
    transparent: int | None = None, offsets: list[tuple[int, int]] | None = None, size: tuple[int, int] | None = None,
) -> bytes:
    """A GIF of index arrays (rows x columns, 8 bits) with one palette of 256 colours."""
    height, width = size or (max(f.shape[0] for f in frames), max(f.shape[1] for f in frames))
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.astype(np.uint8).tobytes()]
    for k, f in enumerate(frames):
        left, top = offsets[k] if offsets else (0, 0)
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay_cs, transparent or 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, left, top, f.shape[1], f.shape[0], 0, 8))
        out.append(_blocks(lzw_compress(f.tobytes())))
    return b"".join([*out, b"\x3b"])


def decode_gif(data: bytes, most_pixels: int | None = MOST_PIXELS) -> Iterator[Frame]:
    """Composited frames of a GIF, with its palettes, interlacing, transparency and disposal applied.

    The canvas of a frame may be written to by the next one: copy what is to be kept. A file that is no
    GIF, is cut, breaks its format or has a canvas or frame of over ``most_pixels`` is a ValueError, raised
    where it is met.
    """
    try:
        yield from _frames(data, most_pixels)
    except (IndexError, struct.error) as e:
        raise ValueError("a GIF that is cut") from e


def _frames(data: bytes, most_pixels: int | None) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, packed, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if most_pixels is not None and width * height > most_pixels:
        raise ValueError("a GIF of too many pixels")

    def palette_at(at: int, packed: int) -> tuple[np.ndarray | None, int]:
        n = 3 * (2 << (packed & 7)) if packed & 128 else 0
        if at + n > len(data):
            raise ValueError("a GIF that is cut")
        return (np.frombuffer(data, np.uint8, n, at).reshape(-1, 3) if n else None), at + n

    table, at = palette_at(13, packed)
    canvas, opaque = np.zeros((height, width, 3), np.uint8), np.zeros((height, width), bool)
    disposal, delay, clear_index = 0, 0, None
    while data[at] != 0x3B:
        mark = data[at]
        if mark == 0x21:
            label, at = data[at + 1], at + 2
            if label == 0xF9 and data[at] >= 4:
                flags, delay, index = struct.unpack_from("<BHB", data, at + 1)
                disposal, clear_index = flags >> 2 & 7, index if flags & 1 else None
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        if mark != 0x2C:
            raise ValueError("unknown block in a GIF")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        own, at = palette_at(at + 10, packed)
        palette = table if own is None else own
        if palette is None:
            raise ValueError("a frame without a palette")
        if most_pixels is not None and w * h > most_pixels:
            raise ValueError("a GIF of too many pixels")
        min_size, at, parts = data[at], at + 1, []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += data[at] + 1
        at += 1
        image = lzw_decode(b"".join(parts), min_size, w * h).reshape(h, w)
        if packed & 64:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            plain = np.empty_like(image)
            plain[order] = image
            image = plain
        kept = (canvas.copy(), opaque.copy()) if disposal == 3 else None
        box = (slice(top, min(top + h, height)), slice(left, min(left + w, width)))
        shown = image[: max(0, height - top), : max(0, width - left)]
        colours = palette[np.minimum(shown, len(palette) - 1)]
        if clear_index is None:
            canvas[box], opaque[box] = colours, True
        else:
            draw = shown != clear_index
            canvas[box][draw] = colours[draw]
            opaque[box] |= draw
        yield Frame(canvas, opaque, delay * 10, left, top, image, palette)
        if disposal == 2:
            canvas[box], opaque[box] = 0, False
        elif kept:
            canvas, opaque = kept
        disposal, delay, clear_index = 0, 0, None


def histogram(frame: Frame, bins: int = 4) -> np.ndarray:
    """Counts of a frame's opaque pixels by ``bins`` levels of each of red, green and blue."""
    level = (np.arange(256) * bins // 256).astype(np.int32)
    red, green, blue = (level[frame.canvas[..., c]] for c in range(3))
    place = (red * bins + green) * bins + blue
    return np.bincount(place.reshape(-1) if frame.opaque.all() else place[frame.opaque], minlength=bins**3)


def timed_frames(media: bytes, bins: int = 4, most_pixels: int | None = MOST_PIXELS) -> list[tuple[int, int, list[int]]]:
    """When each frame of a GIF begins and how long it shows, in ms, and its colour histogram."""
    out, start = [], 0
    for frame in decode_gif(media, most_pixels):
        out.append((start, frame.delay_ms, histogram(frame, bins).tolist()))
        start += frame.delay_ms
    return out


def frame_rows(media: DataFrame, key: str = "doc_id", column: str = "media", bins: int = 4, most_pixels: int | None = MOST_PIXELS) -> DataFrame:
    """``key, frame, start_ms, delay_ms, colours, error``: a row a frame of each GIF of ``media(key, column)``.

    What is no sound GIF gives one row with its error and nulls, and so does one with a canvas or frame of over
    ``most_pixels``, which guards a worker's memory: None takes any size. A null gives none; rows of one key keep
    their frames each; an empty table gives no rows. No shuffle.
    """
    kind = media.schema[key].dataType.simpleString()
    names = [key, "frame", "start_ms", "delay_ms", "colours", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                data = batch.column(1)[at].as_py()
                if data is None:
                    continue
                try:
                    rows = [(k, *frame, None) for k, frame in enumerate(timed_frames(data, bins, most_pixels))]
                except ValueError as e:
                    rows = [(None, None, None, None, str(e))]
                number, start, delay, colours, error = zip(*rows, strict=True) if rows else ((),) * 5
                keys = pa.array([batch.column(0)[at].as_py()] * len(rows), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(delay, pa.int32()), pa.array(colours, pa.list_(pa.int64())), pa.array(error, pa.string())], names
                )

    return media.select(key, column).mapInArrow(run, f"`{key}` {kind}, frame int, start_ms long, delay_ms int, colours array<long>, error string")


# -- payloads --------------------------------------------------------------------------------------


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with spaces to a positive multiple of ``ROW``; and their number without padding."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % ROW or (0 if raw else ROW)), len(raw)


def store_payload(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return encode_gif([rows[at : at + FRAME_ROWS] for at in range(0, len(rows), FRAME_ROWS)])


def read_payload(media: bytes) -> tuple[bytes, list[tuple[int, int, list[int]]]]:
    """Payload of a stored GIF, and each frame's start and time in ms and its colour histogram.

    Samples are the palette's places of the composited colours inside each frame's rectangle.
    """
    parts, frames, start = [], [], 0
    for frame in decode_gif(media):
        h, w = frame.indices.shape
        shown = frame.canvas[frame.top : frame.top + h, frame.left : frame.left + w]
        place = _PLACE[0][shown[..., 0]] | _PLACE[1][shown[..., 1]] | _PLACE[2][shown[..., 2]]
        parts.append(place.tobytes())
        frames.append((start, frame.delay_ms, histogram(frame).tolist()))
        start += frame.delay_ms
    return b"".join(parts), frames


def _places() -> np.ndarray:
    """What a level of red, green and blue says of a colour's place in the palette."""
    out = np.zeros((3, 256), np.uint8)
    k = np.arange(256)
    for channel, bits in enumerate((0xE0, 0x1C, 0x03)):
        out[channel][PALETTE[:, channel]] = k & bits
    return out


_PLACE = _places()


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Store each text of ``docs(doc_id, text)`` as a GIF, read it back, and describe it.

    Returns ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, frames`` and, on request, ``media``. Frames are structs of ``start_ms, delay_ms, colours``, the
    last one counts in 64 bins of red, green and blue; feature is the sum of those over all frames and the
    playing time. A null or empty text is one row of spaces; rows are independent (no shuffle), repeated and
    null ids keep their rows, equal texts give equal values, an empty table gives none.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames"]
    frame_kind = pa.struct([("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("colours", pa.list_(pa.int64()))])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(frame_kind)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_groups(batch):
                rows = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    payload, n = payload_of(text)
                    media = store_payload(payload)
                    back, frames = read_payload(media)
                    total = np.sum([colours for _, _, colours in frames], 0).tolist()
                    feature = "rgb64:" + ",".join(map(str, total)) + f";ms:{sum(delay for _, delay, _ in frames)}"
                    shown = [{"start_ms": start, "delay_ms": delay, "colours": colours} for start, delay, colours in frames]
                    rows.append((
                        key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media),
                        hashlib.sha256(media).hexdigest(), feature, shown, *([media] if keep_media else []),
                    ))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds + [pa.binary()] * keep_media, strict=True)], names + ["media"] * keep_media
                )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<struct<start_ms:long,delay_ms:int,colours:array<long>>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema + ", media binary" * keep_media)
