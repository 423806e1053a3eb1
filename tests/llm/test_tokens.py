import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peptrail.llm.shared import WordCache
from peptrail.llm import bpe, gif_media, token_store

ODD = ["", None, " ", "a", "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "it's WE'RE 'S", "a\x1cb\x1f", "Σσς İß ŉ", "é é", "日本語 한글", "\U0001f600", "x" * 5000, "ab " * 20000, "1²Ⅷ٣", " a　b\xa0c\xad"]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_encoders_equal_the_library(tokenizer_path):
    lib, own, cached = library(tokenizer_path), bpe.SpeculativeBpe(tokenizer_path), token_store.LibraryEncoder(tokenizer_path)
    r = random.Random(4)
    texts = [*ODD, *("".join(r.choice("etaoinshrdlu ETé'’.,12<|>") for _ in range(r.randint(0, 80))) for _ in range(500))]
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids_of(b) for b in own.encode_bytes(texts)] == want
    assert [ids_of(b) for b in cached.encode_bytes(texts)] == want
    assert [own.decode_bytes(b) for b in own.encode_bytes(texts)] == [lib.decode(i, skip_special_tokens=False).encode() for i in want]
    assert own.merged_words > 0  # speculation fails on some words, so exact merging is covered


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_encoder_on_any_text(tokenizer_path, texts):
    lib = library(tokenizer_path)
    assert [ids_of(b) for b in bpe.codec(tokenizer_path).encode_bytes(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_small_cache_gives_the_same(tokenizer_path):
    a, b = bpe.SpeculativeBpe(tokenizer_path), bpe.SpeculativeBpe(tokenizer_path)
    a.words.half = a.chunks.half = 400
    texts = ["some words here", "other words", "and yet more of them", "Ωmega and øther words", "漢字 かな"] * 3
    for text in texts:
        assert a.encode_bytes([text]) == b.encode_bytes([text])


def test_caches_are_bounded_in_bytes(tokenizer_path):
    cache = WordCache(4 << 20)
    for n, at in enumerate(range(0, 5_000_000, 20_000)):  # five million distinct words
        words = {f"w{k}" for k in range(at, at + 20_000)}
        held = cache.holding(words, lambda new: [b"1234" * 2] * len(new))
        assert words <= held.keys()
        if n % 25 == 0:
            assert cache.bytes() < (4 << 20) + 20_000 * 200
    coder, r = bpe.SpeculativeBpe(tokenizer_path), random.Random(5)
    for _ in range(20):  # texts without white space: nothing long is kept
        coder.encode_bytes(["".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(20_000)), "abcdefgh" * 10_000])
    coder.encode_bytes(["a b"])
    assert coder.chunks.bytes() + coder.words.bytes() < 1 << 20


def test_words_are_cut_as_the_library_cuts(tokenizer_path):
    lib, r = library(tokenizer_path), random.Random(7)
    letters = "abcdefst're'vemlld  \n\t'''.,;0123²¼ÀéßſŸ×÷\xa0\x85ªŒ-"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(800)] + ["it's 'tis we'll've''s 's", "don't 'RE 'Ve'M"]
    coders = token_store.LibraryEncoder(tokenizer_path), bpe.SpeculativeBpe(tokenizer_path)
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    for c in coders:
        assert [ids_of(c.encode_bytes([t])[0]) for t in texts] == want
        assert [ids_of(b) for b in c.encode_bytes(texts)] == want


def test_long_words_and_pieces(tokenizer_path, monkeypatch):
    lib, r = library(tokenizer_path), random.Random(8)
    texts = ["x" * 5000, "ab" * 3000 + "q", "".join(r.choice("etaoin") for _ in range(6000)), "Éa" * 2500]
    assert [ids_of(b) for b in bpe.SpeculativeBpe(tokenizer_path).encode_bytes(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(bpe, "PIECE_BYTES", 50)
    monkeypatch.setattr(bpe, "PIECE_WORDS", 3)
    texts = ["some words that go on and on, with no end in sight; " * 20, "漢字 かな \x1c" * 9, "no" * 100 + " spaces"]
    assert [ids_of(b) for b in bpe.SpeculativeBpe(tokenizer_path).encode_bytes(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_encode_decode_query(docs_of, tokenizer_path):
    docs = docs_of([(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (None, "x")])
    got = bpe.digests(bpe.encode_decode(docs, tokenizer_path)).collect()
    lib = library(tokenizer_path)
    assert len(got) == len(ODD) + 2
    for r in got:
        text = "x" if r.doc_id is None else ODD[r.doc_id] or ""
        ids = lib.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode_decode(docs.limit(0), tokenizer_path).count() == 0


@pytest.mark.parametrize("byte_planes", [True, False])
def test_planes_and_files(byte_planes):
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 100):
        ids = r.integers(0, 2**32, n, np.uint64).astype("<u4")
        assert token_store.from_planes(token_store.to_planes(ids, byte_planes), n).tolist() == ids.tolist()
    writer = token_store.TokenFileWriter(byte_planes, block_ids=16)
    given_ids = [r.integers(0, 50_000, int(n)).astype("<u4") for n in (0, 5, 40, 16, 1, 0)]
    for k, ids in enumerate(given_ids):
        writer.add(None if k == 1 else k, ids.tobytes())
    data = writer.finish()
    back = token_store.TokenFile(io.BytesIO(data), len(data))
    assert [back.ids(int(a), int(n)).tolist() for a, n in zip(back.first, back.n)] == [i.tolist() for i in given_ids]
    assert back.null_keys.tolist() == [0, 1, 0, 0, 0, 0] and back.ids(3, 30).tolist() == np.concatenate(given_ids)[3:33].tolist()
    broken = bytearray(data)
    broken[12] ^= 255
    with pytest.raises(Exception):
        bad = token_store.TokenFile(io.BytesIO(bytes(broken)), len(broken))
        [bad.ids(int(a), int(n)) for a, n in zip(bad.first, bad.n)]


def test_token_store_round_trip(spark, docs_of, tokenizer_path):
    rows = [(i, f"text number {i} " * (i % 5)) for i in range(40)] + [(7, "again"), (None, "no id"), (50, None), (51, "")]
    got = token_store.token_store(docs_of(rows), tokenizer_path).collect()
    lib, start = library(tokenizer_path), 0
    mark = lambda text: zlib.crc32(np.array(lib.encode(text or "", add_special_tokens=False).ids, "<u2").tobytes())
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, mark(r[1])))
    have = sorted(got, key=lambda r: r.start)
    assert len(have) == len(rows)
    for (key, text), r in zip(ordered, have):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, ids_of(r.ids)) == (key, start, len(ids), ids)
        start += len(ids)
    assert token_store.token_store(docs_of(rows).limit(0), tokenizer_path).count() == 0


def test_one_id_with_many_rows_is_dealt(spark, docs_of, tokenizer_path):
    rows = [(7, f"text {i}") for i in range(200)] + [(i, "x") for i in range(5)] + [(9, "y")]
    got = sorted(token_store.token_store(docs_of(rows), tokenizer_path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows) and len({tuple(ids_of(r.ids)) for r in got if r.doc_id == 7}) == 200
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def test_small_files_and_blocks(spark, docs_of, tokenizer_path):
    from peptrail.llm.shared import fresh_path

    docs = docs_of([(i, "a b c d e " * i) for i in range(30)])
    manifest = token_store.write_token_files(docs, tokenizer_path, fresh_path(spark, "t"), byte_planes=False, partitions=3, block_ids=8, file_ids=100)
    assert manifest.count() > 6
    back = {r.doc_id: (r.start, r.n_tokens) for r in token_store.read_token_files(manifest).collect()}
    assert back == {i: (sum(5 * j + 1 for j in range(i)), 5 * i + 1) for i in range(30)}


# -- GIF


def bits(codes):
    """Codes of given widths, lowest bit first."""
    acc = at = 0
    for code, width in codes:
        acc |= code << at
        at += width
    return acc.to_bytes(-(-at // 8), "little")


def plain_lzw(data):
    """LZW as the format describes it, a table of strings."""
    out, table, width, held = [(256, 9)], {bytes([k]): k for k in range(256)}, 9, b""
    free = seen = 0
    free = 258
    for k in range(len(data)):
        grown = held + data[k : k + 1]
        if grown in table:
            held = grown
            continue
        out.append((table[held], width))
        if free < 4094:
            table[grown] = free
            free += 1
            width = max(9, (free - 1).bit_length())
        else:
            out.append((256, 12))
            table, width, free = {bytes([j]): j for j in range(256)}, 9, 258
        held = data[k : k + 1]
    if held:
        out.append((table[held], width))
        width = max(9, free.bit_length())
    return bits([*out, (257, width)])


def test_lzw_round_trips():
    r = random.Random(2)
    for k in range(60):
        data = bytes(r.choice([0, 1, 2, 255]) if k % 2 else r.randrange(256) for _ in range(r.randint(0, 2000)))
        assert gif_media.lzw_decode(gif_media.lzw_compress(data), 8, len(data)).tobytes() == data
    big = np.random.default_rng(0).integers(0, 3, 60_000, np.uint8).tobytes()
    assert gif_media.lzw_decode(gif_media.lzw_compress(big), 8, len(big)).tobytes() == big
    for odd in (b"", b"\0" * 200_000, np.random.default_rng(0).integers(0, 256, 60_000, np.uint8).tobytes()):
        assert gif_media.lzw_decode(gif_media.lzw_compress(odd), 8, len(odd)).tobytes() == odd
        assert gif_media.lzw_compress(odd) == plain_lzw(odd)
    assert gif_media.lzw_decode(gif_media.lzw_compress(b"abc"), 8, 5).tobytes() == b"abc\0\0"
    # literal codes only, a clear before each row; and a table that fills up and stays
    rows = bytes(range(192)) * 5
    assert gif_media.lzw_decode(bits([(256 if k % 193 == 0 else rows[k - k // 193 - 1], 9) for k in range(193 * 5)] + [(257, 9)]), 8, len(rows)).tobytes() == rows
    long = bytes(r.randrange(256) for _ in range(30_000))
    full = [(256, 9)] + [(v, int(w)) for v, w in zip(long, gif_media._widths(len(long), 8))]
    assert gif_media.lzw_decode(bits(full), 8, len(long)).tobytes() == long
    for bad in (bits([(256, 9), (300, 9)]), bits([(256, 9), (65, 9), (259, 9)])):
        with pytest.raises(ValueError):
            gif_media.lzw_decode(bad, 8, 10)
    with pytest.raises(ValueError):
        gif_media.lzw_decode(b"abc", 1, 10)
    small = bytes(r.randrange(4) for _ in range(500))
    assert gif_media.lzw_decode(gif_media.lzw_compress(small, 2), 2, 500).tobytes() == small


def test_disposal_and_transparency():
    palette = np.zeros((256, 3), np.uint8)
    palette[1], palette[2] = (255, 0, 0), (0, 255, 0)
    full, patch = np.full((4, 4), 1, np.uint8), np.array([[2, 0], [0, 2]], np.uint8)
    for disposal, after in ((1, (0, 255, 0)), (2, (0, 0, 0)), (3, (255, 0, 0))):
        first = gif_media.encode_gif([full], palette, disposal=1, size=(4, 4))
        second = gif_media.encode_gif([patch, np.zeros((1, 1), np.uint8)], palette, disposal=disposal, transparent=0, offsets=[(1, 1), (0, 0)], size=(4, 4))
        data = first[:-1] + second[13 + 768 :]
        frames = [(f.canvas.copy(), f.opaque.copy()) for f in gif_media.decode_gif(data)]
        assert len(frames) == 3
        assert frames[1][0][1, 1].tolist() == [0, 255, 0] and frames[1][0][1, 2].tolist() == [255, 0, 0]
        assert frames[2][0][1, 1].tolist() == list(after) and bool(frames[2][1][1, 1]) == (disposal != 2)
    assert gif_media.histogram(next(gif_media.decode_gif(first))).sum() == 16


def test_interlaced_rows():
    image = np.arange(10, dtype=np.uint8).repeat(10).reshape(10, 10)
    order = [*range(0, 10, 8), *range(4, 10, 8), *range(2, 10, 4), *range(1, 10, 2)]
    data = bytearray(gif_media.encode_gif([image[order]]))
    at = data.index(b"\x2c", 13 + 768)
    data[at + 9] |= 64
    assert next(gif_media.decode_gif(bytes(data))).indices.tolist() == image.tolist()


def test_media_query(docs_of):
    texts = [*ODD, "y" * 192, "z" * 193, "long " * 40_000, "y" * 192]
    got = {r.doc_id: r for r in gif_media.media_columns(docs_of(list(enumerate(texts))), keep_media=True).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-16:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    a, b = got[len(texts) - 4], got[len(texts) - 1]
    assert (a.feature, a.media_sha256) == (b.feature, b.media_sha256)
    long = got[len(texts) - 2]
    assert len(long.frames) == 3 and [f.start_ms for f in long.frames] == [0, 100, 200] and all(f.delay_ms == 100 for f in long.frames)
    level = lambda c: c.astype(int) * 4 // 256
    frame = 192 * 512
    seen = level(gif_media.PALETTE[np.frombuffer(("long " * 40_000).encode(), np.uint8)[:frame]])
    assert np.array_equal(long.frames[0].colours, np.bincount(seen @ [16, 4, 1], minlength=64))
    assert [sum(f.colours) for f in long.frames] == [frame] * 3  # the whole picture at that time
    assert long.feature == "rgb64:" + ",".join(map(str, np.sum([f.colours for f in long.frames], 0))) + ";ms:300"
    assert gif_media.media_columns(docs_of([])).count() == 0


def test_frames_of_foreign_files(spark):
    sound = gif_media.encode_gif([np.full((2, 3), k, np.uint8) for k in range(4)], delay_cs=7)
    big = bytearray(sound)
    big[6:10] = b"\xff\xff\xff\xff"
    rows = [(1, sound), (2, sound[:-30]), (3, b"no picture"), (4, None), (5, bytes(big)), (None, sound), (1, sound), (6, sound[:200])]
    got = gif_media.frame_rows(spark.createDataFrame([(k, None if d is None else bytearray(d)) for k, d in rows], "doc_id long, media binary")).collect()
    assert sorted((r.frame, r.start_ms, r.delay_ms) for r in got if r.doc_id == 1) == sorted([(k, 70 * k, 70) for k in range(4)] * 2)
    assert [sum(r.colours) for r in got if r.doc_id is None] == [6] * 4
    errors = {r.doc_id: r.error for r in got if r.error}
    assert set(errors) == {2, 3, 5, 6} and errors[3] == "not a GIF" and "cut" in errors[6] and "pixels" in errors[5]


def test_gif_streams_far_longer_than_their_frame_take_little_memory(spark):
    """A stream of millions of samples for a frame of few: what is not asked for is not made; and frames past the guard."""
    import tracemalloc

    from peptrail.llm import gif_media as gm

    stream = gm.lzw_compress(bytes(20_000_000))
    tracemalloc.start()
    assert not gm.lzw_decode(stream, 8, 1_000).any()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * len(stream) + 4_000_000
    for n in (0, 1, 254, 255, 256, 70_000):
        data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)
        for asked in {0, n // 2, n, n + 9}:
            assert gm.lzw_decode(gm.lzw_compress(data.tobytes()), 8, asked).tobytes() == (data.tobytes() + bytes(9))[:asked]
    media = spark.createDataFrame([(1, gm.encode_gif([np.zeros((40, 50), np.uint8)]))], "doc_id long, media binary")
    assert gm.frame_rows(media, most_pixels=100).first().error and not gm.frame_rows(media, most_pixels=None).first().error
    assert gm.frame_rows(media.limit(0)).count() == 0
