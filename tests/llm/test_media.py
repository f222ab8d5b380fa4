import hashlib
import random
import zlib

import numpy as np

from palimpsest.llm import jpeg, media

AC = [(run << 4 | size) for run in range(16) for size in range(0, 11) if size or run in (0, 15)]
AC_COUNTS = [0] * 7 + [120] + [0] * 7 + [len(AC) - 120]


def put(out, table, symbol, value=0, size=0):
    code, n = next((c, n) for v, c, n in table if v == symbol)
    out.append(format(code, f"0{n}b"))
    if size:
        out.append(format(value if value > 0 else value + (1 << size) - 1, f"0{size}b"))


def encode_by_hand(blocks_of, width, height, sampling, interval):
    """blocks_of: per MCU and block in order, 64 quantised coefficients in zigzag order."""
    dc = jpeg.codes(jpeg.DC_COUNTS, bytes(range(12)))
    ac = jpeg.codes(AC_COUNTS, bytes(AC))
    order = [i for i, (h, v) in enumerate(sampling) for _ in range(h * v)] if len(sampling) > 1 else [0]
    scan, bits, last, marker = b"", [], [0] * len(sampling), 0

    def close():
        s = "".join(bits)
        s += "1" * (-len(s) % 8)
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\x00")

    mcus = [blocks_of[i : i + len(order)] for i in range(0, len(blocks_of), len(order))]
    for m, mcu in enumerate(mcus):
        if interval and m and m % interval == 0:
            scan += close() + bytes([0xFF, 0xD0 + marker % 8])
            bits, last, marker = [], [0] * len(sampling), marker + 1
        for c, b in zip(order, mcu):
            d = int(b[0]) - last[c]
            last[c] = int(b[0])
            put(bits, dc, abs(d).bit_length(), d, abs(d).bit_length())
            run = 0
            stop = max([i for i in range(64) if b[i]], default=0)
            for v in map(int, b[1 : stop + 1]):
                if not v:
                    run += 1
                    continue
                while run > 15:
                    put(bits, ac, 0xF0)
                    run -= 16
                put(bits, ac, run << 4 | abs(v).bit_length(), v, abs(v).bit_length())
                run = 0
            if stop < 63:
                put(bits, ac, 0)
    segment = lambda k, body: bytes([0xFF, k]) + (len(body) + 2).to_bytes(2, "big") + body
    head = b"\xff\xd8" + segment(0xDB, bytes([0, *range(1, 65)])) + segment(0xE0, b"JFIF\0")
    head += segment(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(sampling)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    head += segment(0xC4, bytes([0, *jpeg.DC_COUNTS, *range(12)])) + segment(0xC4, bytes([0x10, *AC_COUNTS, *AC]))
    head += segment(0xDD, interval.to_bytes(2, "big")) if interval else b""
    head += segment(0xDA, bytes([len(sampling)]) + b"".join(bytes([i + 1, 0]) for i in range(len(sampling))) + b"\0\x3f\0")
    return head + scan + close() + b"\xff\xd9"


def pixels_by_hand(b):
    freq = np.zeros((8, 8))
    for i, z in enumerate(jpeg.ZIGZAG):
        freq[z // 8, z % 8] = int(b[i]) * (i + 1)
    scale = lambda u: 1 / np.sqrt(2) if u == 0 else 1.0
    out = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            out[y, x] = sum(scale(u) * scale(v) * freq[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4
    return np.clip(np.rint(out + 128), 0, 255)


def test_decodes_general_baseline_frames():
    rnd = np.random.default_rng(6)
    frames, wants = [], []
    for sampling, width, height, interval in (([(1, 1)], 24, 16, 0), ([(1, 1)], 24, 16, 2), ([(2, 2), (1, 1), (1, 1)], 32, 16, 0), ([(2, 1), (1, 1), (1, 1)], 30, 13, 1)):
        h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
        per = sum(a * b for a, b in sampling) if len(sampling) > 1 else 1
        n = -(-width // (8 * h)) * -(-height // (8 * v)) * per
        blocks = np.where(rnd.random((n, 64)) < 0.15, rnd.integers(-9, 10, (n, 64)), 0)
        blocks[:, 0] = rnd.integers(-60, 60, n)
        blocks[0, 63] = 3
        frames.append(encode_by_hand(list(blocks), width, height, sampling, interval))
        wants.append((blocks, sampling))
    for (f, got), (blocks, sampling) in zip(jpeg.decode_blocks(frames, True), wants):
        zig = np.zeros_like(blocks)
        zig[:, jpeg.ZIGZAG] = blocks
        assert np.array_equal(got, zig)
    for (f, got), (blocks, _) in zip(jpeg.decode_blocks(frames, False), wants):
        assert np.array_equal(got, blocks[:, 0])
    plane = jpeg.decode(frames[:1])[0][0]
    assert plane.shape == (16, 24)
    for i, b in enumerate(wants[0][0]):
        y, x = divmod(i, 3)
        assert np.abs(plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] - pixels_by_hand(b)).max() <= 1
    assert [p.shape for p in jpeg.decode(frames[2:3])[0]] == [(16, 32), (8, 16), (8, 16)]


def test_payloads_come_back_and_frames_are_flat():
    rnd = random.Random(1)
    texts = [None, "", "a", "é" * 40, "\xff" * 700, "x" * 64, "".join(chr(rnd.randrange(1, 0xD000)) for _ in range(5000)), bytes(range(256)).decode("latin-1") * 9]
    payloads = [media.payload(t) for t in texts]
    assert all(len(p) and len(p) % 64 == 0 for p in payloads)
    files = media.store_payloads(payloads)
    for p, f, (planes, fps) in zip(payloads, files, media.decode_samples(files)):
        assert b"".join(q.tobytes() for q in planes) == p and fps == 25
        whole = jpeg.decode(media.read_avi(f)[0])
        assert all(np.array_equal(np.repeat(np.repeat(a, 8, 0), 8, 1), b[0]) for a, b in zip(planes, whole))
        # without its index, the file reads the same
        assert media.read_avi(f[: f.rindex(b"idx1")])[0] == media.read_avi(f)[0]


def test_shots_follow_planted_scenes():
    rnd = np.random.default_rng(2)
    scene = lambda lo, n: [np.clip(rnd.normal(lo, 6, (8, 64)), 0, 255).astype(np.uint8) for _ in range(n)]
    planes = scene(40, 6) + scene(150, 5) + scene(90, 7)
    assert [(a, b) for a, b, *_ in media.clips(planes, 25.0)] == [(0, 6), (6, 11), (11, 18)]
    assert [(a, b) for a, b, *_ in media.clips(scene(40, 1) + scene(150, 1), 25.0)] == [(0, 1), (1, 2)]
    assert [(a, b) for a, b, *_ in media.clips(scene(40, 5) + scene(150, 1) + scene(90, 5), 25.0)] == [(0, 5), (5, 6), (6, 11)]
    assert media.clips(planes, 25.0)[1][2:4] == (240, 440) and media.clips([], 25.0) == []


def test_operator_on_odd_rows(spark):
    rows = [(1, None, 1), (None, "", 1), (2, "long " * 60_000, 1), (3, "same", 1), (3, "same", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, media int")
    stored = media.texts_to_media(df)
    got = media.digests(stored).collect()
    for r in got:
        text = {1: "", None: "", 2: rows[2][1], 3: "same"}[r.doc_id]
        p = media.payload(text)
        assert (r.n_bytes, r.payload_bytes) == (len(text), len(p)) and r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-64:])
    assert len(got) == 5 and len({(r.media_sha256, r.feature) for r in got if r.doc_id == 3}) == 1
    clips = media.clip_rows(stored).where("doc_id = 2").orderBy("clip").collect()
    assert clips[0].start_ms == 0 and all(a.end_ms == b.start_ms for a, b in zip(clips, clips[1:]))
    assert media.digests(media.texts_to_media(df.limit(0))).count() == 0
