"""Baseline JPEG: entropy decoding of many frames at once, and an encoder of flat blocks.

Restart intervals are independent of each other, so all intervals of all frames given
are decoded in step, one symbol of each at a time, as arrays. At full scale the
coefficients are transformed to pixels; at one eighth, each block gives its mean.

The encoder writes each sample as one flat 8 x 8 block: its mean alone is coded, with
a quantiser of eight, so the sample comes back exactly at either scale.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Fixed values of the format: the zigzag order and the typical luminance table for means (code counts by length; the values are 0 to 11).
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
COLUMNS, ROWS = 64, 8


# ---- tables ----------------------------------------------------------------------


def codes(counts: list[int], values: bytes) -> list[tuple[int, int, int]]:
    """(value, code, length) of a Huffman table."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((values[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(maxsize=64)
def lookup(counts: tuple[int, ...], values: bytes) -> np.ndarray:
    """For every 16 bits to come: code length, run, size, as three rows; length 0 is no code."""
    table = np.zeros((3, 1 << 16), np.int32)
    for value, code, length in codes(list(counts), values):
        at = slice(code << 16 - length, code + 1 << 16 - length)
        table[0, at], table[1, at], table[2, at] = length, value >> 4, value & 15
    return table


# ---- headers ---------------------------------------------------------------------


@dataclass(frozen=True)
class Frame:
    width: int
    height: int
    components: tuple[tuple[int, int, int, int, int, int], ...]  # id, h, v, quantiser, dc table, ac table
    quantisers: tuple[tuple[int, tuple[int, ...]], ...]
    tables: tuple[tuple[int, tuple[int, ...], bytes], ...]  # class and id, counts, values
    interval: int

    @property
    def coding(self) -> tuple:
        return self.components, self.tables


@lru_cache(maxsize=4096)
def parse_header(head: bytes) -> Frame:
    """A frame's segments from SOI up to the scan's first byte."""
    at, tables, quantisers, interval, size = 2, {}, {}, 0, None
    chosen: dict[int, tuple[int, int]] = {}
    while at < len(head):
        marker, n = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        body = head[at + 4 : at + 2 + n]
        if marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                q = np.frombuffer(body, ">u2" if wide else "u1", 64, 1)
                quantisers[k], body = tuple(map(int, q)), body[1 + (128 if wide else 64) :]
        elif marker == 0xC4:
            while body:
                counts = tuple(body[1:17])
                total = sum(counts)
                tables[body[0]], body = (counts, bytes(body[17 : 17 + total])), body[17 + total :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("samples must have eight bits")
            size = int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
        at += 2 + n
    if size is None or set(chosen) != {p[0] for p in parts}:
        raise ValueError("a frame needs one scan of all its components")
    return Frame(*size, tuple((*p, *chosen[p[0]]) for p in parts), tuple(sorted(quantisers.items())), tuple((k, *v) for k, v in sorted(tables.items())), interval)


def split_frame(data: bytes) -> tuple[Frame, int]:
    """A frame's header, and where its scan starts."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at = 2
    while data[at + 1] != 0xDA:
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return parse_header(data[:at]), at


# ---- decoding --------------------------------------------------------------------


def _mcu(f: Frame) -> tuple[list[int], int, int]:
    """The components of an MCU's blocks in order, and the numbers of MCUs across and down."""
    if len(f.components) == 1:
        return [0], -(-f.width // 8), -(-f.height // 8)
    h, v = max(c[1] for c in f.components), max(c[2] for c in f.components)
    return [i for i, c in enumerate(f.components) for _ in range(c[1] * c[2])], -(-f.width // (8 * h)), -(-f.height // (8 * v))


def decode_blocks(frames: list[bytes], full: bool) -> list[tuple[Frame, np.ndarray]]:
    """Per frame: its header and its blocks in coded order: quantised means (n), or with full all coefficients (n, 64)."""
    heads, out = [split_frame(x) for x in frames], [None] * len(frames)
    groups: dict[tuple, list[int]] = {}
    for i, (f, _) in enumerate(heads):
        groups.setdefault(f.coding, []).append(i)
    for members in groups.values():
        for i, blocks in zip(members, _decode_alike([(heads[i][0], memoryview(frames[i])[heads[i][1] :]) for i in members], full)):
            out[i] = (heads[i][0], blocks)
    return out


def _decode_alike(scans: list[tuple[Frame, memoryview]], full: bool) -> list[np.ndarray]:
    """Scans of frames with the same components and tables."""
    head = scans[0][0]
    order, _, _ = _mcu(head)
    raw = np.frombuffer(b"".join(s for _, s in scans), np.uint8)
    ends = np.cumsum([len(s) for _, s in scans])
    # markers: every 0xFF that isn't followed by 0
    escape = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[escape + 1]
    mark = escape[after != 0]
    if len(mark) == 0 or not np.isin(raw[mark + 1], np.r_[0xD0:0xD8, 0xD9]).all():
        raise ValueError("unexpected marker in a scan")
    keep = np.ones(len(raw), bool)
    keep[escape[after == 0] + 1] = False
    starts = np.concatenate([[0], mark + 2])
    is_end = raw[mark + 1] == 0xD9
    # what follows an end up to the next scan isn't an interval
    owner = np.searchsorted(ends, starts[:-1], side="right")
    first = np.concatenate([[True], is_end[:-1]])
    scan_start = np.concatenate([[0], ends[:-1]])
    starts = np.where(first, scan_start[owner], starts[:-1])
    clean = np.concatenate([raw[keep], np.zeros(8, np.uint8)])
    place = np.cumsum(keep) - keep
    lane_bit = place[starts].astype(np.int64) * 8
    total = []
    for f, _ in scans:
        blocks, across, down = _mcu(f)
        total.append(len(blocks) * across * down)
    total = np.array(total)
    per = np.array([(f.interval or 1 << 40) for f, _ in scans], np.int64) * len(order)
    lane_of = np.searchsorted(owner, np.arange(len(scans)))
    nth = np.arange(len(owner)) - lane_of[owner]
    todo = np.clip(total[owner] - nth * per[owner], 0, per[owner])
    base = np.concatenate([[0], np.cumsum(total)[:-1]])[owner] + np.minimum(nth * per[owner], total[owner])

    words = clean.astype(np.uint32)
    window = words[:-3] << 24 | words[1:-2] << 16 | words[2:-1] << 8 | words[3:]
    tables = {k: lookup(c, v) for k, c, v in head.tables}
    stack = np.concatenate([tables[k] for c in head.components for k in (c[4], 16 + c[5])], axis=1)
    comp = np.array(order)
    out = np.zeros((int(total.sum()), 64) if full else int(total.sum()), np.int32)
    zigzag = np.array(ZIGZAG)

    lanes = np.flatnonzero(todo > 0)
    bit, left, at = lane_bit[lanes], todo[lanes], base[lanes].astype(np.int64)
    k = np.zeros(len(lanes), np.int64)
    step = np.zeros(len(lanes), np.int64)
    means = np.zeros((len(head.components), len(lanes)), np.int32)
    one = len(order) == 1
    while len(bit):
        c = None if one else comp[step % len(order)]
        is_mean = k == 0
        table = (~is_mean).astype(np.int64) if one else 2 * c + ~is_mean
        window_at = window[bit >> 3] << (bit & 7).astype(np.uint32)
        entry = (table << 16) + (window_at >> np.uint32(16)).astype(np.int64)
        length, run, size = stack[0][entry], stack[1][entry], stack[2][entry]
        if not length.all():
            raise ValueError("a code that no table has")
        bit = bit + length
        ahead = window[bit >> 3] << (bit & 7).astype(np.uint32)
        value = (ahead.astype(np.uint64) >> (32 - size).astype(np.uint64)).astype(np.int64)
        value = np.where(value < (1 << size >> 1), value - (1 << size) + 1, value) * (size > 0)
        bit = bit + size
        # a mean: the difference from the component's last; else a coefficient after a run of zeros, or the block's end
        if one:
            means[0] += np.where(is_mean, value, 0).astype(np.int32)
            mean = means[0]
        else:
            rows = np.arange(len(bit))
            means[c, rows] += np.where(is_mean, value, 0).astype(np.int32)
            mean = means[c, rows]
        k = np.where(is_mean, 1, k + run + 1)
        ended = ~is_mean & (run < 15) & (size == 0)
        if full:
            where = np.where(is_mean, 0, np.minimum(k - 1, 63))
            put = is_mean | (size > 0)
            out[at[put], zigzag[where[put]]] = np.where(is_mean, mean, value)[put]
        elif is_mean.any():
            out[at[is_mean]] = mean[is_mean]
        done = ended | (k > 63)
        at, step, left = at + done, step + done, left - done
        k = np.where(done, 0, k)
        if done.any() and not left.all():
            alive = left > 0
            bit, at, step, left, k, means = bit[alive], at[alive], step[alive], left[alive], k[alive], means[:, alive]
    return np.split(out, np.cumsum(total)[:-1])


def _transform() -> np.ndarray:
    u, x = np.mgrid[0:8, 0:8]
    m = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    m[0] /= np.sqrt(2)
    return m


def component_planes(f: Frame, blocks: np.ndarray) -> list[np.ndarray]:
    """Each component's samples: at full scale from (n, 64) coefficients, at one eighth from n means."""
    order, across, down = _mcu(f)
    full, quantisers = blocks.ndim == 2, dict(f.quantisers)
    planes, at = [], 0
    by_mcu = blocks.reshape(across * down, len(order), *blocks.shape[1:])
    for comp in f.components:
        h, v = (comp[1], comp[2]) if len(f.components) > 1 else (1, 1)
        part = by_mcu[:, at : at + h * v]
        at += h * v
        if full:
            natural = np.zeros(64)
            natural[ZIGZAG] = quantisers[comp[3]]
            m = _transform()
            pixels = np.einsum("ux,nbuv,vy->nbxy", m, (part * natural).reshape(across * down, h * v, 8, 8), m) + 128
        else:
            pixels = (part * (quantisers[comp[3]][0] / 8) + 128)[..., None, None]
        side = pixels.shape[-1]
        plane = np.clip(np.rint(pixels), 0, 255).astype(np.uint8).reshape(down, across, v, h, side, side)
        planes.append(plane.transpose(0, 2, 4, 1, 3, 5).reshape(down * v * side, across * h * side))
    return planes


def decode(frames: list[bytes], scale: int = 1) -> list[list[np.ndarray]]:
    """The component planes of each frame, at full scale or, with scale 8, one sample per block."""
    if scale not in (1, 8):
        raise ValueError("scale is 1 or 8")
    return [component_planes(f, blocks) for f, blocks in decode_blocks(frames, scale == 1)]


# ---- encoding --------------------------------------------------------------------


@lru_cache(maxsize=1)
def _flat_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each difference of means from -255: the bits of a whole flat block, left-aligned in 16, and how many they are."""
    table = {value: (code, length) for value, code, length in codes(DC_COUNTS, bytes(range(12)))}
    bits, lengths = np.zeros(511, np.uint16), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, length = table[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        n = length + size + 1  # the block's end is one bit, 0
        bits[d + 255], lengths[d + 255] = (code << size | extra) << 1 << 16 - n, n
    return bits, lengths


@lru_cache(maxsize=64)
def flat_header(rows: int) -> bytes:
    segment = lambda marker, body: bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    size = (rows * 8).to_bytes(2, "big") + (COLUMNS * 8).to_bytes(2, "big")
    return b"".join(
        [
            b"\xff\xd8",
            segment(0xDB, bytes([0] + [8] * 64)),
            segment(0xC0, b"\x08" + size + bytes([1, 1, 0x11, 0])),
            segment(0xC4, bytes([0x00, *DC_COUNTS, *range(12)]) + bytes([0x10, 1, *[0] * 15, 0])),
            segment(0xDD, COLUMNS.to_bytes(2, "big")),
            segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def encode_flat(samples: np.ndarray, rows_of: list[int]) -> list[bytes]:
    """samples: rows of COLUMNS bytes; rows_of: the rows of each frame, in order. Each row is a restart interval."""
    code, length = _flat_codes()
    v = samples.astype(np.int32) - 128
    d = v.copy()
    d[:, 1:] -= v[:, :-1]
    n = np.empty((len(v), COLUMNS + 1), np.int64)
    n[:, :COLUMNS] = length[d + 255]
    n[:, COLUMNS] = -n[:, :COLUMNS].sum(1) % 8
    bits = np.full((len(v), COLUMNS + 1), 0xFFFF, ">u2")
    bits[:, :COLUMNS] = code[d + 255]
    spread = np.unpackbits(bits.view(np.uint8).reshape(-1, 2), axis=1)
    data = np.packbits(spread[np.arange(16) < n.reshape(-1, 1)])
    sizes = n.sum(1) // 8
    escaped = data == 0xFF
    more = np.add.reduceat(escaped, np.concatenate([[0], np.cumsum(sizes)[:-1]])) if len(sizes) else sizes
    row_end = np.cumsum(sizes + more + 2)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros(int(row_end[-1]) if len(row_end) else 0, np.uint8)
    out[np.arange(len(data)) + np.cumsum(escaped) - escaped + 2 * row] = data
    ends = np.cumsum(rows_of)
    in_frame = np.arange(len(sizes)) - np.repeat(ends - rows_of, rows_of)
    out[row_end - 2] = 0xFF
    out[row_end - 1] = 0xD0 + in_frame % 8
    out[row_end[ends - 1] - 1] = 0xD9
    whole = out.tobytes()
    stops = row_end[ends - 1].tolist()
    return [flat_header(r) + whole[a:b] for r, a, b in zip(rows_of, [0, *stops[:-1]], stops)]
