"""Baseline JPEG in numpy: whole-image transforms, Huffman codes fitted to the image."""

from __future__ import annotations

import heapq
import struct

import numpy as np

from rasterloom.sinks.png import draw

#: Quantisation at quality 50, luminance and chrominance, by rows.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    *[99] * 32,
)
QUALITY = 92
LONGEST = 16  #: bits of a code
ZERO_RUN, END = 0xF0, 0x00

#: Places of a block by rising diagonal, every other diagonal backwards.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _quantisers(quality: int) -> list[np.ndarray]:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMINANCE, CHROMINANCE)]


def _blocks(plane: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """Quantised coefficients, one row a block in zigzag order; edges are repeated up to whole blocks."""
    h, w = plane.shape
    plane = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
    tiles = plane.reshape(plane.shape[0] // 8, 8, plane.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)
    k = np.arange(8)
    dct = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    dct[0] /= np.sqrt(2)
    return np.rint((dct @ tiles @ dct.T).reshape(-1, 64) / quantiser).astype(np.int64)[:, ZIGZAG]


def _size(values: np.ndarray) -> np.ndarray:
    """Bits of the absolute value."""
    return np.ceil(np.log2(np.abs(values) + 1)).astype(np.int64)


def _lengths(counts: np.ndarray) -> dict[int, int]:
    """Code length of each symbol that occurs. One spare symbol takes the code of ones only, which is not allowed."""
    counts = {int(s): int(counts[s]) for s in np.flatnonzero(counts)}
    while True:
        heap = [(c, s, [s]) for s, c in counts.items()] + [(0, -1, [-1])]
        heapq.heapify(heap)
        depth = dict.fromkeys([*counts, -1], 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in (merged := a[2] + b[2]):
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), merged))
        if max(depth.values()) <= LONGEST:
            longest = max(depth.values())
            # The spare symbol is the rarest, so none is deeper and it may come last.
            return {s: d for s, d in sorted(depth.items(), key=lambda x: (x[1], x[0])) if s >= 0 and d <= longest}
        counts = {s: c // 2 + 1 for s, c in counts.items()}


def _table(kind: int, counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The segment's body, and code and length by symbol."""
    lengths = _lengths(counts)
    codes, bits, code, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s, n in lengths.items():
        code <<= n - last
        codes[s], bits[s], last = code, n, n
        code += 1
    per = [sum(n == i for n in lengths.values()) for i in range(1, LONGEST + 1)]
    return bytes([kind, *per, *lengths]), codes, bits


def encode(rgb: np.ndarray, quality: int = QUALITY) -> bytes:
    """An (h, w, 3) array of 8-bit RGB as baseline JPEG, all planes in full resolution."""
    h, w = rgb.shape[:2]
    if not (0 < h < 65536 and 0 < w < 65536):
        raise ValueError(f"a JPEG can't be {w} x {h}")
    r, g, b = np.moveaxis(rgb[..., :3].astype(np.float64), -1, 0)
    luma = 0.299 * r + 0.587 * g + 0.114 * b
    quantisers = _quantisers(quality)
    planes = [(luma - 128, 0), ((b - luma) / 1.772, 1), ((r - luma) / 1.402, 1)]
    rows = np.stack([_blocks(p, quantisers[q]) for p, q in planes], axis=1)  # (blocks, planes, 64)
    first = np.diff(rows[:, :, 0], axis=0, prepend=0)
    rows = rows.reshape(-1, 64)
    chroma = np.arange(len(rows)) % 3 > 0

    # What is written, as (block, place, symbol, value): differences of means, runs of 16 zeros, coefficients, ends.
    block, place = np.nonzero(rows[:, 1:])
    value = rows[:, 1:][block, place]
    before = np.where(np.diff(block, prepend=-1) != 0, -1, np.concatenate(([-1], place[:-1])))
    zeros = place - before - 1
    long = np.repeat(np.arange(len(block)), zeros // 16)
    final = np.full(len(rows), -1)
    final[block] = place
    open_ = np.flatnonzero(final < 62)
    mean = first.reshape(-1)
    at = np.concatenate((np.arange(len(rows)) * 256, block[long] * 256 + place[long] * 2 + 1, block * 256 + place * 2 + 2, open_ * 256 + 255))
    symbol = np.concatenate((_size(mean), np.full(len(long), ZERO_RUN), zeros % 16 * 16 + _size(value), np.full(len(open_), END)))
    number = np.concatenate((mean, np.zeros(len(long), np.int64), value, np.zeros(len(open_), np.int64)))
    order = np.argsort(at, kind="stable")
    at, symbol, number = at[order], symbol[order], number[order]
    is_mean, kind = at % 256 == 0, chroma[at // 256].astype(int)

    segments, code, bits = [], np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for ac in (0, 1):
        for plane in (0, 1):
            here = (is_mean == (ac == 0)) & (kind == plane)
            body, codes, lengths = _table(ac * 16 + plane, np.bincount(symbol[here], minlength=256))
            segments.append(body)
            code[here], bits[here] = codes[symbol[here]], lengths[symbol[here]]
    size = _size(number)
    code = (code << size) | np.where(number < 0, number + (1 << size) - 1, number)
    bits += size
    ends = np.cumsum(bits)
    which = np.repeat(np.arange(len(bits)), bits)
    stream = (code[which] >> (ends[which] - 1 - np.arange(ends[-1]))) & 1
    stream = np.concatenate((stream, np.ones(-len(stream) % 8, np.int64))).astype(np.uint8)
    data = np.packbits(stream).tobytes().replace(b"\xff", b"\xff\x00")

    part = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    out += b"".join(part(0xDB, bytes([i, *q[ZIGZAG].tolist()])) for i, q in enumerate(quantisers))
    out += part(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]))
    out += b"".join(part(0xC4, s) for s in segments)
    return out + part(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])) + data + b"\xff\xd9"


def preview(traced, width: int | None = None, background: str | None = None, quality: int = QUALITY) -> bytes:
    """An anti-aliased preview on ``background``, white if none is given."""
    return encode(draw(traced, width, background or "#ffffff", smooth=True), quality)
