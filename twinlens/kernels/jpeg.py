"""A baseline JPEG encoder in arrays (K1). Decoding is left to the JVM, see ``sources.images.normalised``."""

from __future__ import annotations

import heapq
import struct

import numpy as np

# The sample quantisation tables of the standard, brightness and colour, row by row.
BRIGHTNESS = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
COLOUR = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]

#: Places of a block, read along its diagonals in alternating direction.
ZIGZAG = np.array([y * 8 + x for y, x in sorted(np.ndindex(8, 8), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])


def _table(base: list[int], quality: int) -> np.ndarray:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255).astype(np.int64)


def _code_lengths(count: np.ndarray) -> dict[int, int]:
    """Lengths of at most 16 bits of an optimal code; a symbol 256 keeps the code of all ones free."""
    while True:
        heap = [(int(n), s, (s,)) for s, n in enumerate(count) if n] + [(0, 256, (256,))]
        length = dict.fromkeys((s for _, s, _ in heap), 0)
        heapq.heapify(heap)
        while len(heap) > 1:
            (n, s, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            for x in a + b:
                length[x] += 1
            heapq.heappush(heap, (n + m, s, a + b))
        if max(length.values()) <= 16:
            return length
        count = np.where(count > 0, (count + 1) // 2, 0)


def _huffman(symbols: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table's definition, and code and length of each symbol."""
    length = _code_lengths(np.bincount(symbols, minlength=256))
    order = sorted(length, key=lambda s: (length[s], s))
    code, size, at, last = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64), 0, 0
    for s in order:
        at <<= length[s] - last
        last = length[s]
        if s < 256:
            code[s], size[s] = at, last
        at += 1
    real = [s for s in order if s < 256]
    return bytes([sum(length[s] == k for s in real) for k in range(1, 17)]) + bytes(real), code, size


def _bits(values: np.ndarray, lengths: np.ndarray) -> bytes:
    which = np.repeat(np.arange(len(values)), lengths)
    place = np.repeat(np.cumsum(lengths), lengths) - 1 - np.arange(len(which))
    bits = (values[which] >> place) & 1
    bits = np.concatenate((bits, np.ones(-len(bits) % 8, dtype=bits.dtype)))
    return np.packbits(bits.astype(np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def _size(v: np.ndarray) -> np.ndarray:
    """Bits that a number's magnitude takes."""
    return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)


def _scan(blocks: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Tables and data of one plane's quantised blocks (blocks x 64, along the diagonals)."""
    n = len(blocks)
    step = np.diff(blocks[:, 0], prepend=0)
    row, k = np.nonzero(blocks[:, 1:])
    k += 1
    value = blocks[row, k]
    run = k - np.where(np.append(True, row[1:] != row[:-1]), 0, np.append(0, k[:-1])) - 1 if len(k) else k
    long = run // 16  # runs of sixteen zeros are symbols of their own
    last = np.zeros(n, dtype=np.int64)
    np.maximum.at(last, row, k)
    short = np.flatnonzero(last < 63)
    wide = np.repeat(np.arange(len(k)), long)
    # (block, place, kind) orders the symbols: a step first, then long runs, values and the end
    block = np.concatenate((np.arange(n), row[wide], row, short))
    place = np.concatenate((np.zeros(n, dtype=np.int64), k[wide], k, np.full(len(short), 64)))
    kind = np.concatenate((np.zeros(n), np.zeros(len(wide)), np.ones(len(k)), np.zeros(len(short))))
    amount = np.concatenate((step, np.zeros(len(wide), dtype=np.int64), value, np.zeros(len(short), dtype=np.int64)))
    size = _size(amount)
    symbol = np.concatenate((size[:n], np.full(len(wide), 0xF0), (run % 16) * 16 + size[n + len(wide) : n + len(wide) + len(k)], np.zeros(len(short), dtype=np.int64)))
    first = np.arange(len(symbol)) < n
    dc, dc_code, dc_size = _huffman(symbol[first])
    ac, ac_code, ac_size = _huffman(symbol[~first])
    code, length = np.where(first, dc_code[symbol], ac_code[symbol]), np.where(first, dc_size[symbol], ac_size[symbol])
    extra = np.where(amount < 0, amount + (1 << size) - 1, amount)
    by = np.lexsort((kind, place, block))
    return dc, ac, _bits(((code << size) | extra)[by], (length + size)[by])


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def jpeg_encode(rgb: np.ndarray, quality: int = 92, orientation: int | None = None) -> bytes:
    """Full colour resolution, one scan a plane; ``orientation`` adds an EXIF tag."""
    h, w = rgb.shape[:2]
    r, g, b = (rgb[:, :, i].astype(np.float64) for i in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [y - 128, (b - y) / 1.772, (r - y) / 1.402]
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos(np.pi * k * (2 * x + 1) / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    tables = [_table(BRIGHTNESS, quality), _table(COLOUR, quality)]
    out = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    if orientation:
        out += _segment(0xE1, b"Exif\0\0II*\0" + struct.pack("<IHHHIHHI", 8, 1, 274, 3, 1, orientation, 0, 0))
    for i, t in enumerate(tables):
        out += _segment(0xDB, bytes([i]) + bytes(t[ZIGZAG].tolist()))
    out += _segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes([i + 1, 0x11, min(i, 1)]) for i in range(3)))
    for i, plane in enumerate(planes):
        p = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
        blocks = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        level = (basis @ blocks @ basis.T).reshape(-1, 64) / tables[min(i, 1)]
        dc, ac, data = _scan(np.rint(level).astype(np.int64)[:, ZIGZAG])
        out += _segment(0xC4, b"\x00" + dc) + _segment(0xC4, b"\x10" + ac) + _segment(0xDA, bytes([1, i + 1, 0x00, 0, 63, 0])) + data
    return out + b"\xff\xd9"
