"""A baseline JPEG encoder in NumPy: all blocks of an image are transformed and coded at once."""

from __future__ import annotations

import struct

import numpy as np

#: Quantisers of quality 50, lightness and colour, by row.
_LIGHT = "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"
_COLOR = "17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99" + " 99" * 36
QUANTISERS = [np.array(list(map(int, t.split()))).reshape(8, 8) for t in (_LIGHT, _COLOR)]
#: Codes of each length 1..16, and the symbols in order of their codes: of sizes of means, and of (run, size) of the rest.
DC = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))
AC = [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], [
    *bytes.fromhex("0102030004110512213141061351610722711432 8191a1082342b1c11552d1f02433627282090a161718191a"),
    *(r << 4 | s for r in range(2, 16) for s in range({2: 5, 3: 4, 9: 2, 10: 2, 11: 2, 12: 2, 13: 2, 14: 1, 15: 1}.get(r, 3), 11)),
]
_DCT = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _codes(table: tuple[list[int], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of every symbol."""
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    at, k = 0, 0
    for bits, n in enumerate(table[0], 1):
        for symbol in table[1][k : k + n]:
            code[symbol], length[symbol] = at, bits
            at += 1
        k, at = k + n, at << 1
    return code, length


_DC, _AC = _codes(DC), _codes(AC)


def _size(v: np.ndarray) -> np.ndarray:
    """Binary digits of |v|."""
    return np.frexp(np.abs(v))[1].astype(np.int64)


def quantisers(quality: int) -> list[np.ndarray]:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((q * scale + 50) // 100, 1, 255) for q in QUANTISERS]


def _scan(blocks: np.ndarray) -> bytes:
    """Entropy-coded data of quantised blocks [block, component, 64] in zigzag order."""
    n, parts, _ = blocks.shape
    means = np.diff(blocks[:, :, 0], axis=0, prepend=np.zeros((1, parts), np.int64)).reshape(-1)
    flat = blocks.reshape(n * parts, 64)
    block, pos = np.nonzero(flat[:, 1:])
    pos, value = pos + 1, flat[block, pos + 1]
    fresh = np.append(True, block[1:] != block[:-1]) if len(block) else np.zeros(0, bool)
    run = pos - np.where(fresh, 0, np.append(0, pos[:-1])[: len(pos)]) - 1
    last = np.zeros(len(flat), np.int64)
    last[block] = pos  # positions ascend, so the last one stays
    zeros = np.repeat(np.arange(len(block)), run // 16)
    ends = np.flatnonzero(last < 63)
    # tokens by block and place: means, runs of 16 zeros, values, ends of blocks
    where = np.concatenate([np.arange(len(flat)) * 200, block[zeros] * 200 + pos[zeros] * 2, block * 200 + pos * 2 + 1, ends * 200 + 199])
    symbol = np.concatenate([_size(means), np.full(len(zeros), 0xF0), (run % 16) << 4 | _size(value), np.zeros(len(ends), np.int64)])
    extra = np.concatenate([means, np.zeros(len(zeros), np.int64), value, np.zeros(len(ends), np.int64)])
    mean = np.arange(len(where)) < len(flat)
    code, length = (np.where(mean, a[symbol], b[symbol]) for a, b in zip(_DC, _AC))
    size = _size(extra)
    token = code << size | np.where(extra < 0, extra + (1 << size) - 1, extra)
    order = np.argsort(where, kind="stable")
    token, length = token[order], (length + size)[order]
    # a token, of 27 bits at most, lies in five bytes; tokens share bytes but no bits, so bytes are sums
    ends = np.cumsum(length)
    first, total = ends - length, int(ends[-1])
    parts = (token << 40 - (first & 7) - length)[:, None] >> np.arange(32, -1, -8) & 255
    out = np.bincount(((first >> 3)[:, None] + np.arange(5)).ravel(), parts.ravel()).astype(np.uint8)[: -(-total // 8)]
    out[-1] |= (1 << -total % 8) - 1
    return out.tobytes().replace(b"\xff", b"\xff\x00")


def encode(image: np.ndarray, quality: int = 75) -> bytes:
    """Grey (one channel) or RGB, all channels at full resolution."""
    h, w, n = image.shape
    grey = n == 3 and (image[:, :, :1] == image[:, :, 1:]).all()
    planes = image.astype(float)
    if grey:  # its colours are nothing in every block
        planes = 0.299 * planes[:, :, :1] + 0.587 * planes[:, :, :1] + 0.114 * planes[:, :, :1]
    elif n == 3:
        r, g, b = np.moveaxis(planes, 2, 0)
        planes = np.stack([0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b], axis=2)
    elif n != 1:
        raise ValueError("a JPEG image is grey or has three channels")
    planes = np.pad(planes, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge") - 128
    rows, columns = planes.shape[0] // 8, planes.shape[1] // 8
    blocks = planes.reshape(rows, 8, columns, 8, -1).transpose(0, 2, 4, 1, 3)
    steps = quantisers(quality)
    own = np.stack([steps[min(c, 1)] for c in range(planes.shape[2])])
    coded = np.zeros((rows * columns, n, 64), np.int64)
    coded[:, : len(own)] = np.rint(_DCT @ blocks @ _DCT.T / own).reshape(rows * columns, -1, 64)[:, :, ZIGZAG]

    part = lambda mark, body: struct.pack(">BBH", 255, mark, len(body) + 2) + body
    out = [b"\xff\xd8", part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    out += [part(0xDB, bytes([k]) + bytes(steps[k].reshape(-1)[ZIGZAG].tolist())) for k in range(min(n, 2))]
    out.append(part(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([c + 1, 0x11, min(c, 1)]) for c in range(n))))
    out += [part(0xC4, bytes([k, *table[0], *table[1]])) for k, table in ((0x00, DC), (0x10, AC))]
    out.append(part(0xDA, bytes([n, *(x for c in range(n) for x in (c + 1, 0)), 0, 63, 0])))
    return b"".join([*out, _scan(coded), b"\xff\xd9"])
