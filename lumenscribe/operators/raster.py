"""Pixel kernels in NumPy: filling, backgrounds, turning, waves, scaling, blur, pasting, PNG.

Images are arrays [row, column, channel] of uint8; RGBA for text, RGB for masks. They
run inside render's Arrow batches, a sample at a time.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Callable

import numpy as np

from lumenscribe.functions.draws import plain_u32

MODES = {"L": 1, "RGB": 3, "RGBA": 4}


def draw(seed: int, key: int, tag: str) -> np.random.Generator:
    """A generator of its own for each sample and purpose, wherever it runs."""
    return np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}:{tag}:{key}".encode(), usedforsecurity=False).digest()[:8], "big"))


def fill(contours: list[np.ndarray], width: int, height: int, detail: int = 4) -> np.ndarray:
    """Coverage 0..1 of closed outlines (points x, y in pixels, y downwards), by the non-zero rule."""
    edges = [np.hstack([c, np.roll(c, -1, axis=0)]) for c in contours if len(c) > 2]
    if not edges or not width or not height:
        return np.zeros((height, width), np.float32)
    x1, y1, x2, y2 = (np.concatenate(edges) * detail).T
    # every edge crosses the rows whose middles lie between its ends
    top, bottom = np.ceil(np.minimum(y1, y2) - 0.5).astype(int), np.ceil(np.maximum(y1, y2) - 0.5).astype(int)
    top, bottom = np.clip(top, 0, height * detail), np.clip(bottom, 0, height * detail)
    n = bottom - top
    e = np.repeat(np.arange(len(n)), n)
    row = top[e] + np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)
    x = x1[e] + (row + 0.5 - y1[e]) * (x2[e] - x1[e]) / (y2[e] - y1[e])
    order = np.lexsort((x, row))
    row, x, way = row[order], np.clip(np.rint(x[order]), 0, width * detail).astype(int), np.where(y2 > y1, 1, -1)[e][order]
    # outlines are closed, so a row's crossings add up to nothing and rows can share a sum
    winding = np.cumsum(way)
    inside = np.flatnonzero((winding[:-1] != 0) & (row[1:] == row[:-1]))
    steps = np.zeros((height * detail, width * detail + 1), np.int32)
    np.add.at(steps, (row[inside], x[inside]), 1)
    np.add.at(steps, (row[inside], x[inside + 1]), -1)
    area = (np.cumsum(steps, axis=1)[:, :-1] > 0).astype(np.float32)
    return area.reshape(height, detail, width, detail).mean(axis=(1, 3))


def gaussian_noise(height: int, width: int, rng: np.random.Generator) -> np.ndarray:
    """Paper: grey of mean 235, deviation 10."""
    return np.clip(np.rint(rng.normal(235, 10, (height, width))), 0, 255).astype(np.uint8)


def plain_white(height: int, width: int) -> np.ndarray:
    return np.full((height, width), 255, np.uint8)


def quasicrystal(height: int, width: int, rng: np.random.Generator) -> np.ndarray:
    """The mean of 10 to 20 turned plane waves."""
    frequency, phase, turns = rng.random() * 30 + 20, rng.random() * 2 * math.pi, int(rng.integers(10, 21))
    y, x = (np.linspace(-2 * math.pi, 2 * math.pi, n) if n > 1 else np.zeros(1) for n in (width, height))
    # a turned plane wave is cos(u + v), u of the row and v of the column alone: all waves are one product of matrices
    a = np.arange(turns) * math.pi * 2 / turns
    u, v = x[:, None] * np.sin(a) * frequency + phase, np.cos(a)[:, None] * y * frequency
    z = np.hstack([np.cos(u), -np.sin(u)]) @ np.vstack([np.cos(v), np.sin(v)])
    return (255 - np.rint(255 * z / turns)).astype(np.int64).clip(0, 255).astype(np.uint8)


def picture(height: int, width: int, source: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A random piece of a picture, enlarged first if it is too small."""
    h, w = source.shape[:2]
    if w < width:
        source = resize(source, width, int(h * (width / w)))
        h, w = source.shape[:2]
    if h < height:
        source = resize(source, int(w * (height / h)), height)
        h, w = source.shape[:2]
    y, x = int(rng.integers(0, h - height + 1)), int(rng.integers(0, w - width + 1))
    return source[y : y + height, x : x + width]


def rgba(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        image = np.repeat(image[:, :, None], 3, axis=2)
    if image.shape[2] == 4:
        return image
    return np.concatenate([image, np.full((*image.shape[:2], 1), 255, np.uint8)], axis=2)


def _lanczos(size: int, new: int) -> np.ndarray:
    """Weights [new, size] of a three-lobed Lanczos filter."""
    scale = max(size / new, 1.0)
    at = ((np.arange(new) + 0.5) * size / new)[:, None]
    x = (np.arange(size)[None, :] + 0.5 - at) / scale
    w, near = np.zeros(x.shape), np.abs(x) < 3
    w[near] = np.sinc(x[near]) * np.sinc(x[near] / 3)
    return (w / w.sum(1, keepdims=True)).astype(np.float32)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    flat = image if image.ndim == 3 else image[:, :, None]
    h, w, n = flat.shape
    out = (_lanczos(h, height) @ flat.astype(np.float32).reshape(h, w * n)).reshape(height, w, n)
    out = _lanczos(w, width) @ out
    out = np.clip(np.rint(out), 0, 255).astype(np.uint8)
    return out if image.ndim == 3 else out[:, :, 0]


def resize_nearest(image: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = image.shape[:2]
    return image[((np.arange(height) + 0.5) * h / height).astype(int)[:, None], ((np.arange(width) + 0.5) * w / width).astype(int)]


def blur(image: np.ndarray, radius: float) -> np.ndarray:
    """Gaussian blur with that standard deviation; edges are repeated."""
    if radius <= 0:
        return image
    k = max(1, math.ceil(radius * 3))
    w = np.exp(-((np.arange(-k, k + 1) / radius) ** 2) / 2)
    w /= w.sum()
    same, planes = distinct_planes(image)
    for axis in (1, 2):
        at = np.clip(np.arange(-k, planes.shape[axis] + k), 0, planes.shape[axis] - 1)
        padded = planes.take(at, axis=axis)
        part = lambda j: padded[:, j : j + image.shape[0]] if axis == 1 else padded[:, :, j : j + image.shape[1]]  # noqa: E731, B023
        planes = w[0] * part(0)
        for j in range(1, 2 * k + 1):
            planes += w[j] * part(j)
    return np.rint(planes).clip(0, 255).astype(np.uint8)[same].transpose(1, 2, 0)


def distinct_planes(image: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Which plane each channel is, and the planes as numbers: channels that are alike, as those of grey, are worked on once."""
    same, kept = [], []
    for c in range(image.shape[2]):
        own = image[:, :, c]
        at = next((k for k, other in enumerate(kept) if (own == other).all()), len(kept))
        same.append(at)
        if at == len(kept):
            kept.append(own)
    return same, np.array(kept, np.float64)


def turned_size(width: int, height: int, angle: float) -> tuple[int, int]:
    c, s = abs(math.cos(math.radians(angle))), abs(math.sin(math.radians(angle)))
    return math.ceil(round(width * c + height * s, 6)), math.ceil(round(width * s + height * c, 6))


def turn(image: np.ndarray, angle: float, smooth: bool) -> np.ndarray:
    """Turned anticlockwise about the middle on a canvas that holds all of it."""
    if angle == 0:
        return image
    h, w = image.shape[:2]
    nw, nh = turned_size(w, h, angle)
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    dy, dx = (np.arange(nh) + 0.5 - nh / 2)[:, None], (np.arange(nw) + 0.5 - nw / 2)[None, :]
    sx, sy = dx * c - dy * s + w / 2 - 0.5, dx * s + dy * c + h / 2 - 0.5
    if not smooth:
        pad = np.zeros((h + 2, w + 2, image.shape[2]), image.dtype)
        pad[1:-1, 1:-1] = image
        return pad[(np.rint(sy).astype(int) + 1).clip(0, h + 1), (np.rint(sx).astype(int) + 1).clip(0, w + 1)]
    x0, y0 = np.floor(sx), np.floor(sy)
    near = ((x0 >= -2) & (x0 <= w) & (y0 >= -2) & (y0 <= h)).ravel().nonzero()[0]  # the others lie outside of the image
    sx, sy, x0, y0 = (v.ravel()[near] for v in (sx, sy, x0, y0))
    same, planes = distinct_planes(image)
    pad = np.zeros((len(planes), h + 6, w + 6))
    pad[:, 3:-3, 3:-3] = planes
    at = (y0 + 2).astype(int) * (w + 6) + (x0 + 2).astype(int)
    pad = pad.reshape(len(planes), -1)
    cubic = lambda t: (((-t + 2) * t - 1) * t / 2, ((3 * t - 5) * t * t + 2) / 2, ((-3 * t + 4) * t + 1) * t / 2, (t - 1) * t * t / 2)
    wx, wy, found = cubic(sx - x0), cubic(sy - y0), 0
    for j in range(4):
        row = 0
        for i in range(4):
            row = row + wx[i] * pad[:, j * (w + 6) + i :].take(at, axis=1)
        found = found + wy[j] * row
    out = np.zeros((len(planes), nh * nw), np.uint8)
    out[:, near] = np.rint(found).clip(0, 255)
    return out.reshape(-1, nh, nw)[same].transpose(1, 2, 0)


def turn_boxes(boxes: np.ndarray, angle: float, width: int, height: int) -> np.ndarray:
    """[n, x1 y1 x2 y2] around the turned boxes."""
    if angle == 0 or not len(boxes):
        return boxes
    nw, nh = turned_size(width, height, angle)
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    x, y = boxes[:, [0, 2, 2, 0]] - width / 2, boxes[:, [1, 1, 3, 3]] - height / 2
    tx, ty = x * c + y * s + nw / 2, y * c - x * s + nh / 2
    return np.stack([tx.min(1), ty.min(1), tx.max(1), ty.max(1)], axis=1)


def offsets(kind: str | Callable[[int], float], n: int, reach: int, seed: int = 0, key: object = None, axis: str = "down") -> np.ndarray:
    """geometry.wave_offset of places 0 .. n-1, or a function's values, within the reach."""
    if callable(kind):
        return np.clip(np.trunc([kind(at) for at in range(n)]), -reach, reach).astype(int)
    if kind == "jitter":
        return np.array([plain_u32(seed, f"jitter-{axis}", f"{key}.{at}") % (reach + 1) for at in range(n)], int)
    return np.trunc(np.round({"sin": np.sin, "cos": np.cos}[kind](np.radians(np.arange(n))) * reach, 9)).astype(int)


def reach_of(kind: str, height: int) -> int:
    return int(height**0.4) if kind == "jitter" else int(math.sqrt(height))


def wave(image: np.ndarray, reach: int, down: np.ndarray | None, right: np.ndarray | None) -> np.ndarray:
    """Columns shifted down and rows to the right; the canvas grows by twice the reach."""
    if down is not None:
        h, w = image.shape[:2]
        out = np.zeros((h + 2 * reach, w, image.shape[2]), image.dtype)
        rows = np.arange(h)[:, None] + reach + down[None, :w]
        out[rows, np.arange(w)[None, :]] = image
        image = out
    if right is not None:
        h, w = image.shape[:2]
        out = np.zeros((h, w + 2 * reach, image.shape[2]), image.dtype)
        out[np.arange(h)[:, None], np.arange(w)[None, :] + reach + right[:h, None]] = image
        image = out
    return image


def wave_boxes(boxes: np.ndarray, reach: int, down: np.ndarray | None, right: np.ndarray | None) -> np.ndarray:
    """Boxes around the corners, moved as their pixels are; places are truncated."""
    if not len(boxes):
        return boxes
    x, y = boxes[:, [0, 2, 2, 0]].astype(int), boxes[:, [1, 1, 3, 3]].astype(int)
    ny, nx = y.copy(), x.copy()
    if down is not None:
        ny += reach + down[np.clip(x, 0, len(down) - 1)]
    if right is not None:
        nx += reach + right[np.clip(ny, 0, len(right) - 1)]
    return np.stack([nx.min(1), ny.min(1), nx.max(1), ny.max(1)], axis=1).astype(float)


def arch(width: int, amplitude: int) -> np.ndarray:
    return np.trunc(amplitude * np.sin(np.arange(width) * math.pi / width)).astype(int)


def curve(image: np.ndarray, amplitude: int) -> np.ndarray:
    """Columns lowered along an arch."""
    h, w = image.shape[:2]
    out = np.zeros((h + abs(amplitude), w, image.shape[2]), image.dtype)
    out[np.arange(h)[:, None] + np.maximum(arch(w, amplitude), 0)[None, :], np.arange(w)[None, :]] = image
    return out


def curve_boxes(boxes: np.ndarray, amplitude: int, width: int) -> np.ndarray:
    if not len(boxes):
        return boxes
    off = arch(width, amplitude)[np.clip(((boxes[:, 0] + boxes[:, 2]) / 2).astype(int), 0, width - 1)]
    return boxes + np.stack([0 * off, off, 0 * off, off], axis=1)


def too_alike(text: np.ndarray, mask: np.ndarray, background: np.ndarray) -> bool:
    """Whether a text's ink is too near its background to be read; also if there is no ink.

    Of the ink two channels count over three, of the background all four: so by the
    rule a white or noisy background is never too near.
    """
    ink = mask[:, :, 2] > 0
    if not ink.any():
        return True
    weight = mask[:, :, 2].astype(float)
    mean = (text[:, :, :2] * weight[:, :, None]).sum((0, 1)) / weight.sum()
    return abs(mean.sum() / 3 - rgba(background).mean(axis=(0, 1)).sum() / 3) < 15


def paste(canvas: np.ndarray, image: np.ndarray, x: int, y: int) -> None:
    """Lay an RGBA image over a canvas, in place; an RGB one replaces what is there."""
    h, w = canvas.shape[:2]
    top, left, bottom, right = max(y, 0), max(x, 0), min(y + image.shape[0], h), min(x + image.shape[1], w)
    if top >= bottom or left >= right:
        return
    part, under = image[top - y : bottom - y, left - x : right - x], canvas[top:bottom, left:right]
    if image.shape[2] == 3:
        under[:] = part
        return
    alpha = part[:, :, 3:].astype(float) / 255
    under[:] = np.rint(part * alpha + under * (1 - alpha)).astype(np.uint8)


def converted(image: np.ndarray, mode: str) -> np.ndarray:
    if mode not in MODES and mode != "1":
        raise ValueError(f"no such image mode: {mode}")
    if mode == "RGBA":
        return rgba(image)
    if mode == "RGB":
        return image[:, :, :3]
    grey = (image[:, :, 0].astype(int) * 299 + image[:, :, 1].astype(int) * 587 + image[:, :, 2].astype(int) * 114 + 500) // 1000
    return np.where(grey > 127, 255, 0).astype(np.uint8)[:, :, None] if mode == "1" else grey.astype(np.uint8)[:, :, None]


def mask_color(k: int) -> tuple[int, int, int]:
    """The colour of glyph k, of 65024 at most."""
    return k // 65025, k // 255 % 256, k % 255


def ink_extents(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(k, minx, miny, maxx, maxy) of every glyph of a mask, in one pass over the pixels."""
    y, x = np.nonzero(mask.any(axis=2))
    if not len(y):
        return []
    p = mask[y, x].astype(np.int64)
    codes, at = np.unique(p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2], return_inverse=True)
    low, high = np.full((2, len(codes)), 1 << 30), np.full((2, len(codes)), -1)
    for axis, v in enumerate((x, y)):
        np.minimum.at(low[axis], at, v)
        np.maximum.at(high[axis], at, v)
    green, blue = codes >> 8 & 255, codes & 255
    out = [(int(green[j] * 255 + blue[j]), int(low[0, j]), int(low[1, j]), int(high[0, j]), int(high[1, j])) for j in range(len(codes))]
    return sorted(out)


def outline(image: np.ndarray, boxes: list[tuple[int, int, int, int]], color: tuple[int, ...] = (0, 128, 0)) -> None:
    """Draw boxes' edges, in place."""
    h, w = image.shape[:2]
    for x1, y1, x2, y2 in boxes:
        x1, x2, y1, y2 = max(x1, 0), min(x2, w - 1), max(y1, 0), min(y2, h - 1)
        image[[y1, y2], x1 : x2 + 1, :3] = color[:3]
        image[y1 : y2 + 1, [x1, x2], :3] = color[:3]


def png(image: np.ndarray) -> bytes:
    h, w, n = image.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * n)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def unpng(data: bytes) -> np.ndarray:
    """Read what png writes: eight bits, no filter."""
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        head, body = (part if kind == b"IHDR" else head), body + (part if kind == b"IDAT" else b"")
        at += 12 + size
    w, h, _, color = struct.unpack(">IIBB", head[:10])
    n = {0: 1, 2: 3, 6: 4}[color]
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w * n + 1)
    return rows[:, 1:].reshape(h, w, n)
