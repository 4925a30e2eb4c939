"""TrueType fonts without a font library: units, character map, advances, names, outlines."""

from __future__ import annotations

import math
import struct
from functools import lru_cache

import numpy as np


class TrueType:
    """Tables of a font with glyf outlines; fonts with others are refused."""

    def __init__(self, data: bytes):
        self.data = data
        n = struct.unpack(">H", data[4:6])[0]
        self.tables = {data[12 + 16 * k : 16 + 16 * k].decode("latin1"): struct.unpack(">II", data[20 + 16 * k : 28 + 16 * k]) for k in range(n)}
        if "glyf" not in self.tables:
            raise ValueError("a font without glyf outlines")
        head, hhea = self.table("head"), self.table("hhea")
        self.em, self.long = struct.unpack(">H", head[18:20])[0], struct.unpack(">h", head[50:52])[0]
        self.count = struct.unpack(">H", self.table("maxp")[4:6])[0]
        n = struct.unpack(">H", hhea[34:36])[0]
        metrics = np.frombuffer(self.table("hmtx")[: 4 * n], ">u2")[::2].astype(int)
        self.advances = np.append(metrics, np.full(max(0, self.count - n), metrics[-1]))
        loca = self.table("loca")
        self.loca = np.frombuffer(loca, ">u4")[: self.count + 1].astype(int) if self.long else np.frombuffer(loca, ">u2")[: self.count + 1].astype(int) * 2
        self.cmap = self._cmap()
        self.names = self._names()
        self.index = {name: k for k, name in enumerate(self.names)}

    @classmethod
    def open(cls, path: str) -> TrueType:
        with open(path, "rb") as file:
            return cls(file.read())

    def table(self, name: str) -> bytes:
        at, size = self.tables[name]
        return self.data[at : at + size]

    def _cmap(self) -> dict[int, int]:
        """Code point -> glyph, from the format 12 and 4 tables."""
        t, out = self.table("cmap"), {}
        for k in range(struct.unpack(">H", t[2:4])[0]):
            platform, encoding, at = struct.unpack(">HHI", t[4 + 8 * k : 12 + 8 * k])
            kind = struct.unpack(">H", t[at : at + 2])[0]
            if platform not in (0, 3) or (platform == 3 and encoding not in (1, 10)):
                continue
            if kind == 12:
                n = struct.unpack(">I", t[at + 12 : at + 16])[0]
                for a, b, g in struct.iter_unpack(">III", t[at + 16 : at + 16 + 12 * n]):
                    out.update((c, g + c - a) for c in range(a, b + 1))
            elif kind == 4:
                n = struct.unpack(">H", t[at + 6 : at + 8])[0] // 2
                ends, starts, deltas, offsets = (np.frombuffer(t[at + 14 + 2 * n * j + (2 if j else 0) :][: 2 * n], ">u2").astype(int) for j in range(4))
                home = at + 16 + 6 * n
                for j in range(n):
                    for c in range(starts[j], min(ends[j], 0xFFFE) + 1):
                        g = c
                        if offsets[j]:
                            place = home + 2 * j + offsets[j] + 2 * (c - starts[j])
                            g = struct.unpack(">H", t[place : place + 2])[0]
                            if not g:
                                continue
                        out.setdefault(c, int(g + deltas[j]) & 0xFFFF)
        return {c: g for c, g in out.items() if g}

    def _names(self) -> list[str]:
        """Names of the post table, or by code point."""
        by_code: dict[int, str] = {}
        for c, g in sorted(self.cmap.items(), reverse=True):
            by_code[g] = f"uni{c:04X}"
        out = [by_code.get(k, f"glyph{k:05d}") for k in range(self.count)]
        post = self.table("post") if "post" in self.tables else b""
        if post[:4] == b"\0\2\0\0":
            n = struct.unpack(">H", post[32:34])[0]
            index, at, own = struct.unpack(f">{n}H", post[34 : 34 + 2 * n]), 34 + 2 * n, []
            while at < len(post):
                own.append(post[at + 1 : at + 1 + post[at]].decode("latin1"))
                at += 1 + post[at]
            for g, k in enumerate(index[: self.count]):
                if k >= 258 and k - 258 < len(own):
                    out[g] = own[k - 258]
        return out

    def _raw(self, glyph: int) -> bytes:
        at = self.tables["glyf"][0]
        return self.data[at + self.loca[glyph] : at + self.loca[glyph + 1]]

    def parts(self, glyph: int) -> list[tuple[int, tuple[float, ...]]]:
        """(glyph, a b c d dx dy) of a composite's components; none of a plain one's."""
        raw = self._raw(glyph)
        if len(raw) < 10 or struct.unpack(">h", raw[:2])[0] >= 0:
            return []
        out, at, more = [], 10, True
        while more:
            flags, part = struct.unpack(">HH", raw[at : at + 4])
            at += 4
            kind = ">hh" if flags & 1 else ">bb"
            dx, dy = struct.unpack(kind, raw[at : at + struct.calcsize(kind)])
            at += struct.calcsize(kind)
            n = 1 if flags & 8 else 2 if flags & 64 else 4 if flags & 128 else 0
            m = [v / 16384 for v in struct.unpack(f">{n}h", raw[at : at + 2 * n])]
            at += 2 * n
            a, b, c, d = {0: (1, 0, 0, 1), 1: (*m, 0, 0, *m), 2: (m[0], 0, 0, m[-1]) if m else (), 4: tuple(m)}[n]
            out.append((part, (a, b, c, d, *((dx, dy) if flags & 2 else (0, 0)))))
            more = bool(flags & 32)
        return out

    def contours(self, glyph: int, depth: int = 0) -> list[np.ndarray]:
        """Closed outlines in units, curves as short lines."""
        raw = self._raw(glyph)
        if len(raw) < 10 or depth > 8:
            return []
        n = struct.unpack(">h", raw[:2])[0]
        if n < 0:
            out = []
            for part, (a, b, c, d, dx, dy) in self.parts(glyph):
                out += [p @ np.array([[a, b], [c, d]]) + (dx, dy) for p in self.contours(part, depth + 1)]
            return out
        ends = np.frombuffer(raw[10 : 10 + 2 * n], ">u2").astype(int)
        total, at = int(ends[-1]) + 1 if n else 0, 12 + 2 * n + struct.unpack(">H", raw[10 + 2 * n : 12 + 2 * n])[0]
        flags: list[int] = []
        while len(flags) < total:
            f, at = raw[at], at + 1
            repeat = 1
            if f & 8:
                repeat, at = raw[at] + 1, at + 1
            flags += [f] * repeat
        axes = []
        for short, same in ((2, 16), (4, 32)):
            v, values = 0, []
            for f in flags[:total]:
                if f & short:
                    v, at = v + (raw[at] if f & same else -raw[at]), at + 1
                elif not f & same:
                    v, at = v + struct.unpack(">h", raw[at : at + 2])[0], at + 2
                values.append(v)
            axes.append(values)
        points, on, first, out = np.array(axes, float).T, [f & 1 for f in flags], 0, []
        for end in ends:
            out.append(_flat(points[first : end + 1], on[first : end + 1]))
            first = int(end) + 1
        return [c for c in out if len(c)]


def _flat(points: np.ndarray, on: list[int], steps: int = 6) -> np.ndarray:
    """A quadratic outline as a polygon; two controls in a row have a point midway."""
    full = []
    for k in range(len(points)):
        full.append((points[k], on[k]))
        if not on[k] and not on[(k + 1) % len(points)]:
            full.append(((points[k] + points[(k + 1) % len(points)]) / 2, 1))
    start = next((k for k, (_, o) in enumerate(full) if o), None)
    if start is None:
        return points[:0]
    full = full[start:] + full[:start]
    out, k = [], 0
    while k < len(full):
        p, o = full[k]
        if o:
            out.append(p)
        else:
            a, b = out[-1], full[(k + 1) % len(full)][0]
            out += [(1 - t) ** 2 * a + 2 * t * (1 - t) * p + t * t * b for t in (np.arange(1, steps) / steps)]
        k += 1
    return np.array(out)


def bounds(contours: list[np.ndarray]) -> tuple[float, float, float, float] | None:
    if not contours:
        return None
    p = np.concatenate(contours)
    return (*p.min(0), *p.max(0))


def char_class(codes: set[int]) -> str:
    """Code points as the inside of a regular expression class of Java and RE2."""
    out, codes = [], sorted(codes)
    while codes:
        a = b = codes.pop(0)
        while codes and codes[0] == b + 1:
            b = codes.pop(0)
        out.append(rf"\x{{{a:x}}}" + (rf"-\x{{{b:x}}}" if b > a else ""))
    return "".join(out)


@lru_cache(maxsize=64)
def opened(path: str) -> TrueType:
    return TrueType.open(path)


def text_width(font: TrueType, text: str, size: float) -> int:
    return round(sum(float(font.advances[font.cmap.get(ord(c), 0)]) for c in text) * size / font.em)


def text_box(font: TrueType, text: str, size: float) -> tuple[int, int, int, int]:
    """left, top, right, bottom of a line's ink, y downwards from the base line."""
    x, boxes, scale = 0.0, [], size / font.em
    for c in text:
        g = font.cmap.get(ord(c), 0)
        if b := bounds(font.contours(g)):
            boxes.append((x + b[0] * scale, -b[3] * scale, x + b[2] * scale, -b[1] * scale))
        x += float(font.advances[g]) * scale
    if not boxes:
        return 0, 0, round(x), 0
    b = np.array(boxes)
    return math.floor(b[:, 0].min()), math.floor(b[:, 1].min()), math.ceil(b[:, 2].max()), math.ceil(b[:, 3].max())
