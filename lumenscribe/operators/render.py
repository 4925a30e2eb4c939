"""The sample pipeline: layout, turning, distortion, scaling, background, pasting, blur, naming.

One mapInPandas node makes image, mask, boxes and manifest of a row together, so that
no sample is drawn twice. Every random choice is drawn from (seed, idx), so a sample is
the same in any partitioning.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lumenscribe.functions.naming import BUCKET_SIZE, FORBIDDEN, parse_colors
from lumenscribe.functions.draws import plain_between
from lumenscribe.functions.glyphs import FIELD_OF_ROLE, FIELDS, SARA_AM_NAME, role_rules
from lumenscribe.operators import jpeg, raster
from lumenscribe.operators.frontend import spread
from lumenscribe.operators.layout import INKLESS_HEIGHT, OVERLAP
from lumenscribe.sources import truetype

NIKHAHIT, SARA_AA, SARA_AM = "ํ", "า", "ำ"
_BOXES = ", ".join(f"{f}_bbox array<int>" for f in ["", *FIELDS]).replace("_bbox", "bbox", 1)
_POSITION = "struct<glyph_name:string, grapheme:string, " + _BOXES.replace(" array", ":array") + ">"
SCHEMA = f"idx bigint, text string, font string, file_name string, bucket string, width int, height int, image binary, mask binary, boxes array<array<int>>, char_positions array<{_POSITION}>, text_offset array<int>"


@dataclass(frozen=True)
class Params:
    """What all samples of a run share; the names and defaults of the constructor's arguments."""

    size: int = 32
    extension: str = "jpg"
    skewing_angle: int = 0
    random_skew: bool = False
    blur: float = 0
    random_blur: bool = False
    background_type: int = 0
    distorsion_type: int = 0
    distorsion_orientation: int = 0
    is_handwritten: bool = False
    name_format: int = 0
    width: int = -1
    alignment: int = 1
    text_color: str = "#282828"
    orientation: int = 0
    space_width: float = 1.0
    character_spacing: int = 0
    margins: tuple[int, ...] = (5,) * 4
    fit: bool = False
    output_mask: int = 0
    word_split: bool = False
    image_dir: str = ""
    stroke_width: int = 0
    stroke_fill: str = "#282828"
    image_mode: str = "RGB"
    output_bboxes: int = 0
    output_coco: bool = False
    latin_font: str = ""
    #: A shift of each column and row, instead of distorsion_type's, of offset_reach pixels at most either way.
    offset: Callable[[int], float] | None = None
    offset_reach: int = 0

    def checked(self) -> Params:
        """Itself, or an error before any row is read."""
        if self.is_handwritten:
            raise ValueError("vertical handwritten text is unavailable" if self.orientation == 1 else "handwritten text needs a network and weights that are not part of this library")
        if self.orientation not in (0, 1):
            raise ValueError(f"no such orientation: {self.orientation}")
        if self.extension not in ("png", "jpg", "jpeg"):
            raise ValueError(f"there are encoders for png and jpg only, not for {self.extension}")
        if self.extension != "png" and self.image_mode == "RGBA":
            raise ValueError("a JPEG image has no alpha: give another extension or mode")
        if self.distorsion_type == 3 and 0 < self.distorsion_orientation < 5:
            raise ValueError("a curve is 5 pixels high at least")
        if self.image_mode not in (*raster.MODES, "1"):
            raise ValueError(f"no such image mode: {self.image_mode}")
        parse_colors(self.text_color), parse_colors(self.stroke_fill)
        return self


class GridFace:
    """A face drawn by rule, a rectangle for each character: it needs no font file."""

    em = 16

    def has(self, char: str) -> bool:
        return True

    def glyph(self, char: str) -> tuple[str, float, list[np.ndarray], list[tuple[str, tuple]]]:
        """name, advance, outlines, parts (role, box), in units, y upwards."""
        if char.isspace():
            return "space", 4.0, [], []
        code = ord(char)
        x2, y1, y2 = 3.0 + code % 5, float(code % 3 - 1), float(code % 3 + 4 + code % 4)
        return f"uni{code:04X}", float(code % 5 + 4), [np.array([[1, x2, x2, 1], [y1, y1, y2, y2]], float).T], [(self._role(char), (1.0, y1, x2, y2))]

    @staticmethod
    def _role(char: str) -> str:
        return role_of_name(f"uni{ord(char):04X}")


def role_of_name(name: str) -> str:
    return next((role for role, pattern in role_rules() if re.search(pattern, name.lower())), "BASE")


class FontFace:
    """A TrueType font; a glyph's parts have their roles by name and height."""

    def __init__(self, path: str):
        self.font = truetype.opened(path)
        self.em = self.font.em
        self.seen: dict[str, tuple] = {}

    def has(self, char: str) -> bool:
        return ord(char) in self.font.cmap

    def glyph(self, char: str):
        if char not in self.seen:
            g = self.font.cmap.get(ord(char), 0)
            name = self.font.names[g]
            self.seen[char] = name, float(self.font.advances[g]), self.font.contours(g), self._parts(g, name)
        return self.seen[char]

    def _parts(self, g: int, name: str) -> list[tuple[str, tuple]]:
        middle = lambda b: (b[1] + b[3]) / 2
        union = lambda bs: (min(b[0] for b in bs), min(b[1] for b in bs), max(b[2] for b in bs), max(b[3] for b in bs))
        lower, em = name.lower(), self.em
        composed = []
        for part, (a, b, c, d, dx, dy) in self.font.parts(g):
            if box := truetype.bounds([p @ np.array([[a, b], [c, d]]) + (dx, dy) for p in self.font.contours(part)]):
                composed.append((self.font.names[part], box))
        each = [truetype.bounds([c]) for c in self.font.contours(g)]
        if re.search(SARA_AM_NAME, lower):
            if composed:
                named = [(role_of_name(n), b) for n, b in composed]
                return [(r if r != "BASE" else "NIKHAHIT" if middle(b) > em * 0.4 else "SARA_AA", b) for r, b in named]
            groups = ("NIKHAHIT", [b for b in each if middle(b) > em * 0.4]), ("SARA_AA", [b for b in each if middle(b) <= em * 0.4])
            return [(r, union(bs)) for r, bs in groups if bs]
        if composed:
            ordered = sorted(((role_of_name(n), b) for n, b in composed), key=lambda p: middle(p[1]))
            if len(ordered) > 1 and all(middle(b) > em * 0.3 for _, b in ordered):
                return [("TONE" if k else "NIKHAHIT", b) for k, (_, b) in enumerate(ordered)]
            return [("TONE" if r == "BASE" and middle(b) > em * 0.5 else "LOWER_VOWEL" if r == "BASE" and middle(b) < 0 else r, b) for r, b in ordered]
        if not each:
            return []
        if "0e4d" in lower and re.search("0e4[89ab]", lower):
            ordered = sorted(each, key=middle)
            if len(ordered) == 1:
                return [("TONE", ordered[0])]
            gaps = [middle(b) - middle(a) for a, b in zip(ordered, ordered[1:])]
            k = gaps.index(max(gaps)) + 1
            return [("NIKHAHIT", union(ordered[:k])), ("TONE", union(ordered[k:]))]
        box, role = union(each), role_of_name(name)
        if role == "BASE":
            role = "TONE" if middle(box) > em * 0.6 else "UPPER_VOWEL" if middle(box) > em * 0.4 else "LOWER_VOWEL" if middle(box) < 0 else role
        return [(role, box)]


class Outlines(list):
    """A glyph's outlines in pixels, and the ink drawn of them by what it depends on.

    Ink is kept for its height on the line, and only where moving the outlines across by whole pixels is exact.
    """

    def __init__(self, contours: list[np.ndarray]):
        super().__init__(contours)
        points = np.concatenate(contours) if contours else np.zeros((1, 2))
        self.low, self.high = points.min(0).tolist(), points.max(0).tolist()
        self.whole = bool((points[:, 0] * 64 % 1 == 0).all())
        self.inks: dict = {}


#: Glyphs of a face, and inks of a glyph, that are kept at most.
KEPT_GLYPHS, KEPT_INKS = 4096, 64


def scaled(char: str, face, size: int) -> tuple:
    """name, advance, outlines, boxes of a glyph in pixels; each is scaled once."""
    kept = face.__dict__.setdefault("scaled", {})
    if (char, size) not in kept:
        if len(kept) >= KEPT_GLYPHS:
            kept.clear()
        scale, (name, advance, contours, parts) = size / face.em, face.glyph(char)
        kept[char, size] = name, advance * scale, Outlines([c * scale for c in contours]), [(r, tuple(v * scale for v in b)) for r, b in parts]
    return kept[char, size]


def placed(text: str, face, size: int, spacing: int = 0) -> list[tuple]:
    """name, x, y (of a lifted tone), advance, outlines, boxes of each glyph of a line."""
    x, top, items = 0.0, -math.inf, []
    for char in text:
        for k, one in enumerate((NIKHAHIT, SARA_AA) if char == SARA_AM and face.has(NIKHAHIT) and face.has(SARA_AA) else (char,)):
            name, advance, outlines, boxes = scaled(one, face, size)
            advance = (0 if k == 0 and char == SARA_AM and one != char else advance) + max(spacing, 0) * (k == 0)
            y = 0.0
            roles = {r for r, _ in boxes}
            if roles & {"BASE", "LEADING_VOWEL", "LOWER_VOWEL"}:
                top = -math.inf
            if boxes:
                if "TONE" in roles and top > -math.inf:
                    y = max(0.0, top + OVERLAP * size - min(b[1] for _, b in boxes))
                if roles & {"TONE", "NIKHAHIT", "UPPER_VOWEL", "UPPER_DIACRITIC"}:
                    top = max(top, y + max(b[3] for _, b in boxes))
            items.append((name, x, y, advance, outlines, boxes))
            x += advance
    return items


def lifts(text: str, face, size: int) -> list[float]:
    return [y for _, _, y, *_ in placed(text, face, size)]


def lay_out(text: str, face, size: int, p: Params, fill: tuple, stroke: tuple, first: int = 0):
    """RGBA image, RGB mask and positions (name, boxes by field) of a horizontal line."""
    items = placed(text, face, size, p.character_spacing)
    spans = [(x + b[0], x + b[2], y + b[1], y + b[3]) for _, x, y, _, _, boxes in items for _, b in boxes]
    spans += [(x, x + a, y, y + size * INKLESS_HEIGHT) for _, x, y, a, _, boxes in items if not boxes and a > 0]
    x1, x2, y1, y2 = (f(s[k] for s in spans) for k, f in enumerate((min, max, min, max))) if spans else (0, 1, 0, size)
    width, height = math.ceil(x2 - x1), math.ceil(y2 - y1)
    image, mask, found, k = np.zeros((height, width, 4), np.uint8), np.zeros((height, width, 3), np.uint8), [], first
    for name, x, y, _, contours, boxes in items:
        if contours:
            _ink(image, contours, x, x1, y, y2, fill, stroke, p.stroke_width)
        if not boxes:
            continue
        k += 1
        place, each = {}, []
        for role, b in boxes:
            box = tuple(int(v) for v in (x - x1 + b[0], y2 - (y + b[3]), x - x1 + b[2], y2 - (y + b[1])))
            each.append(box)
            place[FIELD_OF_ROLE[role]] = box
            mask[max(box[1], 0) : box[3] + 1, max(box[0], 0) : box[2] + 1] = raster.mask_color(k)
        place[""] = tuple(f(b[i] for b in each) for i, f in enumerate((min, min, max, max)))
        found.append((name, None, place))
    return image, mask, found


def _ink(image: np.ndarray, outlines: Outlines, x: float, x1: float, y: float, y2: float, fill: tuple, stroke: tuple, width: int) -> None:
    """Fill outlines on the image, over their widened shape if there is a stroke."""
    h, w = image.shape[:2]
    dx, dy, key = x - x1, y2 - y, None
    if outlines.whole and dx % 1 == 0 and x * 64 % 1 == 0:
        # ink that the image cuts is another for each cut
        (left, low), (right, high), m = outlines.low, outlines.high, width + 1
        sides = math.floor(left + dx) - m, math.floor(dy - high) - m, w - math.ceil(right + dx) - m, h - math.ceil(dy - low) - m
        key = width, y, y2, *(min(int(v), 0) for v in sides)
    if key is None or key not in outlines.inks:
        contours = [np.stack([c[:, 0] + x - x1, y2 - (c[:, 1] + y)], axis=1) for c in outlines]
        drawn = _layers(contours, h, w, width)
        if key is None:
            return _cover(image, drawn, fill, stroke)
        if len(outlines.inks) >= KEPT_INKS:
            outlines.inks.clear()
        outlines.inks[key] = [(top, at - int(dx), *rest) for top, at, *rest in drawn]
    _cover(image, [(top, at + int(dx), *rest) for top, at, *rest in outlines.inks[key]], fill, stroke)


def _layers(contours: list[np.ndarray], h: int, w: int, width: int) -> list[tuple]:
    """row, column and cover of the stroke, if any, and the shape of outlines on an image of that size."""
    points = np.concatenate(contours)
    m = width + 1
    x, y = max(0, math.floor(points[:, 0].min()) - m), max(0, math.floor(points[:, 1].min()) - m)
    cw, ch = min(w, math.ceil(points[:, 0].max()) + m) - x, min(h, math.ceil(points[:, 1].max()) + m) - y
    if cw <= 0 or ch <= 0:
        return []
    shape = raster.fill([c - (x, y) for c in contours], cw, ch)
    layers = [shape]
    if width:
        wide = shape.copy()
        for dy in range(-width, width + 1):
            for dx in range(-width, width + 1):
                if dx * dx + dy * dy <= width * width:
                    moved = np.zeros_like(shape)
                    moved[max(dy, 0) : ch + min(dy, 0), max(dx, 0) : cw + min(dx, 0)] = shape[max(-dy, 0) : ch + min(-dy, 0), max(-dx, 0) : cw + min(-dx, 0)]
                    wide = np.maximum(wide, moved)
        layers.insert(0, wide)
    out = []
    for cover in layers:
        rows, columns = cover.any(axis=1).nonzero()[0], cover.any(axis=0).nonzero()[0]
        if len(rows):
            cover = cover[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]
            out.append((y + int(rows[0]), x + int(columns[0]), None if (cover == 1).all() else cover, cover.shape))
        else:
            out.append((y, x, cover[:0], (0, 0)))
    return out


def _cover(image: np.ndarray, layers: list[tuple], fill: tuple, stroke: tuple) -> None:
    """Lay the last layer in the fill's colour on the image, over the one before it in the stroke's; without cover a layer is solid."""
    for (y, x, cover, (ch, cw)), color in zip(layers, (stroke, fill)[-len(layers) :]):
        part = image[y : y + ch, x : x + cw]
        if cover is None:
            part[:] = (*color, 255)
            continue
        if not part[:, :, 3].any():
            part[:, :, :3] = (cover > 0)[:, :, None] * np.array(color, np.uint8)
            part[:, :, 3] = np.rint(cover * 255)
            continue
        under, a = part[:, :, 3] / 255.0, cover
        alpha = a + under * (1 - a)
        for c in range(3):
            part[:, :, c] = np.where(alpha > 0, np.rint((color[c] * a + part[:, :, c] * under * (1 - a)) / np.maximum(alpha, 1e-9)), 0)
        part[:, :, 3] = np.rint(alpha * 255)


def _fit(image: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cropped to the ink; boxes are left where they were."""
    y, x = np.nonzero(image[:, :, 3])
    if not len(y):
        return image, mask
    cut = slice(y.min(), y.max() + 1), slice(x.min(), x.max() + 1)
    return image[cut], mask[cut]


def horizontal(text: str, face, p: Params, fill: tuple, stroke: tuple, latin=None):
    """A line; runs that the face lacks are set in the Latin face, side by side, tops aligned."""
    runs = []
    for c in text:
        ok = c == " " or face.has(c)
        if runs and runs[-1][1] == ok:
            runs[-1][0] += c
        else:
            runs.append([c, ok])
    if latin is None or all(ok for _, ok in runs):
        runs = [[text, True]]
    done, found = [], []
    for run, ok in runs:
        image, mask, own = lay_out(run, face if ok else latin, p.size, p, fill, stroke, len(found))
        dx = sum(i.shape[1] for i, _ in done)
        found += [(n, g, {k: (b[0] + dx, b[1], b[2] + dx, b[3]) for k, b in place.items()}) for n, g, place in own]
        done.append((image, mask))
    high = max(i.shape[0] for i, _ in done)
    up = lambda a: np.pad(a, ((0, high - a.shape[0]), (0, 0), (0, 0)))
    image, mask = (np.concatenate([up(d[k]) for d in done], axis=1) for k in (0, 1))
    return (*(_fit(image, mask) if p.fit else (image, mask)), found)


_CLUSTER = re.compile("[฀-๿][ัำิ-ฺ็-๎]*|.", re.S)


def vertical(text: str, face, p: Params, fill: tuple, stroke: tuple):
    """Graphemes one below the other; a space is as high as the space width says."""
    pieces = []
    for g in _CLUSTER.findall(text):
        if g == " ":
            pieces.append((g, None, None, int(p.size * INKLESS_HEIGHT * p.space_width)))
        else:
            image, mask, _ = lay_out(g, face, p.size, p, fill, stroke)
            pieces.append((g, image, mask, image.shape[0]))
    width = max([1, *(i.shape[1] for _, i, _, _ in pieces if i is not None)])
    height = max(1, sum(h for *_, h in pieces) + p.character_spacing * len(pieces))
    image, out, y, found = np.zeros((height, width, 4), np.uint8), np.zeros((height, width, 3), np.uint8), 0, []
    for k, (g, own, own_mask, h) in enumerate(pieces, 1):
        w = own.shape[1] if own is not None else 0
        if own is not None:
            image[y : y + h, :w] = own
            out[y : y + h, :w][own_mask.any(axis=2)] = raster.mask_color(k)
        found.append((None, g, {"": (0, y, w, y + h)}))
        y += h + p.character_spacing
    return (*(_fit(image, out) if p.fit else (image, out)), found)


def sample(idx: int, text: str, face, p: Params, seed: int, latin=None, pictures: list[np.ndarray] = ()) -> dict | None:
    """Everything of one sample, or None if it has no size or can't be told from its background."""
    pick = lambda tag: raster.draw(seed, idx, tag)
    # what Column expressions draw too is drawn as they do: naming.pick_color, the skew, geometry's waves
    among = lambda tag, low, high: plain_between(seed, tag, idx, low, high)
    color = lambda text, tag: tuple(among(f"{tag}-{c}", min(a, b), max(a, b)) for c, a, b in zip("rgb", *parse_colors(text)))
    fill, stroke = color(p.text_color, "fill"), color(p.stroke_fill, "stroke")
    image, mask, found = horizontal(text, face, p, fill, stroke, latin) if p.orientation == 0 else vertical(text, face, p, fill, stroke)
    keys = [(k, f) for k, (_, _, place) in enumerate(found) for f in place]
    boxes = np.array([found[k][2][f] for k, f in keys], float).reshape(-1, 4)

    angle = among("skew", -abs(p.skewing_angle), abs(p.skewing_angle)) if p.random_skew else p.skewing_angle
    boxes = raster.turn_boxes(boxes, angle, image.shape[1], image.shape[0])
    image, mask = raster.turn(image, angle, True), raster.turn(mask, angle, False)

    if p.distorsion_type == 3:
        amplitude = among("curve", 5, p.distorsion_orientation or 20)
        boxes = raster.curve_boxes(boxes, amplitude, image.shape[1])
        image, mask = raster.curve(image, amplitude), raster.curve(mask, amplitude)
    elif (p.distorsion_type or p.offset) and p.distorsion_orientation in (0, 1, 2):
        kind = p.offset or {1: "sin", 2: "cos"}.get(p.distorsion_type, "jitter")
        h, w = image.shape[:2]
        reach = p.offset_reach if p.offset else raster.reach_of(kind, h)
        down = raster.offsets(kind, w, reach, seed, idx, "down") if p.distorsion_orientation in (0, 2) else None
        right = raster.offsets(kind, h + 2 * reach if down is not None else h, reach, seed, idx, "right") if p.distorsion_orientation in (1, 2) else None
        boxes = raster.wave_boxes(boxes, reach, down, right)
        image, mask = raster.wave(image, reach, down, right), raster.wave(mask, reach, down, right)

    top, left, bottom, right = p.margins
    if not image.shape[0] or not image.shape[1]:
        return None
    if p.orientation == 0:
        ratio, h = (p.size - top - bottom) / image.shape[0], p.size - top - bottom
        w = int(image.shape[1] * ratio)
        width, height = (p.width if p.width > 0 else w + left + right), p.size
    else:
        ratio, w = (p.size - left - right) / image.shape[1], p.size - left - right
        h = int(image.shape[0] * ratio)
        width, height = p.size, h + top + bottom
    if w <= 0 or h <= 0:
        return None
    image, mask, boxes = raster.resize(image, w, h), raster.resize_nearest(mask, w, h), np.trunc(boxes * ratio).astype(int)

    back = pick("background")
    if p.background_type == 0:
        ground = raster.gaussian_noise(height, width, back)
    elif p.background_type == 1:
        ground = raster.plain_white(height, width)
    elif p.background_type == 2:
        ground = raster.quasicrystal(height, width, back)
    else:
        if not len(pictures):
            raise ValueError("no pictures for the background")
        ground = raster.picture(height, width, pictures[int(back.integers(len(pictures)))], back)
    if raster.too_alike(image, mask, ground):
        return None
    x = left if p.alignment == 0 or p.width == -1 else int(width / 2 - w / 2) if p.alignment == 1 else width - w - right
    canvas, marks = raster.rgba(ground).copy(), np.zeros((height, width, 3), np.uint8)
    raster.paste(canvas, image, x, top)
    raster.paste(marks, mask, x, top)
    boxes = boxes + np.array([x, top, x, top])

    radius = p.blur * float(pick("blur").random()) if p.random_blur else p.blur
    listed = []
    if p.output_bboxes:
        listed = mask_boxes(raster.ink_extents(marks), width, height, p.output_bboxes == 2)
    positions: list[dict] = [{"glyph_name": n, "grapheme": g} | {f"{f}_bbox": None for f in FIELDS} for n, g, _ in found]
    for (k, f), b in zip(keys, boxes.tolist()):
        positions[k][f"{f}_bbox" if f else "bbox"] = b
    name = text.replace(" ", "") if p.space_width == 0 else text
    name = {1: f"{idx}_{name}", 2: str(idx)}.get(p.name_format, f"{name}_{idx}")
    name = re.sub(FORBIDDEN, "", unicodedata.normalize("NFC", name))[:200]
    return {
        "idx": idx, "text": text, "file_name": f"{name}.{p.extension}", "bucket": f"{idx // BUCKET_SIZE:04d}", "width": width, "height": height,
        "image": (raster.png if p.extension == "png" else jpeg.encode)(raster.blur(raster.converted(canvas, p.image_mode), radius)),
        "mask": raster.png(raster.blur(raster.converted(marks, p.image_mode), radius)) if p.output_mask else None,
        "boxes": listed, "char_positions": positions, "text_offset": [x, top],
    }


def mask_boxes(extents: list[tuple], width: int, height: int, tess: bool = False) -> list[list[int]]:
    """The boxes of a sample's mask, by the rules of operators.masks."""
    out, last = [], 0
    for k, minx, miny, maxx, maxy in extents:
        if k - last > 2 or (not out and k != 1):
            break
        low = (max(0, height - maxy - 1), min(height - 1, height - miny + 1)) if tess else (max(0, miny - 1), min(height - 1, maxy + 1))
        if k - last == 2:
            before = out[-1]
            gap = (min(height - miny + 2, before[1] - 1), max(height - miny + 2, before[1] - 1)) if tess else (min(before[3] + 1, miny - 1), max(before[3] + 1, miny - 2))
            out.append([min(before[2] + 1, minx - 1), gap[0], max(before[2] + 1, minx - 2), gap[1]])
        out.append([max(0, minx - 1), low[0], min(width - 1, maxx + 1), low[1]])
        last = k
    return out


def rendered(requests: DataFrame, params: Params, seed: int, rows_per_task: int = 500) -> DataFrame:
    """Samples of requests (idx, text, and font: a path that executors can read; without it the rule-drawn face).

    Samples that can't be drawn are left out. Drawing takes some ms a sample, so the
    requests, which are small, are first spread over tasks of rows_per_task or more;
    images never move. Memory holds a few hundred encoded images.
    """
    params = params.checked()
    spark = requests.sparkSession
    shared = spark.sparkContext.broadcast(load_pictures(spark, params.image_dir)) if params.background_type > 2 else None
    if "font" not in requests.columns:
        requests = requests.withColumn("font", F.lit(None).cast("string"))

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        faces: dict = {None: GridFace()}
        latins = [FontFace(path) for path in latin_fonts(params.latin_font)]
        pictures = shared.value if shared else []
        for batch in batches:
            out = []
            for idx, text, font in zip(*(batch.column(c).to_pylist() for c in ("idx", "text", "font"))):
                if text is None:
                    continue
                if font not in faces:
                    faces[font] = FontFace(font)
                latin = latins[plain_between(seed, "latin", idx, 0, len(latins) - 1)] if latins else None
                if row := sample(idx, text, faces[font], params, seed, latin, pictures):
                    out.append(row | {"font": font})
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    narrow = requests.select(F.col("idx").cast("bigint").alias("idx"), "text", "font")
    return spread(narrow, "idx", rows_per_task).mapInArrow(run, SCHEMA)


def latin_fonts(path: str) -> list[str]:
    """The font itself, or those of a folder by name, of which every sample draws one."""
    if not os.path.isdir(path):
        return [path] if path else []
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.lower().endswith((".ttf", ".otf")))


#: Bytes of the background pictures that go to every task.
PICTURE_BYTES = 256 << 20


def load_pictures(spark: SparkSession, folder: str) -> list[np.ndarray]:
    """RGBA pictures of a folder on any file system, by name: all formats that the JVM reads; other files are left out."""
    rows = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    size = rows.agg(F.sum(F.col("height").cast("bigint") * F.col("width") * 4)).first()[0] or 0
    if size > PICTURE_BYTES:
        raise ValueError(f"the pictures take {size} bytes, more than {PICTURE_BYTES}: give smaller ones or fewer")
    out = []
    for r in rows.orderBy("origin").toLocalIterator():
        pixels = np.frombuffer(bytes(r["data"]), np.uint8).reshape(r["height"], r["width"], r["nChannels"])
        out.append(raster.rgba(pixels[:, :, [2, 1, 0, 3][: r["nChannels"]]] if r["nChannels"] > 1 else pixels[:, :, 0]))  # the source gives blue first
    return out


def write_files(samples: DataFrame, out: str, params: Params) -> DataFrame:
    """Write samples' files under out/<bucket>/, each renamed when complete; the manifest of what was written."""
    import json

    from pyarrow import fs as pafs
    from pyspark import TaskContext

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, home = (pafs.LocalFileSystem(), out) if "://" not in out else pafs.FileSystem.from_uri(out)
        attempt = TaskContext.get().taskAttemptId()
        for pdf in batches:
            for r in pdf.to_dict("records"):
                stem = r["file_name"].rsplit(".", 1)[0]
                files = {r["file_name"]: r["image"]}
                if params.output_mask and r["mask"] is not None:
                    files[f"{stem}_mask.png"] = r["mask"]
                if params.output_bboxes == 1:
                    files[f"{stem}_boxes.txt"] = "".join(" ".join(map(str, b)) + "\n" for b in r["boxes"]).encode()
                if params.output_bboxes == 2:
                    files[f"{stem}.box"] = "".join(" ".join([c, *map(str, b), "0"]) + "\n" for b, c in zip(r["boxes"], r["text"])).encode()
                if params.output_coco:
                    positions = [{k: v if v is None or isinstance(v, str) else [int(x) for x in v] for k, v in p.items()} for p in r["char_positions"]]
                    parts = [p[f"{f}_bbox"] for p in positions for f in FIELDS if p[f"{f}_bbox"]]
                    meta = {"image_id": r["idx"], "file_name": r["file_name"], "width": r["width"], "height": r["height"], "text": r["text"], "char_bboxes": parts, "char_positions": positions, "text_offset": [int(v) for v in r["text_offset"]]}
                    files[f"{stem}_metadata.json"] = json.dumps(meta, ensure_ascii=False).encode()
                where.create_dir(f"{home}/{r['bucket']}", recursive=True)
                for name, body in files.items():
                    temp = f"{home}/{r['bucket']}/.{r['idx']}.{attempt}"
                    with where.open_output_stream(temp) as file:
                        file.write(body)
                    where.move(temp, f"{home}/{r['bucket']}/{name}")
            yield pdf[["idx", "bucket", "file_name"]]

    return samples.mapInPandas(run, "idx bigint, bucket string, file_name string")


PARAMS = tuple(f.name for f in fields(Params))
