"""Boxes as Column expressions: rotation, curve, waves, scale, offset, alignment.

A box is a struct of x1, y1, x2, y2, y downwards. Integers truncate towards zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenscribe.functions.draws import u32

SIDES = ("x1", "y1", "x2", "y2")


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*(F.lit(v).alias(k) if not isinstance(v, Column) else v.alias(k) for k, v in zip(SIDES, (x1, y1, x2, y2))))


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("bigint")


def _hull(points: list[tuple[Column, Column]]) -> Column:
    xs, ys = zip(*points)
    return box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def _corners(b: Column) -> list[tuple[Column, Column]]:
    return [(b["x1"], b["y1"]), (b["x2"], b["y1"]), (b["x2"], b["y2"]), (b["x1"], b["y2"])]


def rotated_size(width: Column, height: Column, angle: float) -> tuple[Column, Column]:
    """The canvas that holds the turned one."""
    c, s = abs(math.cos(math.radians(angle))), abs(math.sin(math.radians(angle)))
    whole = lambda a, b: F.ceil(F.round(width * a + height * b, 6)).cast("bigint")
    return whole(c, s), whole(s, c)


def rotate_point(x: Column, y: Column, angle: float, cx, cy) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return (x - cx) * c + (y - cy) * s + cx, (y - cy) * c - (x - cx) * s + cy


def rotate_box(b: Column, angle: float, width: Column, height: Column) -> Column:
    """Turn about the canvas's middle, then move to the new canvas's middle; angle 0 changes nothing."""
    if angle == 0:
        return b
    new_w, new_h = rotated_size(width, height, angle)
    turned = [rotate_point(x, y, angle, width / 2, height / 2) for x, y in _corners(b)]
    return _hull([(x + (new_w - width) / 2, y + (new_h - height) / 2) for x, y in turned])


def curve_box(b: Column, amplitude: Column, width: Column) -> Column:
    """Shift down by the arch's height at the box's middle."""
    middle = F.greatest(F.lit(0), F.least(width - 1, trunc((b["x1"] + b["x2"]) / 2)))
    off = trunc(amplitude * F.sin(middle * math.pi / width))
    return box(b["x1"], b["y1"] + off, b["x2"], b["y2"] + off)


def wave_reach(kind: str, height: Column) -> Column:
    """The greatest offset of a wave over a text of this height."""
    return trunc(F.pow(height.cast("double"), F.lit(0.4)) if kind == "jitter" else F.sqrt(height))


def wave_offset(kind: str, at: Column, reach: Column, seed: int = 0, key: Column | None = None, axis: str = "down") -> Column:
    """The shift of a column (down) or row (right): a sine, a cosine, or a draw of 0 .. reach, of its own for each axis."""
    if kind == "jitter":
        return u32(seed, f"jitter-{axis}", F.concat_ws(".", key.cast("string"), at.cast("bigint").cast("string"))) % (reach + 1)
    turn = {"sin": F.sin, "cos": F.cos}[kind]
    return trunc(F.round(turn(F.radians(at.cast("double"))) * reach, 9))


def wave_span(kind: str, width: Column, reach: Column) -> Column:
    """The greatest column offset less the least that is below zero (a draw's: its bound)."""
    if kind == "jitter":
        return reach
    last = wave_offset(kind, width - 1, reach)
    if kind == "sin":
        high = F.when(width >= 91, reach).otherwise(last)
        low = F.when(width >= 271, -reach).when(width >= 181, last).otherwise(F.lit(0))
    else:
        high = reach
        low = F.when(width >= 181, -reach).otherwise(F.least(last, F.lit(0)))
    return high - low


def wave_box(b: Column, kind: str, vertical: bool, horizontal: bool, width: Column, height: Column, seed: int = 0, key: Column | None = None, parity: bool = True) -> Column:
    """Each corner moved as its pixels are; corners of the canvas's far edges are no pixels and stay.

    parity keeps known quirks: of a horizontal wave alone, boxes lack the margin that
    pixels get, and corners on the far edges stay where they were. Without it they move
    as the last pixel does; so it is drawn.
    """
    if not (vertical or horizontal):
        return b
    reach = wave_reach(kind, height)
    if not parity:
        return _drawn_wave(b, kind, vertical, horizontal, width, height, reach, seed, key)
    off = lambda at, axis: wave_offset(kind, at, reach, seed, key, axis)
    rows = height + wave_span(kind, width, reach) if vertical else height
    out = []
    for x, y in _corners(b):
        new_x, new_y = x, y
        if vertical:
            inside = (x >= 0) & (x < width)
            new_y = F.when(inside, y + reach + off(x, "down")).otherwise(y)
            new_x = F.when(inside & F.lit(horizontal), x + reach).otherwise(x)
        if horizontal:
            new_x = F.when((new_y >= 0) & (new_y < rows), new_x + off(new_y, "right")).otherwise(new_x)
        out.append((new_x, new_y))
    return _hull(out)


def _drawn_wave(b: Column, kind: str, vertical: bool, horizontal: bool, width: Column, height: Column, reach: Column, seed: int, key: Column | None) -> Column:
    """Truncated corners, moved as the pixel there or the last one before the edge; the canvas grows by twice the reach."""
    within = lambda at, n: F.greatest(F.lit(0), F.least(at, n - 1))
    out = []
    for x, y in _corners(b):
        x, y = trunc(x), trunc(y)
        if vertical:
            y = y + reach + wave_offset(kind, within(x, width), reach, seed, key, "down")
        if horizontal:
            x = x + reach + wave_offset(kind, within(y, height + 2 * reach), reach, seed, key, "right")
        out.append((x, y))
    return _hull(out)


def scale_box(b: Column, ratio: Column) -> Column:
    return box(*(trunc(b[k] * ratio) for k in SIDES))


def move_box(b: Column, dx: Column, dy: Column) -> Column:
    return box(b["x1"] + dx, b["y1"] + dy, b["x2"] + dx, b["y2"] + dy)


def resize(width: Column, height: Column, size: int, margins: tuple[int, int, int, int], orientation: int = 0, fixed_width: int = -1) -> dict[str, Column]:
    """ratio, the text's new width and height, and the canvas's, for margins top, left, bottom, right."""
    top, left, bottom, right = margins
    if orientation not in (0, 1):
        raise ValueError(f"no such orientation: {orientation}")
    if orientation == 0:
        ratio, new_h = F.lit(float(size - top - bottom)) / height, F.lit(size - top - bottom)
        new_w = trunc(width * ratio)
        canvas = F.lit(fixed_width) if fixed_width > 0 else new_w + left + right, F.lit(size)
    else:
        ratio, new_w = F.lit(float(size - left - right)) / width, F.lit(size - left - right)
        new_h = trunc(height * ratio)
        canvas = F.lit(size), new_h + top + bottom
    return {"ratio": ratio, "text_width": new_w, "text_height": new_h, "canvas_width": canvas[0], "canvas_height": canvas[1]}


def align(alignment: int, canvas_width: Column, text_width: Column, margins: tuple[int, int, int, int], fixed_width: int = -1) -> Column:
    """Where the text begins: left (0, or without a fixed width), centre (1), right."""
    if alignment == 0 or fixed_width == -1:
        return F.lit(margins[1])
    if alignment == 1:
        return trunc(canvas_width / 2 - text_width / 2)
    return canvas_width - text_width - margins[3]
