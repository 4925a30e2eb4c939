"""Text layout without pixels: advances, ink, tone lift, character boxes, canvas.

Glyphs are laid out by an Arrow kernel over the code points of all texts of a batch: a
window over exploded glyphs would shuffle every one of them, and higher-order functions
would interpret each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenscribe.session import slices

INKLESS_HEIGHT = 0.7
OVERLAP = 0.05


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def running_start(steps: pa.Array) -> pa.Array:
    """Of each list, the sum before each element."""
    offsets = steps.offsets.to_numpy()
    flat = steps.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    total = np.append(0.0, np.cumsum(flat))
    owner = np.repeat(offsets[:-1] - offsets[0], np.diff(offsets))
    return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(total[:-1] - total[owner]))


def grid_metrics(codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """advance, whether there is ink, and its x1, y1, x2, y2 (y upwards) of code points, in a face drawn by rule: it needs no font."""
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    return np.where(space, 4, codes % 5 + 4), ~space, np.ones(len(codes)), codes % 3 - 1, 3 + codes % 5, codes % 3 + 4 + codes % 4


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


_INT, _REAL = T.LongType(), T.DoubleType()
_SIDES = T.StructType([T.StructField(k, _INT) for k in ("x1", "y1", "x2", "y2")])
_GLYPH = T.StructType().add("k", T.IntegerType()).add("char", T.StringType()).add("x", _REAL).add("advance", _REAL).add("box", _SIDES)
_LAYOUT = T.StructType().add("width", _INT).add("height", _INT).add("n_glyphs", T.IntegerType()).add("hull", _SIDES).add("glyphs", T.ArrayType(_GLYPH))


#: Bytes of texts that are laid out at once; each takes some hundred in arrays.
SLICE_BYTES = 256 << 10


def _place(texts: pa.Array, metrics, size: int, spacing: int, glyphs: bool) -> pa.Array:
    """Layouts of all texts of a batch at once; a null one is laid out as an empty one."""
    rows = [t or "" for t in texts.to_pylist()]
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    codes = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    offsets, line = np.append(0, np.cumsum(n)), np.repeat(np.arange(len(n)), n)
    advance, drawn, x1, y1, x2, y2 = metrics(codes)
    advance = advance.astype(float) + spacing
    total = np.append(0.0, np.cumsum(advance))
    x = total[:-1] - total[offsets[:-1]][line]
    # an inkless glyph of some width counts as a box of its advance
    spans = (x + np.where(drawn, x1, 0), np.where(drawn, y1, 0), x + np.where(drawn, x2, advance), np.where(drawn, y2, size * INKLESS_HEIGHT))
    folds = (np.minimum, np.minimum, np.maximum, np.maximum)
    have, extent = np.flatnonzero(n), [np.zeros(len(n)), np.zeros(len(n)), np.ones(len(n)), np.full(len(n), float(size))]
    for out, span, fold in zip(extent, spans, folds):
        if len(have):
            out[have] = fold.reduceat(span, offsets[:-1][have])
    left, low, right, top = extent
    g, before = np.flatnonzero(drawn), np.append(0, np.cumsum(drawn))
    at, above, begins = x[g] - left[line[g]], top[line[g]], before[offsets]
    sides = [np.trunc(v).astype(np.int64) for v in (at + x1[g], above - y2[g], at + x2[g], above - y1[g])]
    inked, hull = np.flatnonzero(np.diff(begins)), [np.zeros(len(n), np.int64) for _ in folds]
    for out, side, fold in zip(hull, sides, folds):
        if len(inked):
            out[inked] = fold.reduceat(side, begins[:-1][inked])
    count = np.diff(begins).astype(np.int32)
    boxed = lambda parts, mask=None: pa.StructArray.from_arrays([pa.array(v) for v in parts], ["x1", "y1", "x2", "y2"], mask=mask)
    ceil = lambda v: pa.array(np.ceil(v).astype(np.int64))
    if glyphs:
        some, which = np.unique(codes[g], return_inverse=True)
        chars = pa.array([chr(c) for c in some], pa.string()).take(pa.array(which.astype(np.int64)))
        k = (before[g + 1] - begins[:-1][line[g]]).astype(np.int32)
        each = pa.StructArray.from_arrays([pa.array(k), chars, pa.array(x[g]), pa.array(advance[g]), boxed(sides)], ["k", "char", "x", "advance", "box"])
        listed = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), each)
    else:
        listed = pa.nulls(len(n), pa.list_(pa.struct([("k", pa.int32()), ("char", pa.string()), ("x", pa.float64()), ("advance", pa.float64()), ("box", boxed(hull).type)])))
    return pa.StructArray.from_arrays([ceil(right - left), ceil(top - low), pa.array(count), boxed(hull, pa.array(count == 0)), listed], ["width", "height", "n_glyphs", "hull", "glyphs"])


def laid_out(df: DataFrame, text: str, size: int, character_spacing: int = 0, metrics=grid_metrics, name: str = "layout", glyphs: bool = True) -> DataFrame:
    """df with a struct: canvas width and height, n_glyphs and hull of those with ink, and the glyphs.

    A glyph has k (counted from 1 over those with ink), char, x, advance and box, on the
    canvas, y downwards. Without glyphs their list is null and is not built.
    """
    spacing = max(character_spacing, 0)

    @F.arrow_udf(_LAYOUT)
    def place(texts: pa.Array) -> pa.Array:
        done = [_place(part, metrics, size, spacing, glyphs) for part in slices(texts, SLICE_BYTES)]
        return pa.concat_arrays(done) if len(done) > 1 else done[0]

    return df.withColumn(name, place(F.col(text)))


def tone_lift(items: Column, size: float) -> Column:
    """y of each item (y, bottom, top, base, upper, tone): a tone is raised to clear its cluster's top.

    A base forgets the top; the lift feeds back into it, so this is a fold and no window.
    """
    none = F.lit(float("-inf"))

    def step(acc: Column, i: Column) -> Column:
        top = F.when(i["base"], none).otherwise(acc["top"])
        short = top + OVERLAP * size - (i["y"] + i["bottom"])
        lift = F.when(i["bottom"].isNotNull() & i["tone"] & (top > none) & (short > 0), short).otherwise(F.lit(0.0))
        y = i["y"] + lift
        top = F.when(i["bottom"].isNotNull() & (i["upper"] | i["tone"]), F.greatest(top, y + i["top"])).otherwise(top)
        return F.struct(top.alias("top"), F.concat(acc["ys"], F.array(y)).alias("ys"))

    start = F.struct(none.alias("top"), F.array().cast("array<double>").alias("ys"))
    return F.aggregate(items, start, step, lambda acc: acc["ys"])


def stacked(heights: Column, spacing: int = 0) -> Column:
    """The top of each grapheme of a vertical text."""
    return running_start(F.transform(heights, lambda h: h.cast("double") + spacing))


def support_segments(text: Column, supported: str) -> Column:
    """Runs of characters that a font has, or has not; supported is a regular expression class.

    A space is in every font. Any character map becomes such a class (fonts.char_class),
    so runs need no exploded characters and no windows.
    """
    runs = F.regexp_extract_all(text, F.lit(f"(?s)[{supported} ]+|[^{supported} ]+"), F.lit(0))
    return F.transform(runs, lambda r: F.struct(r.alias("segment"), r.rlike(f"^[{supported} ]").alias("supported")))
