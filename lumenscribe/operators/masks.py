"""Boxes from a mask's ink extents, with a box for each single gap.

The extents of all rows of a batch are taken at once by an Arrow kernel: nested
higher-order functions would sort and pair each list again for every use of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIELDS, _SIDES = ("k", "minx", "miny", "maxx", "maxy"), ("x1", "y1", "x2", "y2")
_BOXES = T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in _SIDES]))


def _boxes(extents: pa.Array, width: pa.Array, height: pa.Array, tess: bool) -> pa.Array:
    offsets = extents.offsets.to_numpy().astype(np.int64)
    values, owner = extents.values[offsets[0] : offsets[-1]], np.repeat(np.arange(len(extents)), np.diff(offsets))
    if values.null_count:
        owner, values = owner[values.is_valid().to_numpy(zero_copy_only=False)], values.drop_null()
    of = np.stack([owner, *(values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in _FIELDS)])
    order = np.lexsort(of[::-1])
    owner, k, minx, miny, maxx, maxy = of[:, order]
    w, h = (v.to_numpy(zero_copy_only=False).astype(np.int64)[owner] for v in (width, height))
    top, bottom = (h - maxy - 1, h - miny + 1) if tess else (miny - 1, maxy + 1)
    own = np.stack([np.maximum(0, minx - 1), np.maximum(0, top), np.minimum(w - 1, maxx + 1), np.minimum(h - 1, bottom)])
    first = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
    step = np.where(first, 0, k - np.roll(k, 1))
    stops = np.cumsum(np.where(first, k != 1, step > 2))
    begins = np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))
    kept = stops == np.append(0, stops)[begins]  # no stop in the row's list so far
    gap = kept & (step == 2)
    before = np.roll(own, 1, axis=1)
    if tess:
        low = np.minimum(h - miny + 2, before[1] - 1), np.maximum(h - miny + 2, before[1] - 1)
    else:
        low = np.minimum(before[3] + 1, miny - 1), np.maximum(before[3] + 1, miny - 2)
    between = np.stack([np.minimum(before[2] + 1, minx - 1), low[0], np.maximum(before[2] + 1, minx - 2), low[1]])
    ends = np.cumsum(kept + gap.astype(np.int64))
    out = np.zeros((4, int(ends[-1]) if len(ends) else 0), np.int64)
    out[:, ends[kept] - 1] = own[:, kept]
    out[:, ends[gap] - 2] = between[:, gap]
    sizes = np.bincount(owner, kept + gap.astype(np.int64), len(extents)).astype(np.int64)
    each = pa.StructArray.from_arrays([pa.array(v) for v in out], list(_SIDES))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), each, mask=extents.is_null() if extents.null_count else None)


@F.arrow_udf(_BOXES)
def _plain(extents: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    return _boxes(extents, width, height, False)


@F.arrow_udf(_BOXES)
def _tess(extents: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    return _boxes(extents, width, height, True)


def boxes(extents: Column, width: Column, height: Column, tess: bool = False) -> Column:
    """Boxes of extents (k, minx, miny, maxx, maxy) in order of k, one pixel wider each way.

    A missing k gets a box between its neighbours; two missing together end the list,
    and without k = 1 it is empty. tess: y counts from the bottom. A null extent is left out.
    """
    return (_tess if tess else _plain)(extents, width, height)
