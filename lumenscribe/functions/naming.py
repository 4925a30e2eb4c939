"""File names, sink lines, colours and margins."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenscribe.functions.draws import between
from lumenscribe.session import slices

BUCKET_SIZE = 5000
FORBIDDEN = r'[\x00-\x1f"*/:<>?|\\]'
DERIVED = {"mask_name": "_mask.png", "boxes_name": "_boxes.txt", "tess_name": ".box", "metadata_name": "_metadata.json"}
COLORS = {"black": "#000000", "white": "#ffffff", "red": "#ff0000", "lime": "#00ff00", "green": "#008000", "blue": "#0000ff", "yellow": "#ffff00", "gray": "#808080", "grey": "#808080", "orange": "#ffa500", "purple": "#800080", "brown": "#a52a2a", "pink": "#ffc0cb", "cyan": "#00ffff", "magenta": "#ff00ff", "navy": "#000080"}


@F.arrow_udf(T.StringType())
def _composed(text: pa.Array) -> pa.Array:
    """NFC; Spark has no normalisation of its own. Texts of a megabyte at a time are objects."""
    compose = lambda t: None if t is None else unicodedata.normalize("NFC", t)
    return pa.concat_arrays([pa.array([compose(t) for t in part.to_pylist()], pa.string()) for part in slices(text, 1 << 20)])


def safe_name(name: Column, compose: bool = False) -> Column:
    """Without characters that file systems forbid, 200 characters at most.

    compose first brings composed characters together; texts that are composed
    already, as most are, needn't go through Python for that: ASCII ones don't.
    """
    if compose:
        name = F.coalesce(_composed(F.when(name.rlike(r"[^\x00-\x7f]"), name)), name)
    return F.substring(F.regexp_replace(name, FORBIDDEN, ""), 1, 200)


@F.arrow_udf(T.StringType())
def _ascii(text: pa.Array) -> pa.Array:
    fold = lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
    return pa.array([None if t is None else fold(t) for t in text.to_pylist()], pa.string())


def ascii_name(name: Column) -> Column:
    """Letters without their marks, digits, spaces, underscores and hyphens; 200 characters at most."""
    plain = F.when(name.rlike(r"[^\x00-\x7f]"), _ascii(name)).otherwise(name)
    return F.substring(F.regexp_replace(plain, r"[^A-Za-z0-9_\s\x0b\x1c-\x1f-]", ""), 1, 200)


def sample_name(text: Column, idx: Column, name_format: int, space_width: float = 1.0) -> Column:
    """text_index, index_text (1) or index (2); without spaces if they have no width."""
    text = F.replace(text, F.lit(" "), F.lit("")) if space_width == 0 else text
    idx = idx.cast("string")
    return {1: F.concat(idx, F.lit("_"), text), 2: idx}.get(name_format, F.concat(text, F.lit("_"), idx))


def bucket(idx: Column, size: int = BUCKET_SIZE) -> Column:
    return F.format_string("%04d", F.floor(idx / size).cast("bigint"))


def box_line(b: Column) -> Column:
    return F.concat_ws(" ", *(b[k].cast("string") for k in ("x1", "y1", "x2", "y2")))


def box_file(boxes: Column) -> Column:
    """A line x1 y1 x2 y2 for each box."""
    return F.array_join(F.transform(boxes, lambda b: F.concat(box_line(b), F.lit("\n"))), "")


def tess_file(boxes: Column, text: Column) -> Column:
    """A line: character, box, 0; as many as the shorter of both."""
    n = F.least(F.size(boxes), F.char_length(text))
    line = lambda b, c: F.concat(c, F.lit(" "), box_line(b), F.lit(" 0\n"))
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.zip_with(F.slice(boxes, F.lit(1), n), F.slice(letters, F.lit(1), n), line), "")


def parse_margins(text: str) -> tuple[int, int, int, int]:
    """'n' for all four, or 'top,left,bottom,right'."""
    parts = [int(x) for x in text.split(",")]
    if len(parts) not in (1, 4):
        raise ValueError(f"one margin or four, not {text!r}")
    return tuple(parts * 4 if len(parts) == 1 else parts)


def parse_colors(text: str) -> list[tuple[int, int, int]]:
    """The first and the last of comma-separated colours, as red, green, blue."""
    out = []
    for name in (text.split(",")[0], text.split(",")[-1]):
        code = COLORS.get(name.strip().lower(), name.strip()).lstrip("#")
        code = "".join(c * 2 for c in code) if len(code) == 3 else code
        out.append(tuple(int(code[k : k + 2], 16) for k in (0, 2, 4)))
    return out


def pick_color(seed: int, key: Column, text: str, tag: str = "color") -> Column:
    """A colour between the two, each channel drawn alone."""
    first, last = parse_colors(text)
    return F.struct(*(between(seed, f"{tag}-{c}", key, min(a, b), max(a, b)).cast("int").alias(c) for c, a, b in zip("rgb", first, last)))
