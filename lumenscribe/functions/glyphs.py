"""Glyph names and roles as Column expressions, and the rules over glyph parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roles by code point of a uniXXXX name, in the order of the rules.
ROLE_OF_CODE = [
    ("LEADING_VOWEL", "0e4[0-4]"), ("UPPER_VOWEL", "0e3[14567]|0e47"), ("LOWER_VOWEL", "0e3[89a]"), ("TONE", "0e4[89ab]"),
    ("NIKHAHIT", "0e4d"), ("UPPER_DIACRITIC", "0e4[ce]"), ("SARA_AA", "0e32"), ("TRAILING_VOWEL", "0e3[03]|0e45"), ("BASE", "0e(0[1-9a-f]|1[0-9a-f]|2[0-9a-e])"),
]
NIKHAHIT_NAME, SARA_AA_NAME, SARA_AM_NAME = "uni0e4d|nikhahit|bindu|afii59757", "uni0e32|sara_aa|afii59753", "uni0e33|sara_am|saraam|afii59758"
#: The field that a role's box goes to.
FIELD_OF_ROLE = {"BASE": "base", "LEADING_VOWEL": "leading", "UPPER_VOWEL": "upper_vowel", "TONE": "upper_tone", "NIKHAHIT": "upper_diacritic", "UPPER_DIACRITIC": "upper_diacritic", "LOWER_VOWEL": "lower", "SARA_AA": "trailing", "TRAILING_VOWEL": "trailing"}
FIELDS = "base leading upper_vowel upper_tone upper_diacritic lower trailing".split()


def role_rules() -> list[tuple[str, str]]:
    """(role, pattern of the lower-case name); the first that matches holds."""
    return [("NIKHAHIT", NIKHAHIT_NAME), ("SARA_AA", SARA_AA_NAME), *((role, f"^uni({codes})") for role, codes in ROLE_OF_CODE), ("TONE", "tone|mai")]


def role_of_name(name: Column) -> Column:
    out = F.lit("BASE")
    for role, pattern in reversed(role_rules()):
        out = F.when(F.lower(name).rlike(pattern), F.lit(role)).otherwise(out)
    return out


def sql_role_of_name(name: str) -> str:
    return "case " + " ".join(f"when regexp_matches(lower({name}), '{p}') then '{r}'" for r, p in role_rules()) + " else 'BASE' end"


def char_of_code(code: Column) -> Column:
    """A character of a hexadecimal code; chr() knows one byte only."""
    return F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")


def chars_of_name(name: Column, known: Column) -> Column:
    """The characters of a glyph name; known: those that the font's map gives for it and for its stem."""
    stem = F.split(name, r"\.")[0]
    codes = F.substring(stem, 4, 400)
    ligature = name.startswith("uni") & codes.rlike("^([0-9A-Fa-f]{4}){2,}$")
    pieces = F.transform(F.regexp_extract_all(codes, F.lit("[0-9A-Fa-f]{4}"), F.lit(0)), char_of_code)
    single = stem.rlike("^uni[0-9A-Fa-f]{4}$")
    return F.coalesce(F.get(known, F.lit(0)), F.when(ligature, F.array_join(pieces, "")), F.get(known, F.lit(1)), F.when(single, char_of_code(codes)), F.lit(""))


def simple_role(name: Column, middle: Column, em: Column) -> Column:
    """The role of a plain glyph: by name, and a BASE by the height of its middle."""
    role = role_of_name(name)
    by_height = F.when(middle > em * 0.6, "TONE").when(middle > em * 0.4, "UPPER_VOWEL").when(middle < 0, "LOWER_VOWEL").otherwise("BASE")
    return F.when(role == "BASE", by_height).otherwise(role)


def ligature_roles(parts: Column, em: Column) -> Column:
    """Parts (middle, role, ...) of a composite, from the lowest, with their roles.

    Two or more that are all high are a NIKHAHIT with TONEs on it; otherwise a BASE is a
    TONE when high and a LOWER_VOWEL when below the line.
    """
    ordered = F.array_sort(parts)
    stacked = (F.size(parts) >= 2) & F.forall(parts, lambda p: p["middle"] > em * 0.3)

    def role(p: Column, k: Column) -> Column:
        loose = F.when(p["role"] == "BASE", F.when(p["middle"] > em * 0.5, "TONE").when(p["middle"] < 0, "LOWER_VOWEL").otherwise(p["role"])).otherwise(p["role"])
        return p.withField("role", F.when(stacked, F.when(k == 0, "NIKHAHIT").otherwise("TONE")).otherwise(loose))

    return F.transform(ordered, role)


def _union(boxes: Column) -> Column:
    side = lambda k: F.transform(boxes, lambda b: b[k])
    return F.struct(F.array_min(side("x1")).alias("x1"), F.array_min(side("y1")).alias("y1"), F.array_max(side("x2")).alias("x2"), F.array_max(side("y2")).alias("y2"))


def _middle(b: Column) -> Column:
    return (b["y1"] + b["y2"]) / 2


def split_by_height(contours: Column, em: Column, ratio: float) -> tuple[Column, Column]:
    """The contours with their middle above the height, and the others."""
    return F.filter(contours, lambda c: _middle(c) > em * ratio), F.filter(contours, lambda c: _middle(c) <= em * ratio)


def sara_am_parts(contours: Column, em: Column) -> Column:
    """role and box of NIKHAHIT and SARA AA in one outline."""
    high, low = split_by_height(contours, em, 0.4)
    part = lambda role, boxes: F.when(F.size(boxes) > 0, F.struct(F.lit(role).alias("role"), _union(boxes).alias("box")))
    return F.filter(F.array(part("NIKHAHIT", high), part("SARA_AA", low)), lambda p: p.isNotNull())


def stacked_parts(contours: Column) -> Column:
    """NIKHAHIT below and TONE above the widest gap between the contours' middles; a single one is a TONE."""
    ordered = F.array_sort(F.transform(contours, lambda c: F.struct(_middle(c).alias("m"), *(c[k].alias(k) for k in ("x1", "y1", "x2", "y2")))))
    n = F.size(contours)
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.struct((F.get(ordered, k)["m"] - F.get(ordered, k - 1)["m"]).alias("gap"), (-k).alias("at")))
    widest = F.array_max(gaps)
    cut = F.when(widest["gap"] > 0, -widest["at"]).otherwise(F.lit(1))
    part = lambda role, boxes: F.struct(F.lit(role).alias("role"), _union(boxes).alias("box"))
    two = F.array(part("NIKHAHIT", F.slice(ordered, F.lit(1), cut)), part("TONE", F.slice(ordered, cut + 1, F.greatest(n - cut, F.lit(0)))))
    return F.when(n >= 2, two).when(n == 1, F.array(part("TONE", ordered))).otherwise(F.slice(two, 1, 0))
