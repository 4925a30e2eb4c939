"""Thai text: grapheme clusters, decomposition, reordering, class tests.

Patterns are written so that Java and RE2 read them alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SARA_AA, SARA_AM, NIKHAHIT = "า", "ำ", "ํ"
LEADING = r"\x{0E40}-\x{0E44}"
UPPER_VOWEL = r"\x{0E31}\x{0E34}-\x{0E37}\x{0E47}"
LOWER = r"\x{0E38}-\x{0E3A}"
TONE = r"\x{0E48}-\x{0E4B}"
DIACRITIC = r"\x{0E4C}-\x{0E4E}"
UPPER = UPPER_VOWEL + TONE + DIACRITIC
ANY = r"\x{0E00}-\x{0E7F}"
CLUSTER = rf"(?s)[{ANY}][\x{{0E31}}\x{{0E33}}\x{{0E34}}-\x{{0E3A}}\x{{0E47}}-\x{{0E4E}}]*|."
RUN = rf"(?s)[^{UPPER}{LOWER}{LEADING}][{UPPER}{LOWER}{LEADING}\x{{0E32}}]*|."
#: What follows the base of a run, in the order it is put out.
RUN_ORDER = (UPPER_VOWEL + LOWER, DIACRITIC, TONE, r"\x{0E32}" + LEADING)
PARTS = {"leading": LEADING, "upper_vowel": UPPER_VOWEL, "upper_tone": TONE, "upper_diacritic": DIACRITIC, "lower": LOWER}


def clusters(text: Column) -> Column:
    """A Thai character with the marks after it; every other code point alone."""
    return F.regexp_extract_all(text, F.lit(CLUSTER), F.lit(0))


def only(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, f"[^{chars}]", "")


def decompose(cluster: Column) -> Column:
    """A struct of the cluster's characters by class; SARA AM becomes NIKHAHIT and SARA AA."""
    am = F.coalesce(cluster.contains(SARA_AM), F.lit(False))
    parts = {k: only(cluster, chars) for k, chars in PARTS.items()}
    parts["upper_diacritic"] = F.when(am, F.concat(F.lit(NIKHAHIT), parts["upper_diacritic"])).otherwise(parts["upper_diacritic"])
    base = F.regexp_replace(cluster, rf"[{UPPER}{LOWER}{LEADING}\x{{0E33}}]", "")
    trailing = F.when(am, F.lit(SARA_AA)).otherwise(F.lit(""))
    return F.struct(base.alias("base"), *(v.alias(k) for k, v in parts.items()), trailing.alias("trailing"), am.alias("is_sara_am"))


def reorder(text: Column) -> Column:
    """After each base: vowels and lower signs, diacritics, tones, trailing vowels; each in its own order."""

    def run(r: Column) -> Column:
        rest = F.substring(r, 2, 2**31 - 1)
        return F.concat(F.substring(r, 1, 1), *(only(rest, chars) for chars in RUN_ORDER))

    moved = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), run), "")
    return F.when(text.rlike(f"[{UPPER}{LOWER}{LEADING}]"), moved).otherwise(text)  # most texts have no marks


def normalize(text: Column) -> Column:
    return reorder(F.replace(text, F.lit(SARA_AM), F.lit(NIKHAHIT + SARA_AA)))


def has_upper(text: Column) -> Column:
    return text.rlike(f"[{UPPER}]")


def has_lower(text: Column) -> Column:
    return text.rlike(f"[{LOWER}]")


def contains_thai(text: Column) -> Column:
    return text.rlike(f"[{ANY}]")


def sql_reorder(text: str) -> str:
    """reorder as DuckDB SQL."""
    parts = " || ".join(f"regexp_replace(substr(r, 2), '[^{chars}]', '', 'g')" for chars in RUN_ORDER)
    return f"array_to_string(list_transform(regexp_extract_all({text}, '{RUN}'), lambda r: substr(r, 1, 1) || {parts}), '')"
