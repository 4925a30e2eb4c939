"""Right-to-left text for a left-to-right renderer: joined letter forms, and visual order.

The forms are those of Unicode's presentation blocks, read from the character database:
a letter with an initial form joins the next letter, one with a final form the one
before; marks are transparent; lam and alef become one glyph.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HARAKAT = "ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۤۧۨ-ۭ"
_MARK = re.compile(f"[{HARAKAT}]")


def _forms() -> dict[str, dict[str, str]]:
    """Letter, or lam and alef, -> kind of form -> character."""
    out: dict[str, dict[str, str]] = {}
    for code in (*range(0xFB50, 0xFBB2), *range(0xFBD3, 0xFC00), *range(0xFE80, 0xFEFD)):
        kind, *parts = unicodedata.decomposition(chr(code)).split()
        letters = "".join(chr(int(p, 16)) for p in parts)
        if len(letters) == 1 or len(letters) == 2 and letters[0] == "ل" and code >= 0xFE80:
            out.setdefault(letters, {}).setdefault(kind.strip("<>"), chr(code))
    return out


FORMS = _forms()


def shape(text: str, delete_harakat: bool = False) -> str:
    """Letters in the forms that their neighbours ask for; delete_harakat drops vowel marks."""
    if delete_harakat:
        text = _MARK.sub("", text)
    out, joins, k = [], False, 0  # joins: whether the letter before reaches out to this one
    while k < len(text):
        c = text[k]
        if _MARK.match(c):
            out.append(c)
            k += 1
            continue
        end = k + 1
        while end < len(text) and _MARK.match(text[end]):
            end += 1
        after = text[end] if end < len(text) else ""
        if c + after in FORMS and after:
            out.append(FORMS[c + after]["final" if joins else "isolated"] + text[k + 1 : end])
            joins, k = False, end + 1
            continue
        forms = FORMS.get(c, {})
        on = "initial" in forms and "final" in FORMS.get(after, {})
        back = joins and "final" in forms
        out.append(forms.get("medial" if on and back else "initial" if on else "final" if back else "isolated", c))
        joins, k = "initial" in forms, k + 1
    return "".join(out)


def display(text: str) -> str:
    """Characters from left to right as they are seen.

    A line has the direction of its first letter. Runs of the other direction, and
    numbers, are turned; what is neutral goes with equal neighbours, else with the line;
    brackets are mirrored where the direction is from right to left.
    """
    kinds = ["R" if (b := unicodedata.bidirectional(c)) in ("R", "AL") else "L" if b == "L" else "N" if b in ("EN", "AN") else "M" if b == "NSM" else "" for c in text]
    base = 1 if next((k for k in kinds if k in "RL" and k), "L") == "R" else 0
    for i, k in enumerate(kinds):
        if k == "M":
            kinds[i] = kinds[i - 1] if i else ""
    levels, strong = [], "R" if base else "L"
    for i, k in enumerate(kinds):
        strong = k if k in ("R", "L") else strong
        levels.append({"R": 1, "L": 2 * base, "N": 2 if strong == "R" or base else 0}.get(k))
    i = 0
    while i < len(levels):
        if levels[i] is not None:
            i += 1
            continue
        j = next((j for j in range(i, len(levels)) if levels[j] is not None), len(levels))
        left, right = (levels[i - 1] if i else base), (levels[j] if j < len(levels) else base)
        side = lambda v: 1 if v == 2 and not base else v  # a number beside right-to-left text counts as such
        levels[i:j] = [side(left) if side(left) == side(right) else base] * (j - i)
        i = j
    chars = [MIRRORED.get(c, c) if v % 2 else c for c, v in zip(text, levels)]
    for level in (2, 1):
        i = 0
        while i < len(chars):
            j = i
            while j < len(chars) and levels[j] >= level:
                j += 1
            if j > i:
                chars[i:j], levels[i:j] = chars[i:j][::-1], levels[i:j][::-1]
            i = max(j, i + 1)
    return "".join(chars)


MIRRORED = dict(zip("()[]{}<>«»", ")(][}{><»«"))


def _mapped(fn) -> object:
    return F.arrow_udf(lambda texts: pa.array([None if t is None else fn(t) for t in texts.to_pylist()], pa.string()), "string")


def shaped(text: Column, delete_harakat: bool = False) -> Column:
    """shape of every text; only texts with Arabic letters need it."""
    return F.when(text.rlike("[\\x{600}-\\x{6ff}]"), _mapped(lambda t: shape(t, delete_harakat))(text)).otherwise(text)


def displayed(text: Column) -> Column:
    return _mapped(display)(text)


def by_word(text: Column) -> Column:
    """Words in reverse order, each shaped and in visual order by itself."""
    return F.when(text.rlike("[\\x{590}-\\x{8ff}]"), _mapped(lambda t: " ".join(display(shape(w)) for w in t.split(" ")[::-1]))(text)).otherwise(F.array_join(F.reverse(F.split(text, " ")), " "))
