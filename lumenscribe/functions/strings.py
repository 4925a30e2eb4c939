"""String functions of the front end: lines, stripping, case, word order, random text."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenscribe.functions.draws import below, between

#: Where a text breaks into lines: every break that Python's splitlines knows.
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SENTENCE_END = r"\. "
_SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def strip(text: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+"))


def sentences(text: Column, more_than: int) -> Column:
    """Stripped sentences of more words than that, in order."""
    parts = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), SENTENCE_END)
    # no further than the word that makes it enough; possessive, so that a short sentence is read once
    enough = f"^[{SPACE}]*+" + (f"(?:[^{SPACE}]++[{SPACE}]++){{{more_than}}}" if more_than > 0 else "") + f"[^{SPACE}]"
    return F.transform(F.filter(parts, lambda s: s.rlike(enough) if more_than >= 0 else s.isNotNull()), lambda s: F.btrim(s, F.lit(_SPACES)))


def change_case(text: Column, case: str | None) -> Column:
    if case not in (None, "upper", "lower"):
        raise ValueError(f"no such case: {case}")
    return text if case is None else F.upper(text) if case == "upper" else F.lower(text)


def reverse_words(text: Column) -> Column:
    """Words in reverse order, as lines of right-to-left text are laid out."""
    return F.array_join(F.reverse(F.split(text, " ")), " ")


def pool(letters: bool = True, numbers: bool = True, symbols: bool = True, lang: str = "en") -> str:
    """The alphabet of random text; with every kind off, all are on."""
    if not (letters or numbers or symbols):
        letters = numbers = symbols = True
    out = ""
    if letters:
        spans = {"cn": [(0x4E00, 0x9FCC)], "ja": [(0x3000, 0x303F), (0x3040, 0x309F), (0x30A0, 0x30FF), (0xFF00, 0xFFEF), (0x4E00, 0x9FCC)]}
        out += "".join(chr(c) for span in spans[lang] for c in range(*span)) if lang in spans else string.ascii_letters
    if numbers:
        out += string.digits
    if symbols:
        out += "".join(sorted(set(string.punctuation) - set("<=>")))
    return out


def random_text(seed: int, key: Column, alphabet: str, length: int, variable: bool, lang: str = "en") -> Column:
    """length words (or 1 .. length) of 2 to 10 characters, 1 or 2 in Chinese and Japanese."""
    low, high = (1, 2) if lang in ("cn", "ja") else (2, 10)
    words = between(seed, "words", key, 1, length) if variable else F.lit(length)

    def word(w: Column) -> Column:
        at = F.concat_ws(".", key.cast("string"), w.cast("string"))
        char = lambda c: F.substring(F.lit(alphabet), (below(seed, c, at, len(alphabet)) + 1).cast("int"), 1)
        return F.array_join(F.transform(F.sequence(F.lit(1), between(seed, "size", at, low, high).cast("int")), char), "")

    return F.array_join(F.transform(F.sequence(F.lit(1), words.cast("int")), word), " ")
