import random
import re
import string
import unicodedata

import pytest
from pyspark.sql import functions as F

from lumenscribe.functions import arabic, glyphs, naming, strings, thai
from lumenscribe.operators import frontend, generators, layout
from lumenscribe.sources import text as sources


def one(spark, column, value=""):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("v")).first()["v"]


def test_lines_break_as_in_python(spark):
    text = "a\r\nb\x0bc d\n\ne\rf\x85g h"
    assert one(spark, strings.lines(F.col("text")), text) == text.splitlines()
    assert one(spark, strings.strip(F.col("text")), "  \tx y　\n") == "x y"


def test_numbering_is_dense_in_any_partitioning(spark):
    values = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "v int")
    for n in (1, 7):
        got = frontend.numbered(df.repartition(n), "v").collect()
        assert sorted((r["idx"], r["v"]) for r in got) == list(enumerate(sorted(values)))
    assert frontend.numbered(df.limit(0), "v").count() == 0


def test_cycle_and_errors(spark):
    items = spark.createDataFrame(list(enumerate(["TEST1", "TEST2", "x" * 300])), "pos bigint, text string")
    got = {r["idx"]: r["text"] for r in generators.from_strings(generators.requests(spark, 6), items).collect()}
    assert got[1] == got[4] == "TEST1" and got[2] != got[1] and got[3] == "x" * 200
    with pytest.raises(ValueError):
        generators.from_strings(generators.requests(spark, 1), items.limit(0)).count()


def test_dictionary_words(spark):
    words = spark.createDataFrame(list(enumerate(["TEST"] * 4)), "pos bigint, word string")
    got = generators.from_dict(generators.requests(spark, 2), words, 1, 3).collect()
    assert [r["text"] for r in got] == ["TEST TEST TEST"] * 2
    lengths = {len(r["text"].split()) for r in generators.from_dict(generators.requests(spark, 100), words, 1, 3, True).collect()}
    assert lengths == {1, 2, 3}


@pytest.mark.parametrize("kinds,lang,allowed", [
    ((True, False, False), "en", string.ascii_letters), ((False, True, False), "en", string.digits), ((False, False, True), "en", set(string.punctuation) - set("<=>")),
    ((False, False, False), "en", string.printable), ((True, False, False), "cn", {chr(c) for c in range(0x4E00, 0x9FCC)}),
])
def test_random_alphabets(spark, kinds, lang, allowed):
    rows = generators.from_random(generators.requests(spark, 50), 3, 4, False, *kinds, lang).collect()
    again = generators.from_random(generators.requests(spark, 50).repartition(5), 3, 4, False, *kinds, lang).collect()
    assert {r["idx"]: r["text"] for r in rows} == {r["idx"]: r["text"] for r in again}
    low, high = (1, 2) if lang == "cn" else (2, 10)
    for r in rows:
        words = r["text"].split(" ")
        assert len(words) == 4 and all(low <= len(w) <= high for w in words) and set("".join(words)) <= set(allowed)


def test_thai_by_a_second_statement(spark):
    marks = "ัำิีึืฺุู็่้๊๋์ํ๎"
    for text in ("น้ำใจ", "a😀b\nก็", "์กำ", "", "เก้าอี้"):
        want = re.findall(f"[฀-๿][{marks}]*|.", text, re.S)
        assert one(spark, thai.clusters(F.col("text")), text) == want
    parts = one(spark, thai.decompose(F.col("text")), "น้ำ").asDict()
    assert parts == {"base": "น", "leading": "", "upper_vowel": "", "upper_tone": "้", "upper_diacritic": "ํ", "lower": "", "trailing": "า", "is_sara_am": True}
    assert one(spark, thai.normalize(F.col("text")), "น้ำ") == "นํ้า"
    assert one(spark, thai.reorder(F.col("text")), "ก่ิ") == "กิ่"


def test_names(spark):
    assert one(spark, naming.safe_name(F.col("text")), 'a<b>:"/\\|?*\x01c' + "é" * 300) == "abc" + "é" * 197
    assert one(spark, naming.safe_name(F.col("text"), compose=True), "é") == "é"
    idx = F.lit(7)
    names = [one(spark, naming.sample_name(F.col("text"), idx, k, w), "a b") for k, w in ((0, 1), (1, 1), (2, 1), (3, 1), (0, 0))]
    assert names == ["a b_7", "7_a b", "7", "a b_7", "ab_7"]
    assert naming.parse_margins("3") == (3, 3, 3, 3) and naming.parse_margins("1,2,3,4") == (1, 2, 3, 4)
    assert naming.parse_colors("#fff,black") == [(255, 255, 255), (0, 0, 0)]
    with pytest.raises(ValueError):
        naming.parse_margins("1,2")
    assert one(spark, naming.bucket(F.lit(50_000_123))) == "10000"


def test_font_and_glyph_sources(spark, tmp_path):
    for name in ("b.ttf", "a.ttf", "c.otf"):
        (tmp_path / name).write_bytes(b"x")
    got = sources.fonts(spark, str(tmp_path), True).orderBy("pos").collect()
    assert [r["font"].rsplit("/", 1)[1] for r in got] == ["a.ttf", "b.ttf"]
    assert sources.fonts(spark, str(tmp_path)).count() == 3
    path = tmp_path / "words.txt"
    path.write_text("one\ntwo\x0bthree\n\none\n")
    assert [r["word"] for r in sources.dictionary(spark, str(path)).orderBy("pos").collect()] == ["one", "two", "three", "one"]
    (tmp_path / "empty.txt").write_text("\n")
    with pytest.raises(ValueError):
        sources.string_file(spark, str(tmp_path / "empty.txt"))
    assert glyphs.FIELD_OF_ROLE["SARA_AA"] == "trailing"


def test_segments_cover_the_text(spark):
    text = "ab é c日本 "
    runs = one(spark, layout.support_segments(F.col("text"), "a-z"), text)
    assert "".join(r["segment"] for r in runs) == text
    assert [r["supported"] for r in runs] == [True, False, True, False, True]


def test_arabic_letters_take_the_forms_of_their_place():
    forms = lambda text, **how: [unicodedata.name(c).rsplit(" ", 2)[-2] for c in arabic.shape(text, **how) if c != " "]
    assert forms("ببب ب") == ["INITIAL", "MEDIAL", "FINAL", "ISOLATED"]
    assert forms("باب") == ["INITIAL", "FINAL", "ISOLATED"]
    assert arabic.shape("سلام") == "\ufeb3\ufefc\ufee1" and arabic.shape("لا") == "\ufefb"
    assert arabic.shape("ب\u064eب") == "\ufe91\u064e\ufe90" and arabic.shape("ب\u064eب", delete_harakat=True) == "\ufe91\ufe90"
    assert arabic.shape("abc 12") == "abc 12" and arabic.shape("") == ""
    assert forms("گچ") == ["INITIAL", "FINAL"]


def test_visual_order():
    assert arabic.display("abc") == "abc" and arabic.display("") == "" and arabic.display("12 (3)") == "12 (3)"
    assert arabic.display("אבג 12 דה") == "הד 12 גבא"
    assert arabic.display("אב (ג)") == "(ג) בא"
    assert arabic.display("see אב גד now") == "see דג בא now"
    assert arabic.display("אב see now גד") == "דג see now בא"


def test_arabic_columns(spark):
    df = spark.createDataFrame([("سلام لا",), ("plain text",), (None,), ("",)], "t string")
    got = [tuple(r) for r in df.select(arabic.displayed(arabic.shaped(F.col("t"))), arabic.by_word(F.col("t"))).collect()]
    both = arabic.display(arabic.shape("سلام لا"))
    assert got == [(both, " ".join(arabic.display(arabic.shape(w)) for w in ("لا", "سلام"))), ("plain text", "text plain"), (None, None), ("", "")]


def test_dictionaries_of_languages_and_font_folders(spark, tmp_path):
    words = [r["word"] for r in sources.language_words(spark, "fr").orderBy("pos").collect()]
    assert len(words) == len(set(words)) > 50 and words[0] == "le"
    with pytest.raises(ValueError):
        sources.language_words(spark, "xx")
    (tmp_path / "xx.txt").write_text("one\ntwo\n")
    assert sources.language_words(spark, "xx", str(tmp_path)).count() == 2
    (tmp_path / "th").mkdir()
    (tmp_path / "latin").mkdir()
    assert sources.font_folder(spark, str(tmp_path), "th").endswith("/th") and sources.font_folder(spark, str(tmp_path), "en").endswith("/latin")


def test_batches_are_worked_on_in_slices(spark, monkeypatch):
    import pyarrow as pa

    from lumenscribe.functions import naming
    from lumenscribe.operators import layout
    from lumenscribe.session import slices

    texts = [None, "", "ab", "é" * 30, "a" * 100, "xyz"] * 40
    parts = slices(pa.array(texts), 64)
    assert [t for p in parts for t in p.to_pylist()] == texts and len(parts) > 40
    assert [len(p) for p in slices(pa.array([], pa.string()), 64)] == [0]
    sizes, place = [], layout._place
    monkeypatch.setattr(layout, "_place", lambda part, *a: sizes.append(len(part)) or place(part, *a))
    monkeypatch.setattr(layout, "SLICE_BYTES", 64)
    laid = layout.laid_out.__globals__["_place"](pa.array(texts), layout.grid_metrics, 32, 0, True)
    split = pa.concat_arrays([place(p, layout.grid_metrics, 32, 0, True) for p in parts])
    assert laid.to_pylist() == split.to_pylist()
    df = spark.createDataFrame([(0, "é" * 3), (1, "plain"), (2, None), (3, "")], "k int, t string")
    assert [r[0] for r in df.orderBy("k").select(naming.safe_name(df.t, True)).collect()] == ["é" * 3, "plain", None, ""]


def test_sentences_of_enough_words(spark):
    import random

    from pyspark.sql import functions as F

    from lumenscribe.functions import strings

    draw = random.Random(2)
    texts = ["".join(draw.choice([" ", "　", "\x85", "\t", "a", "b", "é", ". "]) for _ in range(draw.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    space = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0x3000]))
    for n in (-1, 0, 1, 4):
        want = [[p.strip(space) for p in t.replace("\n", " ").split(". ") if len(p.split()) > n] for t in texts]
        assert [r[0] for r in df.select(strings.sentences(F.col("t"), n)).collect()] == want
