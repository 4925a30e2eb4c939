import gzip
import io
import zlib

import pytest
from pyarrow import fs as pafs

from lumenscribe.llm import warc
from lumenscribe.session import run_dir


class Sized(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def read(raw, chunk=64):
    return [(h.get("warc-record-id"), b, s) for h, b, s in warc.read_records(Sized(raw), chunk)]


def member(*row):
    return warc.record_bytes(*row)


def test_members_are_framed_by_content_length():
    tricky = "a\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n" * 50
    raw = member(1, "u", tricky) + member(2, "u", "") + member(3, None, None) + member(4, "u\r\nX: y", "é" * 5000)
    out = read(raw)
    assert [s for _, _, s in out] == ["ok"] * 4
    assert out[0][1].decode() == tricky and out[3][1].decode() == "é" * 5000
    assert read(raw, 7) == out and read(b"") == []


def test_what_is_wrong_is_told_and_the_next_record_is_read():
    good, other = member(1, "u", "hello world"), member(2, "u", "second")
    body = gzip.decompress(good)
    wrong = lambda old, new: gzip.compress(body.replace(old, new)) + other
    assert [s for *_, s in read(wrong(b"hello", b"jello"))] == ["bad digest", "ok"]
    assert [s for *_, s in read(wrong(b"Length: 11", b"Length: 99"))] == ["bad length", "ok"]
    assert [s for *_, s in read(wrong(b"Length: 11", b"Length: 10"))] == ["bad length", "ok"]
    assert [s for *_, s in read(wrong(b"Length: 11", b"Length: x"))] == ["bad header", "ok"]
    assert [s for *_, s in read(wrong(b"WARC/1.0", b"HTTP/1.0"))] == ["bad header", "ok"]
    assert [s for *_, s in read(other + good[:-20])] == ["ok", "truncated"]
    broken = bytearray(good)
    broken[30] ^= 255
    assert read(bytes(broken) + other)[-1][2] == "ok"


def test_a_bad_header_costs_its_own_record_only():
    """Chance gzip magics inside a sound member are no records; headers of any length are read."""
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    noise = stored.compress(b"HTTP/1.0\r\n\r\n" + b"\x1f\x8b\x08" * 50) + stored.flush()
    assert [s for *_, s in read(noise + member(2, "u", "x"))] == ["bad header", "ok"]
    out = read(member(1, "u" * 3_000_000, "x"), 1 << 16)
    assert out[0][1:] == (b"x", "ok")


def test_a_name_that_is_taken_keeps_its_file(tmp_path):
    class NoReplace:
        def __init__(self):
            self.fs = pafs.LocalFileSystem()

        def move(self, a, b):
            if self.fs.get_file_info(b).type != pafs.FileType.NotFound:
                raise OSError("exists")
            self.fs.move(a, b)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    (tmp_path / "t1").write_text("one")
    (tmp_path / "t2").write_text("two")
    for temp in ("t1", "t2"):
        warc.settle(NoReplace(), str(tmp_path / temp), str(tmp_path / "part"))
    assert (tmp_path / "part").read_text() == "one" and not (tmp_path / "t2").exists()
    with pytest.raises(OSError):
        warc.settle(NoReplace(), str(tmp_path / "t3"), str(tmp_path / "other"))


def test_text_keys(spark):
    home = run_dir(spark, "test-warc")
    rows = [("a b>\r\n", "u", "x"), ("", "u", "y"), (None, "u", "z"), ("é%41", None, "")]
    warc.write_warc(spark.createDataFrame(rows, "name string, url string, html string"), home, "name")
    assert {tuple(r)[:3] for r in warc.read_warc(spark, home, "string").collect()} == set(rows)


@pytest.mark.parametrize("roll", [1, 1 << 30])
def test_round_trip(spark, roll):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, None, "y"), (3, "", ""), (4, "http://a", None), (None, "http://b", "z"), (1, "http://a/1", "<p>x</p>"), (5, "u", "long " * 100_000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, status string").repartition(3)
    home = run_dir(spark, "test-warc")
    listing = warc.write_warc(pages, home, roll_bytes=roll)
    assert listing.agg({"records": "sum"}).first()[0] == len(rows)
    out = warc.read_warc(spark, home).collect()
    assert sorted(((r[0], r[1], r[2]) for r in out), key=str) == sorted(rows, key=str)
    assert {r["status"] for r in out} == {"ok"}
    assert all(r["n_bytes"] == len((r["html"] or "").encode()) for r in out)


def test_empty(spark):
    home = run_dir(spark, "test-warc")
    warc.write_warc(spark.createDataFrame([], "page_id bigint, url string, html string"), home)
    assert warc.read_warc(spark, home).count() == 0
