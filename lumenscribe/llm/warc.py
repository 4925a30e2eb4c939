"""WARC files: a writer, and a sequential reader spread over files.

A file holds one gzip member per record. The reader inflates a member as its bytes
come, takes the header, then exactly Content-Length bytes of block, and compares
the block's SHA-1 with the record's digest. What is wrong with a record is its
status; the reader then looks for the next gzip member and goes on.

The writer names a file by its partition and renames it when complete; where the name is
taken, by an earlier attempt of the same task, that file stays. So a task that runs
again, or twice, leaves the same files.

Defined cases: a null url or html comes back as null, an empty one as empty; a null
key as null; keys may be of any type that casts to text and back; control characters in
a url are percent-encoded; headers may be of any length; repeated rows are records each;
an empty table gives an empty result; extra columns are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscribe.llm.common import col
from lumenscribe.session import run_dir

CHUNK, ROLL_BYTES, BATCH_BYTES, LEVEL = 1 << 18, 1 << 30, 4 << 20, 6
KEY_URI, NULL_URI = "urn:record:", "urn:null-record:"
FIELDS = [("page_id", pa.string()), ("url", pa.string()), ("html", pa.string()), ("n_bytes", pa.int64()), ("status", pa.string())]
RECORD = "page_id string, url string, html string, n_bytes bigint, status string"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (pafs.LocalFileSystem(), uri) if "://" not in uri else pafs.FileSystem.from_uri(uri)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block, usedforsecurity=False).digest()).decode()


def record_bytes(key: str | int | None, url: str | None, html: str | None, level: int = LEVEL) -> bytes:
    """One record as one gzip member."""
    block = (html or "").encode()
    head = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <{NULL_URI if key is None else KEY_URI + quote(str(key), safe='')}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if html is None:
        head.append("X-Null-Block: true")
    head += ["Content-Type: text/html", f"WARC-Block-Digest: {digest(block)}", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def settle(fs: pafs.FileSystem, temp: str, name: str) -> None:
    """Give a complete file its name; one that has it, of an earlier attempt with the same rows, stays."""
    try:
        fs.move(temp, name)
    except OSError:
        if fs.get_file_info(name).type != pafs.FileType.File:
            raise
        fs.delete_file(temp)


def write_warc(pages: DataFrame, out: str, key: str = "page_id", url: str = "url", html: str = "html", level: int = LEVEL, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write pages as WARC files under out; file, records, bytes of each file written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, home = open_fs(out)
        fs.create_dir(home, recursive=True)
        task, part = TaskContext.get(), 0
        file = size = count = None
        done = []

        def close():
            nonlocal file, part
            file.close()
            settle(fs, temp(), f"{home}/{name()}")
            done.append((name(), count, size))
            file, part = None, part + 1

        name = lambda: f"part-{task.partitionId():06d}-{part:04d}.warc.gz"
        temp = lambda: f"{home}/.{name()}.{task.taskAttemptId()}"
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if file is None:
                    file, size, count = fs.open_output_stream(temp()), 0, 0
                size += file.write(member := record_bytes(*row, level)) or len(member)
                count += 1
                if size >= roll_bytes:
                    close()
        if file is not None:
            close()
        yield pa.record_batch([pa.array([d[k] for d in done], t) for k, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))], names=["file", "records", "bytes"])

    narrow = pages.select(col(key).cast("string").alias("k"), col(url).alias("u"), col(html).alias("h"))
    listing = f"{out}/_written"
    narrow.mapInArrow(write, "file string, records bigint, bytes bigint").write.parquet(listing)
    return pages.sparkSession.read.schema("file string, records bigint, bytes bigint").parquet(listing)


class _Member:
    """Inflated bytes of the gzip member at a place in a file, as they are asked for."""

    def __init__(self, file, at: int, chunk: int):
        file.seek(at)
        self.file, self.at, self.chunk, self.read, self.have, self.z = file, at, chunk, 0, bytearray(), zlib.decompressobj(31)

    def more(self) -> bool:
        if self.z.eof:
            return False
        raw = self.z.unconsumed_tail or self.file.read(self.chunk)
        if not raw:
            raise EOFError
        if not self.z.unconsumed_tail:
            self.read += len(raw)
        self.have += self.z.decompress(raw, 4 * self.chunk)
        return True

    def header(self) -> bytes:
        """All up to the first empty line, which only the member's end bounds."""
        seen = 0
        while (k := self.have.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.have)
            if not b"WARC/".startswith(self.have[:5]) and not self.have.startswith(b"WARC/") or not self.more():
                raise ValueError("bad header")
        out = bytes(self.have[:k])
        del self.have[: k + 4]
        if not out.startswith(b"WARC/"):
            raise ValueError("bad header")
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.have) < n and self.more():
            pass
        out = bytes(self.have[:n])
        del self.have[:n]
        return out

    def rest(self) -> bytes:
        while self.more():
            if len(self.have) > 4:  # more than a record's end: it need not be kept
                del self.have[5:]
        return bytes(self.have)

    def end(self) -> int:
        return self.at + self.read - len(self.z.unused_data)


def read_records(file, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], bytes | None, str]]:
    """(headers, block, status) of each gzip member, in order.

    Status: ok, bad gzip, bad header, bad length, bad digest or truncated.
    """
    at, size = 0, file.size()
    while at < size:
        head, block, member = {}, None, _Member(file, at, chunk)
        try:
            lines = member.header().decode("utf-8", "replace").split("\r\n")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            n = int(head.get("content-length", "")) if head.get("content-length", "").isdigit() else -1
            if n < 0:
                raise ValueError("bad header")
            block = member.exactly(n)
            status = "ok" if member.rest() == b"\r\n\r\n" and len(block) == n else "bad length"
            if status == "ok" and (told := head.get("warc-block-digest")) and told != digest(block):
                status = "bad digest"
            at = member.end()
        except (zlib.error, EOFError, ValueError) as problem:
            status = {zlib.error: "bad gzip", EOFError: "truncated"}.get(type(problem), "bad header")
            try:  # the next record begins where a sound member ends
                if status != "bad header":
                    raise problem
                member.rest()
                at = member.end()
            except (zlib.error, EOFError):
                at = _next_member(file, at + 1, chunk)
        yield head, block, status


def _next_member(file, at: int, chunk: int) -> int:
    """The next place with a gzip magic, or the end."""
    file.seek(at)
    tail = b""
    while raw := file.read(chunk):
        data = tail + raw
        if (k := data.find(b"\x1f\x8b\x08")) >= 0:
            return at - len(tail) + k
        at, tail = at + len(raw), data[-2:]
    return file.size()


def read_warc(spark: SparkSession, path: str, key_type: str = "bigint") -> DataFrame:
    """page_id, url, html, n_bytes, status of each record of the .warc.gz files under path.

    A file is one task's, as members can't be found without reading; Spark packs
    small files together by size.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        pack = lambda: pa.record_batch([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(FIELDS)], names=[n for n, _ in FIELDS])
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, place = open_fs(uri)
                with fs.open_input_file(place) as file:
                    for head, block, status in read_records(file):
                        if head.get("warc-type") == "warcinfo":
                            continue
                        key = head.get("warc-record-id", "")[1:-1]
                        key = unquote(key.removeprefix(KEY_URI)) if key.startswith(KEY_URI) else None
                        html = None if block is None or "x-null-block" in head else block.decode("utf-8", "replace")
                        out.append((key, head.get("warc-target-uri"), html, len(block or b""), status))
                        held += len(block or b"")
                        if held > BATCH_BYTES:
                            yield pack()
                            out, held = [], 0
        if out:
            yield pack()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    found = files.select("path").mapInArrow(rows, RECORD)
    return found.withColumn("page_id", F.expr(f"try_cast(page_id as {key_type})"))


SQL = """
select page_id, url, html, octet_length(encode(coalesce(html, '')))::bigint as n_bytes, 'ok' as status from pages
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC files and read back."""
    home = run_dir(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), home)
    return read_warc(spark, home)
