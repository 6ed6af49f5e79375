"""WARC archives: written with one gzip member a record, read back sequentially.

Each task writes its rows as archive segments (rows of a table in the shared folder, each the bytes of one .warc.gz
file of bounded size, or of one record). The reader inflates member after member with one zlib stream at a time and a
bounded buffer, takes header lines up to the empty one, frames the block by Content-Length, and verifies the digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import MAYBE, Bitmap, arrow_bounded, join_uneven, release, stash, text_or_empty, whole_id
from lodestar.llm.textnum import batches

#: Bytes of a segment; a record larger than that has one of its own.
SEGMENT = 4 << 20
#: Equal payloads of at least so many bytes are written once.
LEAST = 1000
READ = 64 << 10
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(head.encode() + block + b"\r\n\r\n") + c.flush()


def _clean(value: str) -> str:
    """Header values hold no line ends or other controls."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def base32_of(sha1: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()


def page_record(page_id: str, url: str, payload: bytes | None, refers_to: str | None, digest: str | None = None, size: int | None = None, date: str | None = None, mark: str = "") -> bytes:
    """A response, the payload behind a minimal HTTP head, or a revisit of another page's payload, of which digest and size suffice."""
    digest = base32_sha1(payload) if digest is None else base32_of(digest)
    size = len(payload) if size is None else size
    kind = "response" if refers_to is None else "revisit"
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}\n{url}\n{digest}\n{mark}")
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", date or now()), ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", digest), ("X-Payload-Length", str(size)), ("X-Page-ID", page_id), ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
        return record([*headers, ("WARC-Block-Digest", base32_sha1(block))], block)
    return record([*headers, ("WARC-Profile", REVISIT), ("X-Refers-To-Page-ID", refers_to)], b"")


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def info_record(date: str, mark: str) -> bytes:
    """What a segment begins with."""
    block = b"software: lodestar\r\nformat: WARC File Format 1.1\r\n"
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, mark)}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", base32_sha1(block))], block)


def members(chunks: Iterator[bytes]) -> Iterator[Iterator[bytes]]:
    """The inflated parts of each gzip member, in order; at most READ bytes at a time."""
    chunks = iter(chunks)
    rest = b""

    def one() -> Iterator[bytes]:
        nonlocal rest
        z = zlib.decompressobj(31)
        while not z.eof:
            if not rest:
                rest = next(chunks, b"")
                if not rest:
                    raise ValueError("a gzip member is cut short")
            part = z.decompress(rest, READ)
            rest = z.unused_data if z.eof else z.unconsumed_tail
            if part:
                yield part

    while True:
        if not rest:
            rest = next(chunks, b"")
            if not rest:
                return
        yield one()


class Corrupt(ValueError):
    """A record whose framing or digest is wrong."""


def read_records(chunks: Iterator[bytes], verify: bool = True) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of an archive given as chunks of bytes; the payload of an HTTP block is what follows its head."""
    for member in members(chunks):
        head, body = b"", bytearray()
        want = None
        headers: dict[str, str] = {}
        for part in member:
            if want is None:
                head += part
                cut = head.find(b"\r\n\r\n")
                if cut < 0:
                    continue
                lines = head[:cut].decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise Corrupt("no WARC version line")
                headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                want = int(headers["Content-Length"])
                part = head[cut + 4 :]
            body += part
        if want is None:
            raise Corrupt("no end of headers")
        block, end = bytes(body[:want]), bytes(body[want:])
        if len(block) != want or end != b"\r\n\r\n":
            raise Corrupt(f"the block has {len(body) - 4} bytes, Content-Length says {want}")
        if verify and "WARC-Block-Digest" in headers and base32_sha1(block) != headers["WARC-Block-Digest"]:
            raise Corrupt("the block's digest differs")
        if headers.get("Content-Type", "").startswith("application/http") and block:
            head, gap, block = block.partition(b"\r\n\r\n")
            if not gap or not head.startswith(b"HTTP/"):
                raise Corrupt("no HTTP head")
        yield headers, block


def read_file(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a .warc.gz file."""
    with Path(path).open("rb") as f:
        yield from read_records(iter(lambda: f.read(READ), b""))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None) -> DataFrame:
    """Segments (n_records, warc) of all rows, written to the shared folder. date: WARC-Date of all records, by default the time of the call.

    Of rows with equal payloads of at least LEAST bytes that with the largest id is the response. Payloads are compared
    by SHA-256 and length. Which rows revisit is settled on digests alone; payloads are written where they are read, but
    for those of repeated digests that may be responses, which meet their digests' rows first.
    """
    date = date or now()
    html = text_or_empty(html_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("size"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    large, small = rows.filter(F.col("size") >= LEAST), rows.filter(F.col("size") < LEAST)
    sizes = stash(large.select("page_id", "url", "size", digest.alias("digest"), F.sha1(F.col("html").cast("binary")).alias("sha1")), "digests")
    many = sizes.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1 and keep is not null")
    many = stash(many, "repeated")
    again = join_uneven(sizes, many, "digest", "n", F.col("page_id")).filter(~F.col("page_id").eqNullSafe(F.col("keep")))

    # payloads whose digest is surely not repeated are written at once; of the others only those that may be their
    # digest's response, or that passed the filter by chance, meet the digests
    filtered = Bitmap(many, "digest")
    chance = stash(filtered.maybe(sizes.select("digest"), F.col("digest")).join(many, "digest", "left_anti"), "chance")
    marked = filtered.mark(large.withColumn("digest", digest), F.col("digest"))
    once = marked.filter(~F.col(MAYBE)).select("page_id", "url", "html")
    rest = Bitmap(chance, "digest").mark(marked.filter(F.col(MAYBE)).drop(MAYBE), F.col("digest")).withColumnRenamed(MAYBE, "by_chance")
    rest = Bitmap(many, "digest", "keep").mark(rest, F.col("digest"), F.col("page_id")).filter(F.col("by_chance") | F.col(MAYBE)).drop("by_chance", MAYBE)
    settled = join_uneven(rest, many, "digest", "n", F.col("page_id"), "left")
    settled = settled.filter(F.col("keep").isNull() | F.col("page_id").eqNullSafe(F.col("keep"))).select("page_id", "url", "html")
    whole = once.unionByName(settled).unionByName(small.select("page_id", "url", "html"))
    nothing = F.lit(None).cast("string")
    mark = F.monotonically_increasing_id().cast("string").alias("mark")
    shape = [whole_id("page_id").alias("page_id"), "url"]
    every = whole.select(*shape, "html", nothing.alias("refers_to"), nothing.alias("sha1"), F.lit(0).cast("long").alias("size"))
    every = every.unionByName(again.select(*shape, F.lit("").alias("html"), whole_id("keep").alias("refers_to"), "sha1", "size"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size, n = [], 0, 0
        for pdf in batches(frames, "html"):
            for page, url, text, ref, sha1, length, mark in pdf[["page_id", "url", "html", "refers_to", "sha1", "size", "mark"]].itertuples(index=False):
                if not parts:
                    parts, size, n = [info_record(date, f"{date}\n{mark}")], 0, 0
                if ref is None:
                    parts.append(page_record(page or "", url, text.encode("utf-8", "replace"), None, date=date, mark=mark))
                else:
                    parts.append(page_record(page or "", url, None, ref, sha1, length, date, mark))
                n += 1
                size += len(parts[-1])
                if size >= SEGMENT:
                    yield pd.DataFrame({"n_records": [n], "warc": [b"".join(parts)]})
                    parts = []
        if parts:
            yield pd.DataFrame({"n_records": [n], "warc": [b"".join(parts)]})

    return stash(arrow_bounded(every.select("*", mark)).mapInPandas(write, "n_records long, warc binary"), "warc")


def read_archives(segments: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of each record."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for warc in pdf["warc"]:
                out = []
                for headers, payload in read_records(warc[a : a + READ] for a in range(0, len(warc), READ)):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    if headers["WARC-Type"] == "response" and base32_sha1(payload) != headers["WARC-Payload-Digest"]:
                        raise Corrupt("the payload's digest differs")
                    out.append((headers["X-Page-ID"] or None, int(headers["X-Payload-Length"]), base64.b32decode(headers["WARC-Payload-Digest"][5:]).hex(), headers["WARC-Type"], headers.get("X-Refers-To-Page-ID"), headers["WARC-Target-URI"]))
                yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
        release()

    found = arrow_bounded(segments).mapInPandas(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string")
    return found.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write, then read back: page_id, payload_bytes, payload_digest, record_type, refers_to for every row.

    Null html is an empty payload, null urls are empty; rows repeated with the response's id are responses too; a null
    id is written empty, is smaller than any, and if all rows of a payload have null ids they are all responses. An empty
    table gives an empty result. Other columns are dropped.
    """
    return read_archives(write_archives(pages)).drop("url")
