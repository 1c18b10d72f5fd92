"""WARC archives: one gzip member a record, read sequentially with incremental zlib, content-length framing and digest checks."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, put_file, shuffle_partitions, written

CHUNK = 1 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as one gzip member."""
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + z.compress(block + b"\r\n\r\n") + z.flush()


def urn(key) -> str:
    """The name of a page: its key with signs that a header can't hold escaped; of a null key one that no key has."""
    return "<urn:null>" if key is None else f"<urn:page:{quote(str(key), safe='')}>"


def key_of(name: str) -> str | None:
    return unquote(name.removeprefix("<urn:page:").removesuffix(">")) if name.startswith("<urn:page:") else None


def page_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone, whose Content-Length still is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return member(head, http + payload)
    return member([*head, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", urn(refers_to))], http)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a stream of gzip members, holding one record at a time.

    Raises ValueError for a cut member, a wrong length, or what is no WARC record.
    """
    raw = b""
    while True:
        if not raw and not (raw := stream.read(CHUNK)):
            return
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not raw and not (raw := stream.read(CHUNK)):
                raise ValueError("a gzip member is cut off")
            parts.append(z.decompress(raw))
            raw = z.unused_data
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no WARC record")
        headers = dict(x.split(": ", 1) for x in lines)
        n = int(headers["Content-Length"])
        if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
            raise ValueError("Content-Length does not match the record")
        yield headers, rest[:n]


def page_of(headers: dict[str, str], block: bytes) -> dict:
    """The page of a record; the payload of a response is checked against length and digest."""
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
    if kind == "response" and (len(payload) != n or payload_digest(payload) != digest):
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} does not match its digest")
    name = lambda k: key_of(headers.get(k, ""))
    return {"page_id": name("WARC-Record-ID"), "url": headers["WARC-Target-URI"], "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": name("WARC-Refers-To"), "html": payload.decode("utf-8", "surrogatepass") if kind == "response" else None}


def write_archives(pages: DataFrame, out: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of pages into archives below out; gives (path, n_records, key_type), one row an archive.

    Null html is an empty payload. Of records with equal payloads of at least least_bytes bytes, that with the smallest
    key is the response and the others revisit it; smaller ones are all responses. Rows that repeat the smallest key are
    all responses; null keys are larger than all others and revisit like them. Only keys and digests are grouped, and of
    them only digests that occur twice are joined back, so a payload of any number of copies costs no task more than its
    rows' keys. Keys may be of any type that a string can be cast to. Rows stay in the partitions in which the join with
    the revisits leaves them, which splits repeated rows, so no archive has all rows of a key.
    """
    kind = pages.schema[key].dataType.simpleString()
    d = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(html), F.lit("")).alias("h")).withColumn("g", F.sha2("h", 256))
    of = written(d.where(F.octet_length("h") >= least_bytes).select("k", "g"), "digests")
    many = of.groupBy("g").agg(F.min("k").alias("to"), F.count("*").alias("n")).where("n > 1 AND to IS NOT NULL").select("g", "to")
    again = of.join(many, "g").where("k IS NULL OR k > to").select("k", "g", "to").distinct()
    named = lambda: F.sha2(F.concat_ws(":", F.coalesce(F.col("k").cast("string"), F.lit("null")), "g"), 256)
    again = written(again.select(named().alias("id"), F.col("to")), "revisits")
    d = d.withColumn("id", named()).join(again, "id", "left").select("k", "u", "h", "to")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, count = f"{out}/{TaskContext.get().partitionId():06d}.warc.gz", [0]

        def fill(f):
            f.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{TaskContext.get().partitionId()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            for b in batches:
                for k, u, h, to in zip(b["k"], b["u"], b["h"], b["to"]):
                    payload = h.encode("utf-8", "surrogatepass")
                    f.write(page_record(None if pd.isna(k) else k, u, payload, payload_digest(payload), None if pd.isna(to) else to))
                    count[0] += 1

        put_file(path, fill)
        yield pd.DataFrame({"path": [path], "n_records": count, "key_type": kind})

    keys = d.select(F.col("k").cast("string").alias("k"), "u", "h", F.col("to").cast("string").alias("to"))
    return written(keys.mapInPandas(write, "path string, n_records long, key_type string"), "archives")


def read_archives(paths: DataFrame, key_type: str | None = None, with_html: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, html]) of all pages in the archives of column path.

    Keys get the type that column key_type of paths names, or key_type, or stay strings. A task reads one archive after another, one record at a time.
    """
    fields = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["html"] * with_html]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                store, path = file_system(p)
                with store.open_input_stream(path, compression=None) as f:
                    rows, held = [], 0
                    for headers, block in records(f):
                        if headers["WARC-Type"] in ("response", "revisit"):
                            rows.append(page_of(headers, block))
                            held += len(block)
                        if held > 32 << 20 or len(rows) >= 5000:
                            yield pd.DataFrame(rows)[fields]
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows)[fields]

    n = max(shuffle_partitions(paths.sparkSession), 1)
    text = paths.select("path").repartition(n, "path").mapInPandas(read, ", ".join(f"{x} {'long' if x == 'payload_bytes' else 'string'}" for x in fields))
    if key_type is None and "key_type" in paths.columns:
        key_type = (paths.select("key_type").first() or ["string"])[0]
    return text.withColumns({c: F.col(c).cast(key_type or "string") for c in ("page_id", "refers_to")})
