"""WARC archives: writing records and a splittable reader.

An archive is gzip members one after another, one for each record. The reader deals byte
ranges of archives to tasks. A task looks for gzip magic in its range, takes a place for a
record only if what is decoded there starts with a WARC header, and owns the records that
start inside its range; it reads past the end for the last one. So archives of any size are
read in parallel, with no index.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, keep, scratch_path, small_batches, table, tasks_for
from .files import new_file, reader
from .workers import lean

MAGIC = b"\x1f\x8b\x08"
REVISIT_FROM = 100
"""Payloads of fewer bytes are always stored."""
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(kind: str, record_id: str, uri: str, digest: str, payload: bytes, payload_bytes: int, refers_to: str | None = None) -> bytes:
    """One record as a gzip member. Header values are on one line each; other line breaks become spaces."""
    uri = " ".join(uri.split())
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:row:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {payload_bytes}", "Content-Type: text/html"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:row:{refers_to}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(payload)}"]).encode()
    z = zlib.compressobj(6, wbits=31)
    return z.compress(head + b"\r\n\r\n" + payload + b"\r\n\r\n") + z.flush()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes one record for each page below path; returns path and n_bytes of each archive.

    Of rows with equal payloads of at least 100 bytes the one with the smallest id is a response,
    the others are revisits of it; rows of that same id are all responses. Null html is an empty payload,
    a null url an empty URI. A row with a null id revisits a row with one; if all copies have null ids,
    they are responses. An empty table writes no archive. Extra columns are ignored. One very long page
    is one record, held whole by its task; beyond it a task holds one Arrow batch.

    Digests come first, so a payload is compressed only where it is stored. Pages meet the smallest
    id of their digest in a join that AQE splits where a digest is crowded.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    digest, n = F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes")
    chosen = pages.select(pages[id_col].cast("long").alias("page_id"), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"), html.alias("html"), digest, n)
    first = chosen.filter(F.col("payload_bytes") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = keep(first.select("digest", "first"), "copies")
    joined = chosen.join(copies, "digest", "left")
    stored = F.col("first").isNull() | (F.col("page_id") == F.col("first"))
    # a revisit carries no payload; a null id too
    rows = joined.select("page_id", "url", "digest", "payload_bytes", F.when(F.coalesce(stored, F.lit(False)), F.col("html")).alias("html"), "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, at = f"{path}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        batch = next(batches, None)
        if batch is None:
            return
        with new_file(uri) as out:
            while batch is not None:
                for page_id, url, digest, n, html, target in zip(*batch.columns, strict=True):
                    page_id, url, digest, n = page_id.as_py(), url.as_py(), digest.as_py(), n.as_py()
                    name = "null" if page_id is None else str(page_id)
                    if html.is_valid:
                        record = member("response", name, url, digest, html.as_py().encode(), n)
                    else:
                        record = member("revisit", name, url, digest, b"", n, str(target.as_py()))
                    out.write(record)
                    at += len(record)
                batch = next(batches, None)
        yield pa.RecordBatch.from_pydict({"path": [uri], "n_bytes": pa.array([at], pa.int64())})

    archives = keep(rows.mapInArrow(lean(write), "path string, n_bytes long"), "archives")
    drop(copies)
    return archives


def _header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


class _Window:
    """Bytes of an open file by place, read ahead in chunks, so that reading on reads each byte once."""

    def __init__(self, file, chunk: int):
        self.file, self.chunk, self.size = file, chunk, file.size()
        self.at, self.data = 0, b""

    def view(self, place: int, least: int = 1) -> memoryview:
        """What is held from place on; at least so many bytes, fewer only at the end of the file."""
        lo = place - self.at
        if lo < 0 or lo + least > len(self.data):
            kept = self.data[lo:] if 0 <= lo < len(self.data) else b""
            self.file.seek(place + len(kept))
            self.data = kept + self.file.read(min(max(self.chunk, least - len(kept)), max(0, self.size - place - len(kept))))
            self.at, lo = place, 0
        return memoryview(self.data)[lo:]


def records_in(file, lo: int, hi: int, chunk: int = 1 << 18) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, header, content) of the records that start in [lo, hi) of an open archive."""
    window, at = _Window(file, chunk), lo
    while at < hi:
        held = len(window.view(at, len(MAGIC)))
        k = window.data.find(MAGIC, at - window.at)
        if k < 0:
            at += max(1, held - len(MAGIC) + 1)
            continue
        start = window.at + k
        if start >= hi:
            return
        found = _member(window, start)
        if found is None:
            at = start + 1
            continue
        header, content, used = found
        yield start, header, content
        at = start + used


def _length(header: dict[str, str], name: str) -> int | None:
    """A length that a header states; None where it states none or no number."""
    n = header.get(name, "").strip()
    return int(n) if n.isascii() and n.isdigit() and len(n) < 19 else None


def _member(window: _Window, start: int, piece: int = 1 << 14) -> tuple[dict[str, str], bytes, int] | None:
    """The record whose gzip member starts at a place, or None if there is none."""
    z, parts, place = zlib.decompressobj(wbits=31), [], start
    try:
        while not z.eof:
            data = window.view(place)[:piece]
            if not len(data):
                return None
            parts.append(z.decompress(data))
            place += len(data)
            if len(parts) == 1 and len(parts[0]) >= 5 and not parts[0].startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    whole = b"".join(parts)
    head, mark, body = whole.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/"):
        return None
    header = _header(head)
    n = _length(header, "content-length")
    return header, body[:n], place - len(z.unused_data) - start


SPLITS_A_TASK = 8
"""Byte ranges that a reading task takes, about, so that tasks grow in number with the archives."""


def read_archives(archives: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """(path, place, type, record_id, refers_to, uri, digest, payload_length, content) of every record.

    archives: columns path and n_bytes. payload_length and refers_to are null where a header lacks them.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split_bytes))
    splits = archives.select("path", "n_bytes", F.explode(starts).alias("lo")).withColumn("hi", F.least(F.col("lo") + split_bytes, "n_bytes"))
    schema = "path string, place long, type string, record_id string, refers_to string, uri string, digest string, payload_length long, content binary"
    types = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def inner(x: str | None) -> str | None:
        return x and x.removeprefix("<urn:row:").removesuffix(">")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("path", "lo", "hi")), strict=True):
                rows, held = [], 0
                with reader(path) as file:
                    for place, h, content in records_in(file, lo, hi):
                        rows.append((path, place, h.get("warc-type"), inner(h.get("warc-record-id")), inner(h.get("warc-refers-to")), h.get("warc-target-uri"), (h.get("warc-payload-digest") or "").removeprefix("sha256:"), _length(h, "x-payload-length"), content))
                        held += len(content)
                        if held > 8 << 20:
                            yield _table(rows, types, names)
                            rows, held = [], 0
                yield _table(rows, types, names)

    n_bytes = archives.agg(F.sum("n_bytes")).first()[0] or 0
    n = tasks_for(archives.sparkSession, n_bytes, SPLITS_A_TASK * split_bytes)
    return splits.repartition(n, "path", "lo").mapInArrow(lean(read), schema)


def _table(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from WARC archives of all pages.

    A response's length and digest are those of its content; a revisit's are its header's.
    """
    archives = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    r = read_archives(archives)
    own = F.col("type") == "response"
    return r.select(
        F.when(F.col("record_id") != "null", F.col("record_id")).cast("long").alias("page_id"),
        F.when(own, F.octet_length("content").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(own, F.sha2("content", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )


OP1_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN f.first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first < page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
