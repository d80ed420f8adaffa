"""Token ids as length-delimited binary records, with an index for shuffled reads.

A shard is records one after another: length (uint64), masked checksum of the length
(uint32), data, masked checksum of the data (uint32), little-endian throughout. Data is the
document's id (int64), the width of a token (one byte: 2 or 4) and the tokens. The checksum
is CRC-32, masked by a rotation and a constant so that data which hold checksums of their own
don't check by chance. The index beside a shard holds one uint64 a record: its place.

Documents are dealt by ranges of their id, so shards follow one another in id order and
no task holds more than its range; ids that many rows share are dealt by text too. The ranges
come from the ids alone, so texts are compressed and dealt once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep, scratch_path, small_batches, table, tasks_for, text_bytes
from .files import new_file, reader
from .packed import opened, squeezed_texts
from .words import NULL
from .workers import lean

MOST_SHARDS = 20_000
"""Ranges of ids that are told apart; a larger corpus gets larger shards."""

MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    n = struct.pack("<Q", len(data))
    return b"".join((n, struct.pack("<I", masked(n)), data, struct.pack("<I", masked(data))))


def record(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack("<?qB", doc_id is None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    null, doc_id, width = struct.unpack_from("<?qB", data)
    return None if null else doc_id, np.frombuffer(data, f"<u{width}", offset=10)


def records(file, places: np.ndarray | None = None) -> Iterator[bytes]:
    """Data of all records of a shard in order, or of those at the given places."""
    size, at, i = file.size(), 0, 0
    while at < size if places is None else i < len(places):
        at = at if places is None else int(places[i])
        file.seek(at)
        head = file.read(12)
        n, check = struct.unpack("<QI", head)
        if check != masked(head[:8]):
            raise ValueError(f"bad length at {at}")
        data = file.read(n + 4)
        if len(data) != n + 4 or struct.unpack("<I", data[n:])[0] != masked(data[:n]):
            raise ValueError(f"bad data at {at}")
        yield data[:n]
        at, i = at + n + 16, i + 1


def id_bounds(docs: DataFrame, n: int, id_col: str = "doc_id") -> list[int]:
    """Bounds of n ranges of ids with about equal numbers of rows; an id with many rows is several bounds."""
    n = min(n, MOST_SHARDS)
    ids = F.coalesce(docs[id_col].cast("long"), F.lit(NULL))
    found = docs.agg(F.percentile_approx(ids, [k / n for k in range(1, n)], max(10_000, 20 * n))).first()[0] if n > 1 else None
    return sorted(found or [])


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, width: int = 2, byte_level: bool = True, shard_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, appends end_id and writes shards below path in ascending id order.

    Returns the manifest: shard, path, n_records, n_tokens, n_bytes. Null and empty texts give
    the end id alone; null ids come first; rows of one id follow each other, equal ones too.
    An empty table writes no shard. Extra columns are ignored. width 2 needs ids below 65,536.
    A very long text is held whole by one task, with about 50 bytes for each of its own.
    """
    small_batches(docs.sparkSession)
    bounds = id_bounds(docs, tasks_for(docs.sparkSession, text_bytes(docs, text_col), shard_bytes), id_col)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        own = encoder(tokenizer, byte_level)
        shard = TaskContext.get().partitionId()
        first = next(batches, None)
        if first is None:
            return
        uri, places, at, n_tokens = f"{path}/shard-{shard:06d}.bin", [], 0, 0

        def pieces():
            yield from opened(first)
            for batch in batches:
                yield from opened(batch)

        with new_file(uri) as out:
            for part, texts in pieces():
                found = own.encode([t.decode() for t in texts])
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), found, strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    if width == 2 and ids.max() > 0xFFFF:
                        raise ValueError("ids don't fit in two bytes")
                    data = frame(record(doc_id, ids, width))
                    out.write(data)
                    places.append(at)
                    at += len(data)
                    n_tokens += len(ids)
        with new_file(uri.removesuffix(".bin") + ".idx") as out:
            out.write(np.array(places, "<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [uri], "n_records": pa.array([len(places)], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64()), "n_bytes": pa.array([at], pa.int64())})

    texts = squeezed_texts(docs, id_col, text_col, bounds=bounds)
    dealt = texts.repartitionById(len(bounds) + 1, "part").drop("part").sortWithinPartitions("doc_id", F.col("tkey").bitwiseAND(F.lit(0xFFFFFFFF)))
    return keep(dealt.mapInArrow(lean(write), "shard int, path string, n_records long, n_tokens long, n_bytes long"), "record-manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every record of the shards, a task a shard: start counts the ids of all records before."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))  # one row a shard

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows, size = [], 0
                with reader(path) as file:
                    for data in records(file):
                        doc_id, ids = parse(data)
                        rows.append((doc_id, start, ids.astype("<u4").tobytes()))
                        start += len(ids)
                        size += 4 * len(ids)
                        if size > 4 << 20:
                            yield _ids(rows)
                            rows, size = [], 0
                yield _ids(rows)

    last = manifest.agg(F.max("shard")).first()[0]
    return shards.repartitionById(1 + (last or 0), "shard").mapInArrow(lean(read), "doc_id long, start long, ids binary")


def _ids(rows: list[tuple[int | None, int, bytes]]) -> pa.RecordBatch:
    d, s, i = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(i, pa.binary())], names=["doc_id", "start", "ids"])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place among all ids, their number and checksum, as read back from the shards."""
    import public_tokenizers

    manifest = write_records(table(spark, sf_dir, "documents"), scratch_path(spark, "records"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_records(manifest).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
