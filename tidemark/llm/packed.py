"""Texts and number arrays in compact binary columns, so that shuffles stay small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .words import longs, slices
from .workers import lean


def squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def unsqueeze(data: bytes) -> memoryview:
    return memoryview(zstandard.ZstdDecompressor().decompress(data))


def squeezed_texts(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = (), bounds: list[int] | None = None) -> DataFrame:
    """(doc_id, tkey, z, then carry): z is the compressed UTF-8 text, tkey a hash of it
    that tells rows of one id with different texts apart.

    bounds, sorted: adds part, the number of bounds below the id (a null one is the least). An id that
    is several of the bounds is dealt to all its parts, in the order of tkey as an unsigned number.
    """
    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *[docs[c] for c in carry])
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tkey", T.IntegerType()), T.StructField("z", T.BinaryType()), *chosen.schema.fields[2:]])
    if bounds is not None:
        schema.add("part", T.IntegerType())

    def squeeze_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for part, texts in slices(batches):
            keys = np.array([xxhash.xxh32_intdigest(t) for t in texts], np.uint32)
            columns = [part.column(0), pa.array(keys.view(np.int32)), pa.array([z.compress(t) for t in texts], pa.binary()), *part.columns[2:]]
            if bounds is not None:
                ids = longs(part.column(0))
                lo, hi = (np.searchsorted(np.array(bounds, np.int64), ids, side) for side in ("left", "right"))
                columns.append(pa.array((lo + ((hi - lo + 1) * keys.astype(np.int64) >> 32)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return chosen.mapInArrow(lean(squeeze_all), schema)


def opened(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of a batch of squeezed texts with their texts, of about most bytes each."""
    z = zstandard.ZstdDecompressor()
    texts, lo, size = [], 0, 0
    for i, data in enumerate(batch.column("z").to_pylist()):
        texts.append(z.decompress(data) if data else b"")
        size += len(texts[-1])
        if size >= most or i + 1 == batch.num_rows:
            yield batch.slice(lo, i + 1 - lo), texts
            texts, lo, size = [], i + 1, 0
