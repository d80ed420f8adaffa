"""Packing of documents into sequences of a fixed number of tokens.

Method: minimum bin slack. Each bin takes the longest piece left and then, by subset sums
over the lengths that are left (a bit set of the sums that can be reached), the combination
that fills it most; that combination is removed as often as the lengths allow.

Pieces of one length are interchangeable, so the search needs only the histogram of lengths:
at most `capacity` numbers, whatever the size of the corpus. Pieces get their bins by their
rank among those of their length, from counts of each task; no task and no group sees all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep, small_batches, table
from .words import slices
from .workers import lean

CAPACITY = 2048


def fullest(lengths: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """(length, how often) of a combination with the largest sum of at most room.

    Subset sums by a bit set, longer lengths first; a length that may be taken c times enters as
    1, 2, 4, ... copies of itself.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length, c in zip(lengths, counts, strict=True):
        c, copies = min(c, room // length), 1
        while c > 0:
            k = min(copies, c)
            steps.append((length, k, reach))
            reach |= reach << (length * k) & mask
            c, copies = c - k, copies * 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            total -= length * k
            taken[length] = taken.get(length, 0) + k
    return list(taken.items())


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Kinds of bins: (how many, [(length, how often in each), ...])."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out = []
    while left:
        lengths = sorted(left, reverse=True)
        longest, room = lengths[0], capacity - lengths[0]
        left[longest] -= 1
        fit = [n for n in lengths if n <= room and left[n] > 0]
        taken = dict(fullest(fit, [left[n] for n in fit], room)) if fit else {}
        left[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(left[n] // k for n, k in taken.items())
        out.append((times, list(taken.items())))
        for n, k in taken.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return out


def _slots(bins: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first bin, times in a bin, first offset) sorted by length and rank."""
    used: dict[int, int] = {}
    rows, at = [], 0
    for times, taken in bins:
        offset = 0
        for length, k in taken:
            rows.append((length, used.get(length, 0), at, k, offset))
            used[length] = used.get(length, 0) + times * k
            offset += length * k
        at += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces, a written table with columns task, length and rank.

    rank numbers the pieces of one length within one task from 0; lengths are 1 to capacity.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = keep(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "length-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    slots = spark.sparkContext.broadcast(_slots(plan(histogram, capacity)))  # bounded by the patterns
    names = [c for c in pieces.columns if c not in ("task", "rank")]
    # counts grow with the tasks, so they are never broadcast
    ranked = pieces.join(counts.select("task", "length", "before").hint("merge"), ["task", "length"]).select(*names, (F.col("before") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        keys = s[:, 0] << 44 | s[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            row = s[np.searchsorted(keys, length << 44 | rank, "right") - 1] if len(s) else s[:0]
            j = rank - row[:, 1]
            sequence, offset = row[:, 2] + j // row[:, 3], row[:, 4] + j % row[:, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {pieces.schema[n].dataType.simpleString()}" for n in names)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, byte_level: bool, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32, task, rank (and ids).

    A document is its ids and then end_id; longer ones are cut every `capacity` ids.
    """
    small_batches(docs.sparkSession)
    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from .tokens import encoder

        own, task, met = encoder(tokenizer, byte_level), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part, texts in slices(batches):
            rows = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), own.encode([t.decode() for t in texts]), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, lo in enumerate(range(0, len(ids), capacity)):
                    own_ids = ids[lo : lo + capacity].tobytes()
                    n = len(own_ids) // 4
                    rows.append((doc_id, k, lo, n, zlib.crc32(own_ids), task, int(met[n]), *[own_ids] * with_ids))
                    met[n] += 1
            columns = list(zip(*rows, strict=True)) if rows else [()] * (7 + with_ids)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", *["ids"] * with_ids])
        own.shrink()

    return keep(chosen.mapInArrow(lean(cut), schema), "pieces")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, byte_level: bool = False, capacity: int = CAPACITY, with_ids: bool = False, **columns) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Columns: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset. Null and empty
    texts are one piece, the end id. Null ids are kept; rows of one id are packed each for itself.
    An empty table gives no rows; extra columns are ignored.
    """
    return pack(pieces_of(docs, tokenizer, end_id, byte_level, capacity, with_ids, **columns), capacity)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
