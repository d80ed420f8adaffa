"""Alignment of two tokenizers over a corpus, by the bytes of their tokens.

Method: external spill counting. A task turns texts into pair-document records (B id, A id, document, times)
and spills them as a run whenever its buffer is full: sorted by B id, then A id, and radix-partitioned by a mix
of the pair, each part in zstd blocks. A run's head has its pairs with their subtotals, so that only a pair's
number in a run is shuffled, never its documents; a pair of a third of all links is one entry a run. Runs are
merged part by part with a heap, 2^FAN_BITS at once and in rounds beyond that, which counts each pair. As
runs are sorted by B id first, the largest count of each B id comes with the same pass. Then totals go back down
the same merges to the runs, where the records of each pair give their documents what the pair adds.

A merging task holds a block of each of its runs; a run's records meet its totals one part at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, keep, keep_counted, small_batches, table, tasks_for, text_bytes
from .words import mix, slices
from .workers import lean

RUN_LINKS = 2_000_000
"""Links that a task holds before it spills them as a run; one text is never cut."""
BLOCK = 8192
"""Pairs of a block of a run's head."""
FAN_BITS = 8
"""About 2^FAN_BITS runs at most are merged at once."""
PART_TEXT = 64 << 20
"""Bytes of text for each radix part."""
MOST_PARTS = 4096
TABLE_WORDS = 250_000
"""Words whose ids a worker keeps, for each tokenizer."""

Pairs = tuple[np.ndarray, np.ndarray]


def token_bytes(byte_level: str, pieces: str) -> tuple[list[bytes], list[bytes]]:
    """The bytes that each id of the two vocabularies stands for."""
    import sentencepiece
    from tokenizers import Tokenizer

    own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a byte-level entry shows as themselves
    shown = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    vocabulary = Tokenizer.from_file(byte_level).get_vocab(with_added_tokens=True)
    a = [b""] * (1 + max(vocabulary.values()))
    for text, i in vocabulary.items():
        a[i] = bytes(shown[c] for c in text) if all(c in shown for c in text) else text.encode()
    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    b = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    return a, b


class Aligner:
    """Aligns texts: encode gives ids whose bytes are the text's, align their groups and links."""

    def __init__(self, byte_level: str, pieces: str):
        self.a, self.b = token_bytes(byte_level, pieces)
        if max(len(self.a), len(self.b)) > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a, self.b))
        # decimal ids with what may follow them: of A "," and "|", then of B "," and ";"
        ends = [f"{i}{end}".encode() for n, marks in ((len(self.a), ",|"), (len(self.b), ",;")) for i in range(n) for end in marks]
        self.shown_size = np.fromiter(map(len, ends), np.int64, len(ends))
        self.shown = np.frombuffer(b"".join(e.ljust(6, b"\0") for e in ends), np.uint8).reshape(-1, 6)

    def encode(self, texts: list[bytes], encoders) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; none for an empty text and for one whose tokens are other bytes than a space and the text."""
        first, second = encoders
        strings = [t.decode() for t in texts]
        a = first.encode([" " + s for s in strings])
        b = second.encode(strings)
        for i, t in enumerate(texts):
            want = b" " + t
            if not t or b"".join([self.a[k] for k in a[i].tolist()]) != want or b"".join([self.b[k] for k in b[i].tolist()]) != want:
                a[i] = b[i] = np.zeros(0, np.uint32)
        return a, b

    def align(self, a_ids: list[np.ndarray], b_ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Of all texts: a pair of ids (B first) for each link, its text; numbers of groups, digests of groups by text."""
        n_texts = len(a_ids)
        a, b = (np.concatenate([np.zeros(0, np.uint32), *x]).astype(np.int64) for x in (a_ids, b_ids))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_first, b_first = (np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64) for ids in (a_ids, b_ids))
        text_end = np.concatenate([[0], a_end])[a_first[1:]]
        n_bytes = int(text_end[-1]) if n_texts else 0
        is_a, is_b = np.zeros(n_bytes + 1, bool), np.zeros(n_bytes + 1, bool)
        is_a[a_end], is_b[b_end] = True, True
        # between two ends that follow each other lies the overlap of one token of each side
        ends = np.flatnonzero(is_a | is_b)
        link_a, link_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        pairs = (b[link_b] << 16 | a[link_a]).astype(np.uint32)
        texts = np.searchsorted(text_end, ends).astype(np.uint32)
        groups = np.flatnonzero(is_a & is_b)  # a text's end is one of them
        n_groups = np.diff(np.concatenate([[0], np.searchsorted(groups, text_end, "right")]))
        # decimal ids of each group, A before B
        a_group, b_group = np.searchsorted(groups, a_end), np.searchsorted(groups, b_end)
        a_count, b_count = (np.bincount(x, minlength=len(groups)) for x in (a_group, b_group))
        before_a, before_b = np.cumsum(a_count), np.cumsum(b_count) - b_count
        shown = np.zeros(len(a) + len(b), np.int64)
        shown[np.arange(len(a)) + before_b[a_group]] = 2 * a + is_b[a_end]
        shown[np.arange(len(b)) + before_a[b_group]] = 2 * (len(self.a) + b) + is_a[b_end]
        sizes = self.shown_size[shown]
        text = self.shown[shown][np.arange(6) < sizes[:, None]].tobytes()
        at = np.concatenate([[0], np.cumsum(sizes)])[a_first + b_first].tolist()
        digests = [hashlib.sha256(text[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(at[:-1], at[1:], strict=True)]
        return pairs, texts, n_groups, digests


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal rank together, which compress well where numbers are small."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def head_of(blocks: Iterator[Pairs]) -> bytes:
    """Sorted pairs and their numbers as framed zstd blocks of at most BLOCK pairs."""
    z, out = zstandard.ZstdCompressor(level=1), []
    for pairs, n in blocks:
        for lo in range(0, len(pairs), BLOCK):
            p = pairs[lo : lo + BLOCK].astype(np.uint32)
            steps = np.diff(p, prepend=np.uint32(0))
            data = z.compress(_planes(steps) + _planes(n[lo : lo + BLOCK].astype(np.uint64)))
            out.append(struct.pack("<II", len(p), len(data)) + data)
    return b"".join(out)


def blocks_of(head: bytes) -> Iterator[Pairs]:
    z, at = zstandard.ZstdDecompressor(), 0
    while at < len(head):
        n, size = struct.unpack_from("<II", head, at)
        data = z.decompress(head[at + 8 : at + 8 + size])
        yield np.cumsum(_unplanes(data[: 4 * n], np.uint32), dtype=np.uint32), _unplanes(data[4 * n :], np.uint64)
        at += 8 + size


def merged(runs: list[Iterator[Pairs]]) -> Iterator[Pairs]:
    """Sorted runs of pairs and numbers as one, numbers of a pair summed; holds a block of each run.

    One heap has the first pair of each run's block, another the last. What lies up to the least last pair
    is whole in the blocks at hand.
    """
    at: dict[int, Pairs] = {}
    firsts: list[tuple[int, int]] = []
    lasts: list[tuple[int, int]] = []

    def load(i: int) -> None:
        block = next(runs[i], None)
        if block is not None:
            at[i] = block
            heapq.heappush(firsts, (int(block[0][0]), i))
            heapq.heappush(lasts, (int(block[0][-1]), i))

    for i in range(len(runs)):
        load(i)
    while firsts:
        bound, taken = lasts[0][0], []
        while firsts and firsts[0][0] <= bound:
            _, i = heapq.heappop(firsts)
            p, n = at[i]
            k = int(np.searchsorted(p, bound, "right"))
            taken.append((p[:k], n[:k]))
            if k < len(p):
                at[i] = p[k:], n[k:]
                heapq.heappush(firsts, (int(p[k]), i))
        while lasts and lasts[0][0] == bound:
            load(heapq.heappop(lasts)[1])
        p, n = (np.concatenate(x) for x in zip(*taken, strict=True))
        order = np.argsort(p, kind="stable")
        p = p[order]
        start = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        yield p[start], np.add.reduceat(n[order], start)


def maxima(blocks: Iterator[Pairs], seen: dict[int, int]) -> Iterator[Pairs]:
    """Passes counted pairs on and notes the largest count of each B id."""
    for pairs, n in blocks:
        b = (pairs >> np.uint32(16)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        for i, most in zip(b[start].tolist(), np.maximum.reduceat(n, start).tolist(), strict=True):
            seen[i] = max(seen.get(i, 0), most)
        yield pairs, n


def _spilled(byte_level: str, pieces: str, n_parts: int, run_links: int):
    """Texts to rows of two kinds: of a document (run, doc and its columns), and of a part of a run (run, part, node, head, body)."""

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import plain_encoders

        encoders, own = plain_encoders(byte_level, pieces, TABLE_WORDS), Aligner(byte_level, pieces)
        task, serial, doc = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def run() -> int:
            return task << 24 | serial

        def flush() -> pa.RecordBatch:
            pairs, docs = (np.concatenate(x) for x in zip(*held, strict=True))
            key, times = np.unique(pairs.astype(np.uint64) << np.uint64(32) | docs, return_counts=True)
            pairs, docs = (key >> np.uint64(32)).astype(np.uint32), key.astype(np.uint32)
            part = (mix(pairs.astype(np.uint64)) >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)
            node = int(mix(np.array([run()], np.uint64))[0] >> np.uint64(33))
            z, rows = zstandard.ZstdCompressor(level=1), []
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(n_parts + 1, dtype=np.uint64))
            for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                own_rows = order[edges[k] : edges[k + 1]]
                p, d, t = pairs[own_rows], docs[own_rows], times[own_rows].astype(np.uint32)
                start = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
                n = np.diff(np.append(start, len(p))).astype(np.uint32)
                body = z.compress(struct.pack("<I", len(n)) + _planes(n) + _planes(d) + _planes(t))
                rows.append({"run": run(), "part": k, "node": node, "head": head_of(iter([(p[start], np.add.reduceat(t.astype(np.uint64), start))])), "body": body})
            return pa.RecordBatch.from_pylist(rows, schema=_SPILL)

        for batch, texts in slices(batches):
            a, b = own.encode(texts, encoders)
            pairs, text, n_groups, digests = own.align(a, b)
            n_links = np.bincount(text, minlength=len(texts))
            yield pa.RecordBatch.from_pydict(
                {
                    "run": np.full(len(texts), run()), "doc": np.arange(doc, doc + len(texts)), "doc_id": batch.column("doc_id"), "n_a": [len(x) for x in a], "n_b": [len(x) for x in b],
                    "n_groups": n_groups, "n_links": n_links, "groups_sha256": digests, **{n: pa.nulls(len(texts), _SPILL.field(n).type) for n in ("part", "node", "head", "body")},
                },
                schema=_SPILL,
            )
            if len(pairs):
                held.append((pairs, text + np.uint32(doc)))
            doc, size = doc + len(texts), size + len(pairs)
            if size >= run_links:
                yield flush()
                held, size, doc, serial = [], 0, 0, serial + 1
        if held:
            yield flush()
        for e in encoders:
            e.shrink()

    return spill


_SPILL = pa.schema([("run", pa.int64()), ("doc", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("part", pa.int32()), ("node", pa.int64()), ("head", pa.binary()), ("body", pa.binary())])
SPILL = "run long, doc long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, part int, node long, head binary, body binary"


def _grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that follow each other with equal keys."""
    now, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            own = tuple(r[k] for k in keys)
            if own != now and rows:
                yield now, rows
                rows = []
            now = own
            rows.append(r)
    if rows:
        yield now, rows


def _merge(top: bool):
    """Heads of the nodes below each (part, parent) to one head; of the top also the largest counts by B id."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, parent), rows in _grouped(batches, "part", "parent"):
            seen: dict[int, int] = {}
            blocks = merged([blocks_of(r["head"]) for r in rows])
            head = head_of(maxima(blocks, seen) if top else blocks)
            most = struct.pack(f"<{2 * len(seen)}Q", *seen, *seen.values())
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "node": pa.array([parent], pa.int64()), "head": pa.array([head], pa.binary()), "most": pa.array([most], pa.binary())})

    return merge


def _hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each (part, parent) has its own head with totals and those of the nodes below, which get the same pairs' totals."""
    for _, rows in _grouped(batches, "part", "parent"):
        pairs, totals = (np.concatenate(x) for x in zip(*blocks_of(rows[0]["head"]), strict=True))
        for r in rows[1:]:
            own = np.concatenate([p for p, _ in blocks_of(r["head"])])
            head = head_of(iter([(own, totals[np.searchsorted(pairs, own)])]))
            yield pa.RecordBatch.from_pydict({"part": pa.array([r["part"]], pa.int32()), "node": pa.array([r["node"]], pa.int64()), "run": pa.array([r["run"]], pa.int64()), "head": pa.array([head], pa.binary())})


def _contributions(most):
    """Of each run its records and, part by part, the totals of its pairs: (run, doc, n_best, count_sum) of its documents."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        largest = most.value
        now, best, total = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            some = np.flatnonzero(total)
            return pa.RecordBatch.from_pydict({"run": np.full(len(some), now, np.int64), "doc": some, "n_best": best[some], "count_sum": total[some]})

        z = zstandard.ZstdDecompressor()
        for (run, _), (records, counted) in _grouped(batches, "run", "part"):
            if run != now:
                if now is not None:
                    yield rows()
                now, best, total = run, np.zeros(0, np.int64), np.zeros(0, np.int64)
            data = z.decompress(records["body"])
            n_pairs = struct.unpack_from("<I", data)[0]
            n = _unplanes(data[4 : 4 + 4 * n_pairs], np.uint32)
            doc, times = _two(data[4 + 4 * n_pairs :])
            pairs, counts = (np.concatenate(x) for x in zip(*blocks_of(counted["head"]), strict=True))
            is_best = counts == largest[pairs >> np.uint32(16)]
            if len(doc) and doc.max() >= len(total):
                more = int(doc.max()) + 1 - len(total)
                best, total = (np.concatenate([x, np.zeros(max(more, len(x)), np.int64)]) for x in (best, total))
            each = times.astype(np.int64)
            np.add.at(total, doc, each * np.repeat(counts.astype(np.int64), n))
            np.add.at(best, doc, each * np.repeat(is_best, n))
        if now is not None:
            yield rows()

    return add


def _two(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(data) // 2
    return _unplanes(data[:half], np.uint32), _unplanes(data[half:], np.uint32)


def align_documents(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", run_links: int = RUN_LINKS, fan_bits: int = FAN_BITS) -> DataFrame:
    """One row for each input row: doc_id, n_a, n_b (tokens), n_groups (of bytes where tokens of both end), n_links (pairs
    of tokens that overlap), n_best (links whose pair of ids is linked most often in the corpus for its B id, ties
    included), count_sum (how often pairs are linked in the corpus, summed over links), groups_sha256.

    byte_level: a tokenizers file, A, of space and text; pieces: a sentencepiece model, B, of the text. Special tokens
    in a text are plain text. Null and empty texts, and texts that either side changes, have zeros and no digest. Rows of one id, equal
    ones too, and rows with a null id are documents of their own. An empty table gives no rows; extra columns are
    ignored. One text is held whole by one task, with about 100 bytes for each of its own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n_parts = min(MOST_PARTS, tasks_for(spark, text_bytes(docs, text_col), PART_TEXT))
    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    spilled = keep(chosen.mapInArrow(lean(_spilled(byte_level, pieces, n_parts, run_links)), SPILL), "spilled")
    runs = spilled.filter("part is not null")
    n_runs = runs.agg(F.approx_count_distinct("run")).first()[0]
    # merges of about 2^fan_bits runs at most, in rounds: a node is the upper bits of a mix of its run
    bits = max(1, n_runs).bit_length()
    depth = -(-bits // fan_bits)
    level = runs.select("part", F.shiftright("node", 31 - bits).alias("node"), "run", "head")
    levels, used = [], []
    for k in range(depth):
        top = k == depth - 1
        level = level.withColumn("parent", F.lit(0).cast("long") if top else F.shiftright("node", fan_bits))
        levels.append(level)
        up = level.select("part", "parent", "head").repartition("part", "parent").sortWithinPartitions("part", "parent")
        used.append(keep(up.mapInArrow(lean(_merge(top)), "part int, node long, head binary, most binary"), f"merged-{k}"))
        level = used[-1].withColumn("run", F.lit(None).cast("long"))
    largest = np.zeros(len(token_bytes(byte_level, pieces)[1]), np.uint64)
    for (data,) in level.select("most").toLocalIterator():  # at most an entry a part and B id
        b, n = np.frombuffer(data, "<u8").reshape(2, -1)
        np.maximum.at(largest, b.astype(np.int64), n)
    most = spark.sparkContext.broadcast(largest)  # a number for each B id
    totals = level
    for k in reversed(range(depth)):
        above = totals.select("part", F.col("node").alias("parent"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("run"), "head")
        below = levels[k].select("part", "parent", "node", "run", "head")
        both = above.unionByName(below).repartition("part", "parent").sortWithinPartitions("part", "parent", F.col("node").asc_nulls_first())
        totals = keep(both.mapInArrow(lean(_hand_down), "part int, node long, run long, head binary"), f"totals-{k}")
        used.append(totals)
    records = runs.select("run", "part", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("head"), "body")
    counted = totals.select("run", "part", F.lit(1).alias("kind"), "head", F.lit(None).cast("binary").alias("body"))
    meet = records.unionByName(counted).repartition("run").sortWithinPartitions("run", "part", "kind")
    sums = meet.mapInArrow(lean(_contributions(most)), "run long, doc long, n_best long, count_sum long")
    out = spilled.filter("part is null").join(sums, ["run", "doc"], "left")
    zero = F.lit(0).cast("long")
    out = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
    out = keep(out, "aligned")
    drop(spilled, *used)
    return out


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, aligned between a byte-level and a sentencepiece vocabulary."""
    import public_tokenizers

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
