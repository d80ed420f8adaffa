"""Removal of passages that an earlier document already has.

Method: fixed-block anchors. A window of W words holds at least one whole block
of the fixed grid of L = W // 2 words, so it is enough to index each document's
non-overlapping L-word blocks and to probe them with every rolling L-word window.
Places that are hit are then extended to the maximal exact repeats: every W-word
window around a hit is compared by two hashes of its word sequence, 96 bits in all,
and runs of windows that start in an earlier document are removed as one passage.

Every step is dealt by window hash, so one passage in many documents is spread
over as many buckets as it has windows, and a task holds one bucket of bounded size.
A task sends one entry for each distinct window that it meets, not one for each copy;
the other copies are decided where they are read. So the entries of the commonest
window are as many as the tasks that read it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, keep, small_batches, table, tasks_for, text_bytes
from .packed import opened, squeeze, squeezed_texts, unsqueeze
from .words import NULL, Words, longs, mix, slices
from .workers import lean

WINDOW = 50
PASSES = 4
BUCKET = 16 << 20
"""Bytes of text that a bucket stands for."""
KNOWN = 1 << 20
"""Windows that a task remembers having sent."""
_PACKS = "bucket int, dealt boolean, n int, payload binary"
_PLACES = "doc_id long, tkey int, places binary"


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def _edges(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _spans(starts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    return zip(starts, np.append(starts[1:], n)[: len(starts)], strict=True)


def _packs(rows: list[tuple[int, int | None, int, bytes]]) -> pa.RecordBatch:
    """Packs of windows (dealt null) for their bucket, and of places (dealt true) for their part of the documents."""
    b, d, n, p = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(d, pa.bool_()), pa.array(n, pa.int32()), pa.array(p, pa.binary())], names=["bucket", "dealt", "n", "payload"])


def _deal(doc: np.ndarray, key: np.ndarray, place: np.ndarray, n_parts: int) -> list[tuple[int, bool, int, bytes]]:
    """Places of documents as one pack for each part of the documents, however many documents they are of."""
    part = (mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(n_parts)).astype(np.int64)  # ids may share factors with n_parts
    order = np.lexsort((place, key, doc, part))
    part, doc, key, place = (x[order] for x in (part, doc.astype(np.int64), key.astype(np.int32), place.astype(np.int32)))
    if len(doc):  # many windows of one block
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (place[1:] != place[:-1])])
        part, doc, key, place = part[new], doc[new], key[new], place[new]
    rows = []
    for lo, hi in _spans(_edges(part), len(part)):
        d, k, p = doc[lo:hi], key[lo:hi], place[lo:hi]
        rows.append((int(part[lo]), True, len(d), squeeze(np.diff(d, prepend=0), k, np.diff(p, prepend=0).astype(np.int32))))
    return rows


def _gather(tab: pa.Table) -> pa.Table:
    """Of one part of the documents: the places of each document as one compressed array."""
    parts = []
    for n, payload in zip(tab["n"].to_pylist(), tab["payload"].to_pylist(), strict=True):
        raw = unsqueeze(payload)
        parts.append((np.cumsum(np.frombuffer(raw[: 8 * n], np.int64)), np.frombuffer(raw[8 * n : 12 * n], np.int32), np.cumsum(np.frombuffer(raw[12 * n :], np.int32)).astype(np.uint32)))
    doc, key, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((place, key, doc))
    doc, key, place = doc[order], key[order], place[order]
    starts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))
    rows = [(int(doc[lo]), int(key[lo]), squeeze(np.unique(place[lo:hi]))) for lo, hi in _spans(starts, len(doc))]
    d, k, p = zip(*rows, strict=True)
    return pa.table({"doc_id": pa.array(d, pa.int64()), "tkey": pa.array(k, pa.int32()), "places": pa.array(p, pa.binary())})


class _Met:
    """Windows that a task has sent: hash, second hash and least id of each; KNOWN of them at most.

    What is forgotten is sent again, so the bound changes no result.
    """

    def __init__(self):
        self.h, self.other, self.least = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def find(self, h: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which windows are known, and their least ids (any where they aren't)."""
        if not len(self.h):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        k = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return (self.h[k] == h) & (self.other[k] == other), self.least[k]

    def add(self, h: np.ndarray, other: np.ndarray, least: np.ndarray) -> None:
        """Notes windows of ascending h; the later of equal h stays."""
        some = np.append(h[1:] != h[:-1], True) if len(h) else np.zeros(0, bool)
        h, other, least = h[some], other[some], least[some]
        if len(self.h) + len(h) > KNOWN:
            self.__init__()
        old = ~np.isin(self.h, h, assume_unique=True)
        both = [np.concatenate(x) for x in ((self.h[old], h), (self.other[old], other), (self.least[old], least))]
        order = np.argsort(both[0], kind="stable")
        self.h, self.other, self.least = (x[order] for x in both)


def _probe(length: int, n_buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks and rolling windows of each batch, one pack for each bucket."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met()  # windows of two documents, with a block of the grid: a hit wherever they are
        for part, texts in slices(batches):
            ids, words = longs(part.column("doc_id")), Words(texts)
            at, h = words.windows(length)
            text = words.text_of()[at]
            at, h, text = (x[ids[text] != NULL] for x in (at, h, text))
            in_text = at - words.first[text]
            block, anchor = in_text // length, in_text % length == 0
            order = np.argsort(h, kind="stable")
            hs, ds, bs = h[order], ids[text[order]], block[order]
            same = hs[1:] == hs[:-1]
            again = np.concatenate([[False], same & (ds[1:] == ds[:-1]) & (bs[1:] == bs[:-1])]) if len(hs) else np.zeros(0, bool)
            order = order[~again]
            hs, ds = h[order], ids[text[order]]
            run = _edges(hs)
            size = np.diff(np.append(run, len(hs)))
            group = np.repeat(np.arange(len(run)), size)
            mixed = (np.maximum.reduceat(ds, run) != np.minimum.reduceat(ds, run)) if len(run) else np.zeros(0, bool)
            grid = np.logical_or.reduceat(anchor[order], run) if len(run) else mixed
            known, _ = met.find(hs[run], hs[run].astype(np.uint32))
            mixed |= known
            here = np.zeros(len(h), bool)  # repeats inside this batch, or of what the task has sent
            here[order] = mixed[group]
            lead = np.ones(len(order), bool)
            lead[mixed[group]] = False
            lead[run] = ~known
            sent = np.zeros(len(h), bool)
            sent[order[lead]] = True
            on_grid = anchor.copy()
            on_grid[order[run]] |= grid & mixed
            new = hs[run][grid & mixed & ~known]
            met.add(new, new.astype(np.uint32), np.zeros(len(new), np.int64))
            i = np.flatnonzero(sent)
            bucket = _bucket(h[i], n_buckets)
            by_bucket = np.argsort(bucket.astype(np.uint32), kind="stable")
            i, bucket = i[by_bucket], bucket[by_bucket]
            rows = []
            for lo, hi in _spans(_edges(bucket), len(i)):
                j = i[lo:hi]
                d = ids[text[j]]
                rows.append((int(bucket[lo]), None, len(j), squeeze(np.diff(d, prepend=0), block[j].astype(np.uint32), np.packbits(on_grid[j])) + h[j].astype(np.uint32).tobytes()))
            j = np.flatnonzero(here)
            yield _packs(rows + _deal(ids[text[j]], np.zeros(len(j)), block[j], n_buckets))

    return probe


def _bucketed(packs: DataFrame, n_buckets: int, f: Callable[[pa.Table], pa.Table | pa.RecordBatch], out: str) -> DataFrame:
    """f of all packs of each bucket; a task holds one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            found = f(pa.Table.from_batches(held))
            yield from [found] if isinstance(found, pa.RecordBatch) else found.to_batches()

    return packs.repartitionById(n_buckets, "bucket").mapInArrow(lean(run), out)


def _gathered(packs: DataFrame, n_buckets: int, f: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
    """(doc_id, tkey, places) of what f finds in each bucket."""
    return _bucketed(_bucketed(packs, n_buckets, f, _PACKS), n_buckets, _gather, _PLACES)


def _read(tab: pa.Table) -> tuple[list, list]:
    """Dealt packs as rows, to be handed on, and (n, payload) of the packs of windows."""
    rows = list(zip(*(tab[c].to_pylist() for c in ("bucket", "dealt", "n", "payload")), strict=True))
    return [r for r in rows if r[1]], [(r[2], r[3]) for r in rows if not r[1]]


def _hits(n_buckets: int) -> Callable[[pa.Table], pa.RecordBatch]:
    """Of one bucket: places whose window is a block of the grid somewhere and occurs in two documents.

    A bucket is sorted in PASSES parts, to hold less at a time.
    """

    def hits(tab: pa.Table) -> pa.RecordBatch:
        found, payloads = _read(tab)
        for k in range(PASSES if payloads else 0):
            parts = []
            for n, payload in payloads:
                raw, h = unsqueeze(payload[: -4 * n]), np.frombuffer(payload[-4 * n :], np.uint32)
                own = np.flatnonzero(h % PASSES == k)
                d = np.cumsum(np.frombuffer(raw[: 8 * n], np.int64))[own]
                grid = np.unpackbits(np.frombuffer(raw[12 * n :], np.uint8), count=n).astype(bool)[own]
                parts.append((h[own], d, np.frombuffer(raw[8 * n : 12 * n], np.uint32)[own], grid))
            h, d, block, grid = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            order = np.argsort(h, kind="stable")
            run = _edges(h[order])
            if len(run):
                ds = d[order]
                hit = (np.maximum.reduceat(ds, run) != np.minimum.reduceat(ds, run)) & np.logical_or.reduceat(grid[order], run)
                j = order[np.repeat(hit, np.diff(np.append(run, len(h))))]
                found += _deal(d[j], np.zeros(len(j)), block[j], n_buckets)
        return _packs(found)

    return hits


def _extend(length: int, window: int, n_buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All full windows around the hits of each document, one pack for each bucket."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met()
        for batch in batches:
            for part, texts in opened(batch):
                ids, keys, words = longs(part.column("doc_id")), longs(part.column("tkey")), Words(texts)
                at, h = words.windows(window)
                other = words.windows(window, "other")[1].astype(np.uint32)
                text = words.text_of()[at]
                start = at - words.first[text]
                near = np.zeros(len(words.hashes) // length + 2 * len(texts) + 2, bool)
                base = words.first[:-1] // length + 2 * np.arange(len(texts)) + 1
                for t, hits in enumerate(part.column("hits").to_pylist()):
                    b = base[t] + np.frombuffer(unsqueeze(hits), np.uint32).astype(np.int64)
                    b = b[b < base[t] + words.counts[t] // length + 1]
                    near[b] = True
                    near[b - 1] = True
                i = np.flatnonzero(near[base[text] + start // length])
                h, other, text, start = h[i], other[i], text[i], start[i]
                order = np.lexsort((other, h))
                hs, os = h[order], other[order]
                run = np.flatnonzero(np.concatenate([[True], (hs[1:] != hs[:-1]) | (os[1:] != os[:-1])])) if len(h) else order
                least = np.minimum.reduceat(ids[text[order]], run) if len(run) else ids[:0]
                known, before = met.find(hs[run], os[run])
                least = np.where(known, np.minimum(before, least), least)
                met.add(hs[run], os[run], least)
                first = np.empty(len(h), np.int64)
                first[order] = np.repeat(least, np.diff(np.append(run, len(h))))
                own = ids[text] == first
                j = np.flatnonzero(~own)  # decided here
                rows = _deal(ids[text[j]], keys[text[j]], start[j], n_buckets)
                j = np.flatnonzero(own)
                bucket = _bucket(h[j], n_buckets)
                by_bucket = np.argsort(bucket.astype(np.uint32), kind="stable")
                j, bucket = j[by_bucket], bucket[by_bucket]
                for lo, hi in _spans(_edges(bucket), len(j)):
                    k = j[lo:hi]
                    seen = _edges(text[k])
                    docs = text[k][seen]
                    rows.append((int(bucket[lo]), None, len(k), len(docs).to_bytes(4, "little") + squeeze(ids[docs], keys[docs].astype(np.int32), np.diff(np.append(seen, len(k))).astype(np.uint32), start[k].astype(np.uint32)) + h[k].tobytes() + other[k].tobytes()))
                yield _packs(rows)

    return extend


def _repeats(n_buckets: int) -> Callable[[pa.Table], pa.RecordBatch]:
    """Of one bucket: windows that start in a document with a smaller id too."""

    def repeats(tab: pa.Table) -> pa.RecordBatch:
        found, payloads = _read(tab)
        parts = []
        for n, payload in payloads:
            m = int.from_bytes(payload[:4], "little")
            raw = unsqueeze(payload[4 : -12 * n])
            first, second = np.frombuffer(payload[-12 * n : -4 * n], np.uint64), np.frombuffer(payload[-4 * n :], np.uint32)
            size = np.frombuffer(raw[12 * m : 16 * m], np.uint32)
            d, key = np.frombuffer(raw[: 8 * m], np.int64), np.frombuffer(raw[8 * m : 12 * m], np.int32)
            parts.append((first, second, np.repeat(d, size), np.repeat(key, size), np.frombuffer(raw[16 * m :], np.uint32)))
        if parts:
            h, other, d, key, start = map(np.concatenate, zip(*parts, strict=True))
            order = np.lexsort((other, h))
            new = (h[order][1:] != h[order][:-1]) | (other[order][1:] != other[order][:-1])
            run = np.flatnonzero(np.concatenate([[True], new]))
            least = np.repeat(np.minimum.reduceat(d[order], run), np.diff(np.append(run, len(h))))
            j = order[d[order] > least]
            found += _deal(d[j], key[j], start[j], n_buckets)
        return _packs(found)

    return repeats


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), keep_space: bool = False) -> DataFrame:
    """Documents without the words covered by a window of `window` words that also starts
    in a document with a smaller id.

    Returns one row for each input row: doc_id, n_words, n_removed, kept (the words left,
    joined by one space; with keep_space the text with only the removed passages cut out)
    and the columns of carry. Columns not named are ignored, so their names don't matter.
    Null and empty texts have no words; kept is then empty, or with keep_space the text as
    it is. A null id takes part in nothing and keeps its text. Rows of equal id count as one
    document: none removes words from another. An empty table gives an empty result.
    Windows are removed by hashes of 64 and 32 bits with different bases (module words). A very long text
    is held whole by one task, with about 50 bytes for each of its own.
    """
    if window < 2:
        raise ValueError("window must be at least 2 words")
    spark, length = docs.sparkSession, window // 2
    small_batches(spark)
    names = [f"c{i}" for i in range(len(carry))]
    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    n_bytes = text_bytes(chosen)
    n_buckets = tasks_for(spark, n_bytes, BUCKET)
    hits = _gathered(chosen.mapInArrow(lean(_probe(length, n_buckets)), _PACKS), n_buckets, _hits(n_buckets))
    hits = keep(hits.select("doc_id", F.col("places").alias("hits")), "repeat-hits")
    # what is found grows with the documents, so it is never broadcast
    near = squeezed_texts(docs, id_col, text_col).join(hits.hint("merge"), "doc_id")
    n_buckets = tasks_for(spark, n_bytes, 2 * BUCKET)  # of the words near hits only
    packs = near.mapInArrow(lean(_extend(length, window, n_buckets)), _PACKS)
    removed = keep(_gathered(packs, n_buckets, _repeats(n_buckets)).withColumnRenamed("places", "starts"), "repeat-windows")
    drop(hits)
    joined = squeezed_texts(docs, id_col, text_col, carry).toDF("doc_id", "tkey", "z", *names).join(removed.hint("merge"), ["doc_id", "tkey"], "left")
    out = f"doc_id long, n_words long, n_removed long, kept string{''.join(f', {n} {t.simpleString()}' for n, t in zip(names, (docs.schema[c].dataType for c in carry), strict=True))}"
    kept = joined.mapInArrow(lean(_cut(window, names, keep_space)), out)
    return kept.toDF("doc_id", "n_words", "n_removed", "kept", *carry)


def _cut(window: int, names: list[str], keep_space: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in opened(batch):
                words = Words(texts)
                cover = np.zeros(len(words.hashes) + 1, np.int64)
                for t, starts in enumerate(part.column("starts").to_pylist()):
                    if starts is not None:
                        s = words.first[t] + np.frombuffer(unsqueeze(starts), np.uint32).astype(np.int64)
                        np.add.at(cover, s, 1)
                        np.add.at(cover, np.minimum(s + window, words.first[t + 1]), -1)
                gone = np.cumsum(cover)[:-1] > 0
                n_gone = np.concatenate([[0], np.cumsum(gone)])
                n_gone = n_gone[words.first[1:]] - n_gone[words.first[:-1]]
                kept = []
                for t, text in enumerate(texts):
                    lo, hi = words.first[t], words.first[t + 1]
                    if keep_space and not n_gone[t]:
                        kept.append(text)
                    elif keep_space:
                        flip = np.flatnonzero(np.diff(np.concatenate([[False], gone[lo:hi], [False]]).astype(np.int8)))
                        a, b, base, piece = flip[::2] + lo, flip[1::2] + lo, words.at[t], []
                        place = 0
                        for x, y in zip(a, b, strict=True):
                            piece.append(text[place : words.starts[x] - base])
                            place = (words.starts[y] - base) if y < hi else len(text)
                        kept.append(b"".join([*piece, text[place:]]))
                    else:
                        own = text.split()
                        kept.append(b" ".join(own if not n_gone[t] else [w for w, g in zip(own, gone[lo:hi], strict=True) if not g]))
                columns = [part.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *[part.column(n) for n in names]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept", *names])

    return cut


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of its words, of those removed, and a digest of the rest."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS i FROM w WHERE len(words) >= 50
), g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS gram FROM p
), m AS (
  SELECT gram, min(doc_id) AS least FROM g GROUP BY gram HAVING count(DISTINCT doc_id) > 1
), r AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i FROM g JOIN m USING (gram) WHERE g.doc_id > m.least
), q AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(len(q.gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN q.gone IS NULL THEN w.words ELSE list_transform(list_filter(list_zip(w.words, generate_series(1, len(w.words))), lambda x: NOT list_contains(q.gone, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN q USING (doc_id)
"""
