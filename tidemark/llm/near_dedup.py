"""Near duplicates by word shingles.

Method: one-permutation hashing. One hash of each shingle gives both its bin and its
value, an empty bin takes the value of another by optimal densification, and bands of
bins are bucket keys. Inside a bucket only a star is compared: every member with a hub.
So a large group costs about one comparison a member. Documents of buckets that then still
reach into several components get an exact way: buckets by their rarest shingles (prefix
filter), again compared by stars, with further hubs (those with most links first, eight times as
many each round) until the rest of a bucket lies in one component or is used up. Pairs left
out share a component already, so no link between components is lost.

Documents with equal shingle sets are one node from the start. Each comparison is
confirmed on the full sets, recomputed from the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, drop, keep, keep_counted, meet, small_batches, table
from .components import components
from .packed import opened, squeezed_texts, unsqueeze
from .words import Words, mix, slices
from .workers import lean

_TRIES = 1024


def shingle_sets(texts: list[bytes], size: int, lower: bool) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles of size words; a shorter text is one shingle."""
    words = Words(texts, lower)
    at, h = words.windows(size)
    cut = np.searchsorted(at, words.first)
    out = []
    for t, n in enumerate(words.counts):
        out.append(np.unique(h[cut[t] : cut[t + 1]]) if n >= size else np.array([words.sequence_hash(t)] if n else [], np.uint64))
    return out


class OnePermutation:
    """Signatures of bands * rows bins and the keys of their bands."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        i = np.arange(self.bins * _TRIES, dtype=np.uint64).reshape(self.bins, _TRIES)
        self.donor = ((mix(i + np.uint64(0x5BD1E995)) >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        self.weight = mix(np.arange(self.bins, dtype=np.uint64) + np.uint64(17)).reshape(bands, rows) | np.uint64(1)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """hashes: sorted, distinct, at least one. Sorted hashes have sorted bins, so a bin's first is its least."""
        bins = ((hashes >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        full, first = np.unique(bins, return_index=True)
        out = np.zeros(self.bins, np.uint64)
        out[full] = hashes[first]
        if len(full) < self.bins:
            filled = np.zeros(self.bins, bool)
            filled[full] = True
            empty = np.flatnonzero(~filled)
            donor = np.full(len(empty), full[0])
            open_ = np.arange(len(empty))
            for lo, hi in ((0, 8), (8, 64), (64, _TRIES)):
                if not len(open_):
                    break
                tried = self.donor[empty[open_], lo:hi]
                good = filled[tried]
                some = good.any(axis=1)
                donor[open_[some]] = tried[some, good[some].argmax(axis=1)]
                open_ = open_[~some]
            out[empty] = out[donor]
        return out

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        x = mix(signatures.reshape(-1, self.bands, self.rows)) * self.weight
        return mix(x.sum(axis=2, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


def _signed(size: int, lower: bool, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = OnePermutation(bands, rows)
        for part, texts in slices(batches):
            sets = shingle_sets(texts, size, lower)
            some = [i for i, s in enumerate(sets) if len(s)]
            keys = one.keys(np.array([one.signature(sets[i]) for i in some], np.uint64)) if some else np.zeros((0, bands), np.int64)
            lists: list[np.ndarray | None] = [None] * len(sets)
            for i, k in zip(some, keys, strict=True):
                lists[i] = k
            same = [[int(x.astype(np.uint64).sum(dtype=np.uint64).view(np.int64)) for x in (mix(s), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))] for s in sets]
            columns = [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in same], pa.int64()), pa.array([x[1] for x in same], pa.int64()), pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "s1", "s2", "bands"])

    return signed


def _confirm(size: int, lower: bool, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(n).to_pylist() for n in ("a", "b"))
            za, zb = (batch.column(n).to_pylist() for n in ("za", "zb"))
            lo = 0
            while lo < len(a):
                texts: dict[tuple[int, bytes], int] = {}
                raw: list[bytes] = []
                hi = lo
                total = 0
                while hi < len(a) and (total < 2 << 20 or hi == lo):
                    for i, z in ((a[hi], za[hi]), (b[hi], zb[hi])):
                        if (i, z) not in texts:
                            texts[i, z] = len(raw)
                            raw.append(bytes(unsqueeze(z)))
                            total += len(raw[-1])
                    hi += 1
                sets = shingle_sets(raw, size, lower)
                linked = []
                for k in range(lo, hi):
                    x, y = sets[texts[a[k], za[k]]], sets[texts[b[k], zb[k]]]
                    if len(x) and len(y) and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if 100 * both >= percent * (len(x) + len(y) - both):
                            linked.append(k)
                yield batch.select(["a", "b"]).take(pa.array(linked, pa.int64()))
                lo = hi

    return confirm


def _confirmed(pairs: DataFrame, zs: DataFrame, size: int, lower: bool, percent: int) -> DataFrame:
    """The pairs (a, b, hub: one of both) that are linked.

    A pair takes its member's text first and its hub's last: a hub's text is never shuffled once for each
    member, and AQE splits the members of a crowded hub, as nothing after that join asks for its partitions.
    """
    member = F.when(F.col("a") == F.col("hub"), F.col("b")).otherwise(F.col("a"))
    with_member = pairs.select("hub", member.alias("member")).join(zs.toDF("member", "zb"), "member")
    sides = with_member.join(zs.toDF("hub", "za"), "hub").select(F.col("hub").alias("a"), F.col("member").alias("b"), "za", "zb")
    found = sides.mapInArrow(lean(_confirm(size, lower, percent)), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _unsettled(members: DataFrame, stars: DataFrame, links: DataFrame, percent: int) -> tuple[DataFrame | None, int]:
    """Members that may have a partner, in the buckets that reach into more than one component, with the component
    and the number of links that each has so far; and how many they are.

    A member has no partner if what it shares from its place on is too little for the smallest set there.
    """
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    ranked = members.select("bucket", "id", "n", "place").join(stars, "id", "left").join(degree, "id", "left")
    ranked = ranked.select("bucket", "id", "n", "place", F.coalesce("component", "id").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    ranked, total = keep_counted(ranked, "ranked")
    least = ranked.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least")).filter("lo <> hi").select("bucket", "n", "least")
    least, mixed = keep_counted(least, "mixed")
    if not mixed:
        drop(ranked, least)
        return None, 0
    rest = meet(ranked, least, mixed, "bucket", total).filter((1 + F.col("n") - F.col("place")) * (100 + percent) >= (F.col("n") + F.greatest("least", F.col("n") * percent / 100)) * percent)
    out, n = keep_counted(rest.drop("least"), "members")
    drop(ranked, least)
    return out, n


def _rare_buckets(texts: DataFrame, members: DataFrame, size: int, lower: bool, percent: int) -> DataFrame:
    """Buckets by rare shingles for documents that a star left unsettled.

    Two sets of the asked similarity share one of the n - ceil(n * percent / 100) + 1 shingles of
    either that come first in any common order. The order is by how many of these documents have a
    shingle, so a passage that many share makes no bucket unless a document has little else.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in opened(batch):
                sets = shingle_sets(raw, size, lower)
                n = np.array([len(x) for x in sets])
                rows = pa.array(np.repeat(np.arange(len(sets)), n))
                h = np.concatenate(sets).view(np.int64) if len(sets) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(rows), part.column("tkey").take(rows), pa.array(np.repeat(n, n)), pa.array(h)], names=["id", "tkey", "n", "bucket"])

    ids = members.select(F.col("id").alias("doc_id")).distinct()
    rows = keep(texts.join(ids, "doc_id", "left_semi").mapInArrow(lean(explode), "id long, tkey int, n long, bucket long"), "shingles")
    often = rows.groupBy("bucket").agg(F.count("*").alias("often")).filter("often > 1")
    place = F.row_number().over(Window.partitionBy("id", "tkey").orderBy(F.coalesce("often", F.lit(1)), "bucket"))
    ranked = rows.join(often, "bucket", "left").withColumn("place", place)
    first = F.col("n") - F.ceil(F.col("n") * percent / 100 - F.lit(1e-9)) + 1
    return ranked.filter((F.col("place") <= first) & F.col("often").isNotNull()).select("bucket", "id", "n", "place").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, lower: bool = True, bands: int = 40, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_shingles (size of its set of distinct shingles),
    component_id (smallest id that links reach) and kept (doc_id = component_id).

    Two documents are linked if 100 * intersection >= percent * union of their sets. A text of
    fewer than size words is one shingle, its whole sequence; an empty or null text has an empty
    set and no link. A row with a null id takes no part: its component_id is null and kept true.
    Rows of one id are one node, so all of them get the same component. Extra columns are ignored.
    A pair of exactly the threshold is missed with a chance of (1 - (percent/100)^rows)^bands.
    """
    small_batches(docs.sparkSession)
    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    signed = keep(chosen.mapInArrow(lean(_signed(size, lower, bands, rows)), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"), "signatures")
    sets = signed.filter("n_shingles > 0 and doc_id is not null")
    first = sets.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last"), F.min_by("bands", "doc_id").alias("bands"))
    nodes = keep(first, "nodes")
    # copies: only sets that more than one id has need a link
    copies = sets.select("doc_id", "s1", "s2", "n_shingles").join(nodes.filter("node <> last").select("s1", "s2", "n_shingles", "node"), ["s1", "s2", "n_shingles"]).filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    copies = keep(copies, "copies")

    members = nodes.select(F.col("node").alias("id"), F.col("n_shingles").alias("n"), F.lit(1).alias("place"), F.explode("bands").alias("bucket")).distinct()
    shared = members.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi")
    members, n_members = keep_counted(members.join(shared.select("bucket"), "bucket"), "members")
    texts = squeezed_texts(docs, id_col, text_col)
    texts = keep(texts.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), "member-texts")
    zs = texts.select("doc_id", "z")

    links: DataFrame | None = None
    stars: DataFrame | None = None
    tried: DataFrame | None = None
    hubs_a_bucket, used = 1, []
    used.append(members)
    members = members.withColumn("label", F.col("id")).withColumn("links", F.lit(0).cast("long"))
    while n_members:
        part = F.pmod(F.xxhash64("id"), F.lit(hubs_a_bucket))
        # a minimum for each bucket, so no bucket is gathered
        hubs = members.groupBy("bucket", part.alias("part")).agg(F.min(F.struct((-F.col("links")).alias("rank"), "id", "label", "n", "place")).alias("hub")).select("bucket", F.col("hub.id").alias("hub"), F.col("hub.label").alias("hub_label"), F.col("hub.n").alias("hub_n"), F.col("hub.place").alias("hub_place"))
        hubs, n_hubs = keep_counted(hubs, "hubs")
        small = F.broadcast(hubs) if n_hubs <= BROADCAST_ROWS else hubs
        # what two sets can share from this bucket's shingle on must be enough
        enough = (1 + F.least(F.col("n") - F.col("place"), F.col("hub_n") - F.col("hub_place"))) * (100 + percent) >= (F.col("n") + F.col("hub_n")) * percent
        like = (F.col("id") != F.col("hub")) & (F.col("label") != F.col("hub_label")) & enough
        pairs = members.join(small, "bucket").filter(like).groupBy(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).agg(F.min("hub").alias("hub"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs, n_pairs = keep_counted(pairs, "pairs")
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        first_round, old = links is None, None
        if n_pairs or first_round:
            new, n_new = keep_counted(_confirmed(pairs, zs, size, lower, percent), "links")
            links = new if first_round else links.unionByName(new)
            used.append(new)
            if n_new or first_round:
                old, stars = stars, components(new if stars is None else new.unionByName(stars.select(F.col("id").alias("a"), F.col("component").alias("b"))))
        used.append(pairs)
        rest = members.join(small.select("bucket", F.col("hub").alias("id")), ["bucket", "id"], "left_anti")
        before = members
        members, n_members = _unsettled(rest, stars, links, percent)
        drop(before, hubs, old)
        if first_round and n_members:
            before, rare = members, keep(_rare_buckets(texts, members, size, lower, percent), "rare-buckets")
            members, n_members = _unsettled(rare, stars, links, percent)
            drop(before, rare)
        hubs_a_bucket *= 8

    graph = copies if stars is None else copies.unionByName(stars.select(F.col("id").alias("a"), F.col("component").alias("b")))
    found = components(graph).withColumnRenamed("id", "doc_id")
    drop(nodes, copies, texts, stars, *used)
    return signed.select("doc_id", "n_shingles").join(found, "doc_id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), (F.col("doc_id").isNull() | (F.coalesce("component", "doc_id") == F.col("doc_id"))).alias("kept"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with at least 85 % of their 3-word shingles in common."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85, rows=8)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 2, 1))) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), e AS (
  SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u
), m AS (
  SELECT u, min(v) AS least FROM r GROUP BY u
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.least AS component_id, m.least = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.u = d.doc_id
"""
