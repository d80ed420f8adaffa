"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are dealt to cells around centroids. In a cell a vector's direction from the centroid
is rotated at random and kept as one bit a dimension, with two correction scalars: its length
and the inner product of the direction with its code. The inner product of a query with the
direction is estimated from the code, with an error of at most EPSILON standard deviations of
the estimator; candidates whose lower bound is below the upper bound of the k-th best are
reranked by exact distance on the original vectors.

Centroids are fitted on a bounded sample; every vector is indexed. A cell is cut into blocks
of vectors and slots of queries, both of bounded size, so a crowded cell is many tasks, and a
block hands on its k best for each query before they meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, keep, keep_counted, small_batches, table
from .workers import lean

EPSILON = 3.0
SAMPLE = 40_000
"""Vectors that centroids are fitted on, at most."""
DISTANCES = 4_000_000
"""Distances between vectors and centroids that a task holds at once."""


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's iterations from a random start; an empty cell takes a random vector."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    centers = distinct[rng.choice(len(distinct), min(cells, len(distinct)), replace=False)]
    for _ in range(rounds):
        own = _order(sample, centers, 1)[:, 0]
        total = np.zeros_like(centers)
        np.add.at(total, own, sample)
        n = np.bincount(own, minlength=len(centers))
        centers = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], sample[rng.choice(len(sample), len(centers))])
    return centers


def _order(x: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centers of each row, nearest first."""
    d = (centers**2).sum(1)[None] - 2 * x @ centers.T
    if n == 1:
        return d.argmin(axis=1)[:, None]
    if n >= len(centers):
        return np.argsort(d, axis=1, kind="stable")
    some = np.sort(np.argpartition(d, n - 1, axis=1)[:, :n], axis=1)
    return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, axis=1), axis=1, kind="stable"), axis=1)


def calibrate(sample: np.ndarray, centers: np.ndarray, k: int, recall: float, asked: int = 200, seed: int = 13) -> int:
    """Cells to search so that, within the sample, they hold that share of true neighbours.

    Among all vectors the neighbours are nearer, so that the share there is rather higher.
    """
    rng = np.random.default_rng(seed)
    q = rng.choice(len(sample), min(asked, len(sample)), replace=False)
    own = _order(sample, centers, 1)[:, 0]
    rank_of = np.argsort(_order(sample[q], centers, len(centers)), axis=1)
    apart = (sample**2).sum(1)[None] - 2 * sample[q] @ sample.T
    apart[np.arange(len(q)), q] = np.inf
    near = np.argsort(apart, axis=1)[:, : min(k, len(sample) - 1)]
    ranks = np.sort(np.take_along_axis(rank_of, own[near], axis=1), axis=None)
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else 1


@lru_cache(maxsize=4)
def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, center: np.ndarray, rotate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, length from the center, and inner product of direction and code."""
    away = (x - center) @ rotate
    length = np.linalg.norm(away, axis=1)
    bits = away > 0
    inner = np.abs(away).sum(1) / np.sqrt(x.shape[1]) / np.where(length > 0, length, 1)
    return np.packbits(bits, axis=1), length, np.where(length > 0, inner, 1)


def bounds(codes: np.ndarray, length: np.ndarray, inner: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances of rotated, centred queries (rows of q) to coded vectors."""
    d = q.shape[1]
    size = np.linalg.norm(q, axis=1)[:, None]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    guess = (q / np.maximum(size, 1e-300)).astype(np.float32) @ signs.T / np.sqrt(d).astype(np.float32) / inner.astype(np.float32)
    error = (EPSILON * np.sqrt(np.maximum(1 - inner**2, 0) / max(d - 1, 1)) / inner + 1e-5).astype(np.float32)
    base, scale = length**2 + size**2, 2 * length * size
    return base - scale * (guess + error), base - scale * (guess - error)


def search(index: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.98, cells: int | None = None, block: int = 20_000, slot: int = 2_000) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest vectors of index found, by Euclidean
    distance in double precision, ties to the smaller vec_id; a query's own vec_id is no candidate.

    index and queries have columns vec_id and embedding. Vectors that are null, zero or hold null or
    non-finite components, and null ids, take no part. Vectors of different lengths have no distance: each
    length is a search for itself, and all lengths are searched in the same jobs. With fewer than k
    candidates all are returned. Rows of one id are candidates each. Searches as many of the cells as held
    the share `recall` of true neighbours in the sample, at every size, and more until they hold k
    candidates. A task holds the centroids: at most SAMPLE / 20, and one for each length. Other columns are
    ignored. An empty table gives no rows.
    """
    spark = index.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.col("embedding")
        fine = "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)"
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).filter(fine)

    small_batches(spark)
    index, queries = clean(index), clean(queries)
    lengths = keep(index.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")), "lengths")
    totals = dict(lengths.orderBy("d").toPandas().itertuples(index=False, name=None))  # a row for each length
    if not totals:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    part = SAMPLE / len(totals)
    drawn = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < F.floor(F.least(F.lit(1.0), part / F.col("n")) * (1 << 20)) + 1
    sample = index.withColumn("d", F.size("embedding")).join(lengths, "d").filter(drawn).limit(2 * SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    widths = sample.value_lengths().to_numpy() if len(sample) else np.zeros(0, int)
    fitted: dict[int, tuple[int, np.ndarray, int]] = {}  # by length: the first cell's number, centers, cells to search
    centers: list[np.ndarray] = []
    for d, n in totals.items():
        own = _matrix(sample.filter(pa.array(widths == d)), d) if (widths == d).any() else np.zeros((1, d))
        found = fit_centroids(own, cells or int(max(1, min(part / 20, n**0.5 / 4))))
        fitted[d] = len(centers), found, calibrate(own, found, k, recall)
        centers.extend(found)
    place = F.pmod(F.xxhash64("vec_id", F.col("embedding")), F.lit(1 << 20))

    def cells_of(x: np.ndarray, middles: np.ndarray, n: int, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs of arrays (row of x, number of a cell): the n nearest cells, and more until these hold over k vectors."""
        near = _order(x, middles, n)
        lacking = counts[near].sum(axis=1) <= k
        rows = np.flatnonzero(~lacking)
        out = [(np.repeat(rows, near.shape[1]), near[rows].ravel())]
        if lacking.any():
            rows = np.flatnonzero(lacking)
            near = _order(x[rows], middles, len(middles))
            most = np.clip((np.cumsum(counts[near], axis=1) <= k).sum(axis=1) + 1, min(n, len(middles)), len(middles))
            out.append((np.repeat(rows, most), near[np.arange(len(middles))[None] < most[:, None]]))
        return out

    def assign(counts: np.ndarray | None = None):
        """Each vector with its nearest cell; with counts, with the cells that are searched for it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                widths = batch.column("embedding").value_lengths().to_numpy()
                for d in np.unique(widths).tolist():
                    if d not in fitted:  # queries of a length that no vector has
                        continue
                    first, middles, probes = fitted[d]
                    same = batch.filter(pa.array(widths == d))
                    step = max(1, DISTANCES // len(middles))
                    for lo in range(0, same.num_rows, step):
                        some = same.slice(lo, step)
                        x = _matrix(some.column("embedding"), d)
                        if counts is None:
                            dealt = [(np.arange(len(x)), _order(x, middles, 1)[:, 0])]
                        else:
                            dealt = cells_of(x, middles, probes, counts[first : first + len(middles)])
                        for rows, cell in dealt:
                            yield pa.RecordBatch.from_arrays([pa.array((first + cell).astype(np.int32)), *[c.take(pa.array(rows)) for c in some.columns]], names=["cell", *batch.schema.names])

        return lean(run)

    indexed = index.withColumn("place", place.cast("int")).mapInArrow(assign(), "cell int, vec_id long, embedding array<double>, place int")
    indexed = keep(indexed, "cells")
    sizes = indexed.groupBy("cell").count().collect()  # a row for each cell
    counts = np.zeros(len(centers), np.int64)
    counts[[r[0] for r in sizes]] = [r[1] for r in sizes]
    asked = keep(queries.mapInArrow(assign(counts), "cell int, vec_id long, embedding array<double>"), "asked")
    blocks = indexed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    slots = asked.groupBy("cell").agg(F.ceil(F.count("*") / slot).cast("int").alias("slots"))
    sizes, n_sizes = keep_counted(blocks.join(slots, "cell"), "cell-sizes")
    sizes = F.broadcast(sizes) if n_sizes <= BROADCAST_ROWS else sizes
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    coded = indexed.join(sizes, "cell").withColumn("block", F.pmod(F.col("place"), "blocks")).select("cell", "block", each("slots").alias("slot"), "vec_id", "embedding")
    asked = asked.join(sizes, "cell").select("cell", each("blocks").alias("block"), F.pmod(F.xxhash64("vec_id"), "slots").cast("int").alias("slot"), "vec_id", "embedding")

    def best(key, vectors: pa.Table, wanted: pa.Table) -> pa.Table:
        rows: tuple[list, ...] = ([], [], [])
        if vectors.num_rows and wanted.num_rows:
            center = centers[key[0].as_py()]
            d, rotate = len(center), rotation(len(center))
            x, ids = _matrix(vectors["embedding"].combine_chunks(), d), vectors["vec_id"].to_numpy()
            codes, length, inner = encode(x, center, rotate)
            all_q, all_ids = _matrix(wanted["embedding"].combine_chunks(), d), wanted["vec_id"].to_numpy()
            for lo in range(0, len(all_q), 32):
                some = all_q[lo : lo + 32]
                lows, highs = bounds(codes, length, inner, (some - center) @ rotate)
                for q_id, q, low, high in zip(all_ids[lo : lo + 32], some, lows, highs, strict=True):
                    other = ids != q_id
                    high[~other] = np.inf
                    limit = np.partition(high, k - 1)[k - 1] if len(ids) > k else np.inf
                    i = np.flatnonzero(other & (low <= limit))
                    exact = np.sqrt(((x[i] - q) ** 2).sum(1))
                    first = np.lexsort((ids[i], exact))[:k]
                    rows[0].append(np.full(len(first), q_id))
                    rows[1].append(ids[i][first])
                    rows[2].append(exact[first])
        joined = [np.concatenate(r) if r else np.zeros(0) for r in rows]
        return pa.table({"query_id": pa.array(joined[0].astype(np.int64)), "vec_id": pa.array(joined[1].astype(np.int64)), "score": pa.array(joined[2].astype(np.float64))})

    found = coded.groupBy("cell", "block", "slot").cogroup(asked.groupBy("cell", "block", "slot")).applyInArrow(best, "query_id long, vec_id long, score double")
    # at most k rows come from each of a query's blocks
    top = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("rank", "hit")).select("query_id", (F.col("rank") + 1).alias("rank"), "hit.vec_id", "hit.score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every hundredth vector among all."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 100 = 0"))
