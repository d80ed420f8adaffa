"""Quality classifier on document statistics.

Method: random Fourier features approximate a Gaussian kernel over standardised statistics
of the whole text; normal equations, summed by partition, give ridge scores for the labels;
isotonic regression on binned scores turns them into probabilities.

Statistics are taken once for every document and written; fitting reads those of labelled
documents, scoring those of all. What meets on the driver is a few matrices of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, keep, small_batches, table
from .words import Words, slices
from .workers import lean

FEATURES = 384
RIDGE = 1e-3
MAX_LABELLED = 400_000
"""Labelled rows that are fitted on, about; of more, a share chosen by a hash of the id."""
PARTS = 12
_BINS = 4000
_MARKS = b"|!#*$%&.,"


def _per(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs values[first[i]:first[i + 1]]."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of finite numbers for each text; an empty one has zeros."""
    w = Words(texts)
    buf, at, n = w.buf, w.at, w.counts
    n_bytes = np.diff(at) - 1
    ends = np.append(at[:-1], at[-1])

    def share(mask: np.ndarray) -> np.ndarray:
        return _per(mask, ends) / np.maximum(n_bytes, 1)

    upper = (buf >= 65) & (buf <= 90)
    lower = (buf >= 97) & (buf <= 122)
    digit = (buf >= 48) & (buf <= 57)
    high = buf >= 128
    space = (buf == 32) | (buf == 10)
    other = ~(upper | lower | digit | high | space)
    size = (w.ends - w.starts).astype(np.float64)
    words = np.maximum(n, 1)
    mean = _per(size, w.first) / words
    spread = np.sqrt(np.maximum(_per(size**2, w.first) / words - mean**2, 0))
    text = w.text_of()
    order = np.lexsort((w.hashes, text))
    h, t = w.hashes[order], text[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])]) if len(h) else np.zeros(0, bool)
    run = np.flatnonzero(new)
    often = np.diff(np.append(run, len(h)))
    kinds = np.bincount(t[run], minlength=len(texts)) if len(run) else np.zeros(len(texts))
    most = np.zeros(len(texts))
    np.maximum.at(most, t[run], often)
    p = often / words[t[run]] if len(run) else often
    entropy = -np.bincount(t[run], weights=p * np.log(p), minlength=len(texts)) if len(run) else np.zeros(len(texts))
    same = np.concatenate([[False], (w.hashes[1:] == w.hashes[:-1]) & (text[1:] == text[:-1])]) if len(h) else np.zeros(0, bool)
    last, head = (buf[w.ends - 1], buf[w.starts]) if len(h) else (np.zeros(0, np.uint8),) * 2
    plain = ((last >= 97) & (last <= 122)) | (last >= 128)
    columns = [
        np.log1p(n), np.log1p(n_bytes), mean, spread, kinds / words, most / words, entropy / np.log(np.maximum(n, 2)), _per(same, w.first) / words,
        share(upper), share(lower), share(digit), share(high), share(other), share(buf == 10) * 100,
        _per(plain, w.first) / words, _per((head >= 65) & (head <= 90), w.first) / words, _per(size == 1, w.first) / words, _per(size > 15, w.first) / words,
        *[_per(last == m, w.first) / words for m in _MARKS],
    ]
    return np.where(n[:, None] > 0, np.stack(columns, axis=1), 0.0)


class Model:
    """Scores rows of statistics. Without labelled rows every score is 0.5."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 5):
        d = len(mean)
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.turn = rng.normal(size=(d, FEATURES)) / np.sqrt(d)
        self.shift = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.full(1, 0.5))

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.turn + self.shift), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; returns the mean place and value of each pool, for interpolation."""
    pools: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], top, strict=True)]
    m = np.array(pools)
    return m[:, 0] / m[:, 2], m[:, 1] / m[:, 2]


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _summed(df: DataFrame, parts) -> list[np.ndarray]:
    """Sums over all rows of the arrays that parts(batch) gives; one row comes from each of few partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] | None = None
        for batch in batches:
            if batch.num_rows:
                own = parts(batch)
                total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(total)), pa.int32()), "v": pa.array([np.asarray(t, np.float64).tobytes() for t in total], pa.binary())})

    out: dict[int, np.ndarray] = {}
    for k, v in df.mapInArrow(run, "k int, v binary").toLocalIterator():
        out[k] = out.get(k, 0) + np.frombuffer(v)
    return [out[k] for k in sorted(out)]


def fit(labelled: DataFrame) -> Model:
    """labelled: a written table with columns x (statistics) and y (0 or 1), in at most PARTS partitions."""
    width = len(statistics([b""])[0])
    sums = _summed(labelled, lambda b: [np.array([b.num_rows]), _rows(b).sum(0), (_rows(b) ** 2).sum(0)])
    if not sums:
        return Model(np.zeros(width), np.ones(width))
    n = sums[0][0]
    mean = sums[1] / n
    spread = np.sqrt(np.maximum(sums[2] / n - mean**2, 0))
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0))

    def normal(batch: pa.RecordBatch) -> list[np.ndarray]:
        z, y = model.lift(_rows(batch)), batch.column("y").to_numpy(zero_copy_only=False)
        return [(z.T @ z).ravel(), z.T @ y]

    zz, zy = _summed(labelled, normal)
    m = FEATURES + 1
    model.weights = np.linalg.solve(zz.reshape(m, m) + RIDGE * n / FEATURES * np.eye(m), zy)

    def binned(batch: pa.RecordBatch) -> list[np.ndarray]:
        b = np.clip(((model.raw(_rows(batch)) + 1) / 3 * _BINS).astype(np.int64), 0, _BINS - 1)
        y = batch.column("y").to_numpy(zero_copy_only=False)
        return [np.bincount(b, minlength=_BINS), np.bincount(b, weights=y, minlength=_BINS)]

    count, ones = _summed(labelled, binned)
    some = count > 0
    model.knots = isotonic((np.arange(_BINS)[some] + 0.5) * 3 / _BINS - 1, ones[some] / count[some], count[some])
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each input row: doc_id, held_out, score, predicted and the columns of carry.

    Learns labels.quality from labelled rows that aren't held out; null labels and ids are not
    learned from. Only the text is an input of a score: null and empty texts have the statistics
    of no words. A document with several labels is learned from once for each. Rows with a null id
    are scored too. An empty table gives no rows. Extra columns of either table are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = [f"c{i}" for i in range(len(carry))]
    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            x = statistics(texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())), *part.columns[2:]], names=["doc_id", "x", *names])

    carried = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, carry, strict=True))
    if carry:
        chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *[docs[c].alias(n) for n, c in zip(names, carry, strict=True)])
    measured = chosen.mapInArrow(lean(measure), f"doc_id long, x array<double>{carried}")
    measured = keep(measured, "statistics")
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("double").alias("y")).filter("doc_id is not null and y is not null")
    known = known.filter(~held_out(F.col("doc_id")))
    share = min(1.0, MAX_LABELLED / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    labelled = keep(measured.select("doc_id", "x").join(known, "doc_id").select("x", "y").repartition(PARTS), "labelled")
    model = spark.sparkContext.broadcast(fit(labelled.coalesce(PARTS)))
    drop(labelled)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.value.score(_rows(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), *batch.columns[2:]], names=["doc_id", "score", "predicted", *names])

    out = measured.mapInArrow(score, f"doc_id long, score double, predicted int{carried}")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", *[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
