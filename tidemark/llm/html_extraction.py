"""Main text of web pages.

Method: a linear-chain conditional random field over the leaf blocks of a page in document
order. Features are the tags and the class, id and role words of a block's ancestors, and the
shape of its text; two labels, main text or not, with weights for neighbouring labels. It is
trained on labelled pages (labelled_pages) by gradient ascent on the conditional likelihood,
with forward and backward sums, and decoded by Viterbi.

The model is small and of fixed size; pages are decoded where they are read, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table
from .html_blocks import Block, blocks
from .labelled_pages import labelled_pages
from .words import slices
from .workers import lean

PAGES = 700
"""Labelled pages to train on."""
SLICE = 4 << 20


@lru_cache(maxsize=50_000)
def _path_features(path: tuple[str, ...]) -> tuple[str, ...]:
    tags = [p for p in path if p[0] != "."]
    own = tags[-1] if tags else "none"
    inner = [i for i, p in enumerate(path) if p[0] != "."][-2:]
    near = {f"near={p}" for p in path[inner[0] if inner else 0 :]}
    return ("bias", f"own={own}", f"parent={tags[-2] if len(tags) > 1 else 'none'}", *{f"in={p}" for p in path}, *near)


def _shape(b: Block) -> tuple[str, ...]:
    n = len(b.text)
    share = b.linked / n
    return (
        f"words={min(6, (b.text.count(' ') + 1).bit_length())}",
        f"links={0 if share == 0 else 1 if share < 0.4 else 2 if share < 0.9 else 3}",
        f"end={'stop' if b.text[-1] in '.!?,;:' else 'other'}",
        f"stops={min(3, b.text.count('. '))}",
        "mark" if b.text[0] in "©|»«" or "©" in b.text[:40] else "plain",
    )


class Chain:
    """Weights: emit (features x 2), step (2 x 2), start and end (2)."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.emit = np.zeros((len(names), 2))
        self.step, self.edge = np.zeros((2, 2)), np.zeros((2, 2))
        self.path_scores: dict[tuple[str, ...], np.ndarray] = {}

    def features(self, b: Block) -> list[int]:
        return [self.names[f] for f in (*_path_features(b.path), *_shape(b)) if f in self.names]

    def scores(self, page: list[Block]) -> np.ndarray:
        out = np.empty((len(page), 2))
        for i, b in enumerate(page):
            known = self.path_scores.get(b.path)
            if known is None:
                if len(self.path_scores) > 50_000:
                    self.path_scores.clear()
                known = self.path_scores[b.path] = self.emit[[self.names[f] for f in _path_features(b.path) if f in self.names]].sum(0)
            out[i] = known + self.emit[[self.names[f] for f in _shape(b) if f in self.names]].sum(0)
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels of all blocks (Viterbi)."""
        if not page:
            return []
        s = self.scores(page).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        (a0, a1), (z0, z1) = self.edge.tolist()
        v0, v1, back = s[0][0] + a0, s[0][1] + a1, []
        for e0, e1 in s[1:]:
            b0, b1 = v1 + s10 > v0 + s00, v1 + s11 > v0 + s01
            v0, v1 = (v1 + s10 if b0 else v0 + s00) + e0, (v1 + s11 if b1 else v0 + s01) + e1
            back.append((b0, b1))
        y = [int(v1 + z1 > v0 + z0)]
        for b in reversed(back):
            y.append(int(b[y[-1]]))
        return y[::-1]


def train(pages: list[tuple[str, set[str]]], rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> Chain:
    """Adam on the penalised log-likelihood of all pages together."""
    parsed = [p for p in ([(b, int(b.text in main)) for b in blocks(html)] for html, main in pages) if p]
    names: dict[str, int] = {}
    for p in parsed:
        for b, _ in p:
            for f in (*_path_features(b.path), *_shape(b)):
                names.setdefault(f, len(names))
    chain = Chain(names)
    n, t = len(parsed), max(map(len, parsed))
    length = np.array([len(p) for p in parsed])
    y = np.zeros((n, t), np.int64)
    where, which = [], []
    for i, p in enumerate(parsed):
        for j, (b, label) in enumerate(p):
            y[i, j] = label
            f = chain.features(b)
            which += f
            where += [i * t + j] * len(f)
    where, which = np.array(where), np.array(which)
    real = np.arange(t)[None] < length[:, None]
    gold = np.zeros((n, t, 2))
    gold[np.arange(n)[:, None], np.arange(t)[None], y] = 1
    gold *= real[..., None]
    last = length - 1
    pairs = real[:, 1:]
    gold_step = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)])
    gold_edge = np.stack([gold[:, 0].sum(0), gold[np.arange(n), last].sum(0)])
    theta = np.zeros(2 * len(names) + 8)
    m = v = np.zeros_like(theta)
    for k in range(1, rounds + 1):
        emit, step, edge = theta[:-8].reshape(-1, 2), theta[-8:-4].reshape(2, 2), theta[-4:].reshape(2, 2)
        s = np.stack([np.bincount(where, emit[which, c], n * t).reshape(n, t) for c in (0, 1)], axis=2)
        a = np.zeros((n, t, 2))
        a[:, 0] = s[:, 0] + edge[0]
        for j in range(1, t):
            a[:, j] = np.logaddexp.reduce(a[:, j - 1, :, None] + step, axis=1) + s[:, j]
        b = np.zeros((n, t, 2))
        for j in range(t - 1, -1, -1):
            on = np.logaddexp.reduce(step + (s[:, j + 1] + b[:, j + 1])[:, None, :], axis=2) if j + 1 < t else 0
            b[:, j] = np.where((last == j)[:, None], edge[1], on)
        z = np.logaddexp.reduce(a[:, 0] + b[:, 0], axis=1)
        node = np.exp(a + b - z[:, None, None]) * real[..., None]
        both = np.exp(a[:, :-1, :, None] + step + (s[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[..., None, None]
        miss = (gold - node).reshape(-1, 2)
        g = np.concatenate([
            np.stack([np.bincount(which, miss[where, c], len(names)) for c in (0, 1)], axis=1).ravel(),
            (gold_step - both.sum((0, 1))).ravel(),
            (gold_edge - np.stack([node[:, 0].sum(0), node[np.arange(n), last].sum(0)])).ravel(),
        ]) / n - decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    chain.emit, chain.step, chain.edge = theta[:-8].reshape(-1, 2), theta[-8:-4].reshape(2, 2), theta[-4:].reshape(2, 2)
    return chain


@lru_cache(maxsize=1)
def trained() -> Chain:
    return train(labelled_pages(PAGES))


def main_text(page: str, chain: Chain) -> str:
    own = blocks(page)
    return "\n".join(b.text for b, label in zip(own, chain.decode(own), strict=True) if label)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    Null and empty html, and pages without main text, give an empty text. Null ids and urls are
    passed on; repeated rows are extracted each; other columns are ignored. A very long page is held
    whole by its task, with its blocks; results go out SLICE bytes of pages at a time.
    """
    small_batches(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(trained())
    chosen = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pages_ in slices(batches, "html", SLICE):
            texts = [main_text(h.decode(), model.value) if h else "" for h in pages_]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return chosen.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
