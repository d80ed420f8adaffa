"""The registered queries on the whole smallest tables, against brute force, and odd inputs of pipeline stages."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.fixtures import odd_documents
from tests.llm.test_text_operators import brute_components
from tests.oracle import connect, oracle_rows, rows_of
from tidemark.llm import html_extraction, quality
from tidemark.llm.common import table
from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == oracle_rows(connect(SF), ORACLE_SQL[name])


def test_nearest_of_every_hundredth(spark):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table(spark, SF, "embeddings").collect()]
    rows = [(i, v) for i, v in rows if i is not None and v.size and np.isfinite(v).all() and v.any()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got: dict[int, list] = {}
    for r in QUERIES["op9_nearest"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    hit = 0
    for q, own in got.items():
        apart = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        exact = dict(zip(ids.tolist(), apart.tolist(), strict=True))
        own.sort()
        assert [k for k, _, _ in own] == list(range(1, 11)) and q not in {i for _, _, i in own}
        assert [s for _, s, _ in own] == pytest.approx([exact[i] for _, _, i in own], rel=1e-12)
        assert [(s, i) for _, s, i in own] == sorted((s, i) for _, s, i in own)
        best = sorted((a, i) for i, a in exact.items() if i != q)[:10]
        hit += len({i for _, i in best} & {i for _, _, i in own})
    assert hit >= 0.9 * 10 * len(got)


def test_records_of_all_documents(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: tuple(r) for r in QUERIES["op8_binary_records"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    docs, start = sorted((r.doc_id, r.text or "") for r in table(spark, SF, "documents").collect()), 0
    assert len(got) == len(docs)
    for i, text in docs:
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_packing_of_all_documents(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for r in table(spark, SF, "documents").collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, lo in enumerate(range(0, len(ids), 2048)):
            own = ids[lo : lo + 2048]
            want[r.doc_id, k] = (lo, len(own), zlib.crc32(own.tobytes()))
    rows = QUERIES["op5_best_fit_packing"](spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) <= 2048
    assert len(bins) <= 1.02 * sum(n for _, n, _ in want.values()) / 2048 + 1


def test_main_text_of_all_pages(spark):
    chain = html_extraction.trained()
    want = {r.page_id: (r.url, html_extraction.main_text(r.html or "", chain)) for r in table(spark, SF, "pages").collect()}
    got = QUERIES["op4_html_extraction"](spark, SF).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and all(r.n_chars == len(r.text) for r in got) and len(got) == len(want)


def test_quality_of_all_documents(spark):
    rows = QUERIES["op3_quality"](spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    own = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert len(own) >= 10 and np.mean(own) >= 0.9


def brute_isotonic(y, weight):
    """Of each place, the largest over starts of the least over ends of the mean between them."""
    y, w = np.array(y, float), np.array(weight, float)
    mean = lambda i, j: (y[i : j + 1] * w[i : j + 1]).sum() / w[i : j + 1].sum()
    return [max(min(mean(i, j) for j in range(k, len(y))) for i in range(k + 1)) for k in range(len(y))]


@pytest.mark.parametrize("seed", range(5))
def test_isotonic_is_the_minimax_mean(seed):
    rng = np.random.default_rng(seed)
    x, y, w = np.sort(rng.normal(size=25)), rng.integers(0, 4, 25) / 3, rng.integers(1, 6, 25)
    place, value = quality.isotonic(x, y, w)
    assert (np.diff(value) > 0).all() and (np.diff(place) > 0).all()
    want = brute_isotonic(y, w)
    level, at = sorted(set(np.round(want, 12))), np.round(want, 12)
    assert value == pytest.approx(level)
    assert place == pytest.approx([np.average(x[at == v], weights=w[at == v]) for v in level])


def test_fit_is_the_direct_solution(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 28))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(float)
    rows = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y, strict=True)], "x array<double>, y double").repartition(3)
    model = quality.fit(rows)
    assert model.mean == pytest.approx(x.mean(0)) and model.spread == pytest.approx(x.std(0))
    z = model.lift(x)
    # the penalised least squares as one stacked system
    penalty = np.sqrt(quality.RIDGE * len(x) / quality.FEATURES) * np.eye(z.shape[1])
    direct = np.linalg.lstsq(np.vstack([z, penalty]), np.concatenate([y, np.zeros(len(penalty))]), rcond=None)[0]
    assert z @ model.weights == pytest.approx(z @ direct, abs=1e-6)
    score = model.score(x)
    assert ((score >= 0.5) == y).mean() > 0.9 and (np.diff(score[np.argsort(model.raw(x))]) >= -1e-12).all()


def test_a_very_long_text_has_a_score(spark):
    docs = spark.createDataFrame([(1, "one word and another. " * 60_000), (2, None), (3, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id bigint, quality int")
    assert {r.doc_id: 0 <= r.score <= 1 for r in quality.score_documents(docs, labels).collect()} == {1: True, 2: True, 3: True}


STAGES = ["quality classifier", "near dedup", "substring dedup", "decontamination", "packing"]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_corpus(spark):
    """Documents with null columns, repeated rows, and columns whose names operators use themselves."""
    rows = [(i, t, "en" if t else None, None if t is None else "web", len(t or ""), 1, "k", "z") for i, t in odd_documents()]
    rows += [(None, "null id", None, None, None, 1, "k", "z")] * 2 + [(131, dict(odd_documents())[131], "en", "web", 1, 1, "k", "z")] * 2
    return spark.createDataFrame(rows, COLUMNS + ", bucket int, kept string, z string")


@pytest.mark.parametrize("name", STAGES)
def test_stage_of_odd_documents(spark, name):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stage, docs = dict(corpus_pipeline.STAGES)[name], odd_corpus(spark)
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name == "packing":
        assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
        assert sum(r.start == 0 for r in rows) == docs.count()
        return
    assert out.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    nulls = sum(r.doc_id is None for r in rows)
    if name == "near dedup":
        kept = {i for i, _, _, own in brute_components(odd_documents(), 5, 80) if own}
        assert nulls == 2 and sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(kept)
    elif name == "substring dedup":
        assert len(rows) == docs.count() and nulls == 2 and all(r.n_chars == len(r.text) for r in rows)
        assert {r.text for r in rows if r.doc_id == 131} == {""}
    elif name == "decontamination":
        assert sorted(map(repr, (r.doc_id for r in rows))) == sorted(map(repr, (r.doc_id for r in docs.collect())))
    else:
        assert {tuple(r) for r in rows} <= {tuple(r) for r in docs.select(out.columns).collect()}


@pytest.mark.parametrize("name", STAGES)
def test_stage_of_no_documents(spark, name):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert dict(corpus_pipeline.STAGES)[name](spark, odd_corpus(spark).limit(0), SF).count() == 0


def test_equal_rows_of_an_id_are_one(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "a b c d e f", "en", "s", 11)] * 3 + [(1, "g h i j k l m", "en", "s", 13), (2, "n o p q r s", "en", "s", 11)]
    got = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, COLUMNS), SF).collect()
    assert sorted((r.doc_id, r.text[0]) for r in got) == [(1, "a"), (1, "g"), (2, "n")]
    other = [*rows, (1, "a b c d e f", "de", "s", 11), (1, "a b c d e f", "en", None, 11)]  # not equal: lang, source
    got = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(other, COLUMNS), SF).collect()
    assert sorted((r.doc_id, r.text[0], r.lang, r.source or "") for r in got) == [(1, "a", "de", "s"), (1, "a", "en", ""), (1, "a", "en", "s"), (1, "g", "en", "s"), (2, "n", "en", "s")]
