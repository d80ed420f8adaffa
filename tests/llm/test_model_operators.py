"""Quality, HTML extraction, nearest neighbours and the pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.fixtures import frame, odd_documents, prose
from tidemark.llm import html_extraction, nearest, quality
from tidemark.llm.html_blocks import blocks
from tidemark.llm.labelled_pages import labelled_pages

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    got = {r.doc_id: r for r in quality.op3(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(got[r.doc_id].predicted, r.quality) for r in labels if got[r.doc_id].held_out]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_quality_of_odd_rows(spark):
    docs = frame(spark, [*odd_documents(), (None, "x")])
    labels = spark.createDataFrame([(i, i % 2, "z") for i in range(20)] + [(3, None, "z"), (None, 1, "z")], "doc_id bigint, quality int, text string")
    got = quality.score_documents(docs, labels, carry=("score",)).toDF("doc_id", "held_out", "p", "predicted", "carried").collect()
    assert len(got) == docs.count() and all(np.isfinite(r.p) and r.carried == "s" for r in got)
    assert {r.p for r in quality.score_documents(docs, labels.limit(0)).toDF("doc_id", "held_out", "p", "predicted").collect()} == {0.5}
    assert quality.score_documents(frame(spark, []), labels).count() == 0


def test_isotonic_pools_violators():
    x, y = quality.isotonic(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert np.all(np.diff(y) >= 0) and np.interp(1.5, x, y) == pytest.approx(0.5)


def test_extraction_of_unseen_layouts():
    chain = html_extraction.trained()
    n = wrong = 0
    for html, main in labelled_pages(150, seed=77):
        own = blocks(html)
        for b, label in zip(own, chain.decode(own), strict=True):
            n, wrong = n + 1, wrong + (label != (b.text in main))
    assert wrong / n < 0.01


def test_viterbi_is_the_best_path():
    chain = html_extraction.trained()
    own = blocks(labelled_pages(3, seed=5)[2][0])[:9]
    s = chain.scores(own)

    def total(y):
        return chain.edge[0, y[0]] + chain.edge[1, y[-1]] + sum(s[i, v] for i, v in enumerate(y)) + sum(chain.step[a, b] for a, b in zip(y, y[1:], strict=False))

    best = max((tuple(k >> i & 1 for i in range(len(own))) for k in range(1 << len(own))), key=total)
    assert tuple(chain.decode(own)) == best


def test_extraction_text_rules(spark):
    html = '<html><head><title>t</title></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav><article><h1>Head &amp; line</h1><p>First\n  para &eacute;<script>x()</script> with words enough to count, and more.<p>Second <b>bold</b>ly put sentence here. It has two.</article><div class="comments"><p>Nice, thanks for this.</p></div><footer>&copy; me</footer>'
    rows = [(1, "u", html, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p", "x"), (4, "u", "<p>" + "A long text of words, again. " * 9000, "x")]
    got = {r.page_id: r for r in html_extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()}
    assert got[1].text == "Head & line\nFirst para é with words enough to count, and more.\nSecond boldly put sentence here. It has two."
    assert got[2].text == got[3].text == "" and got[2].url is None and got[2].n_chars == 0
    assert got[4].n_chars == len(got[4].text) == 9000 * 29 - 1
    assert html_extraction.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


@pytest.mark.parametrize(("inner", "want"), [
    ('<svg class="i"/>', []),
    ('<svg><path d="x"/><text>no</text></svg>', []),
    ("<svg><g><text>no</text>", []),
    ('<p>in <svg viewBox="0"><use href="#a"/></svg> line</p>', ["in line"]),
    ("<noscript>no<p>no</p></noscript>", []),
    ("<div>a<noscript>no</div>", ["a"]),
    ('<div><object data="x"><p>no</p></div>', []),
    ("<template><div>no</div></template>", []),
    ("<p>a<noscript><p>no</p></noscript>b</p>", ["ab"]),
    ("<textarea>no<p>no</textarea>", []),
    ("<p>1 < 2<p>x</b></p></p>", ["1 < 2", "x"]),
])
def test_elements_without_text_take_no_more_than_their_own(inner, want):
    from tidemark.llm.html_blocks import blocks

    got = [b.text for b in blocks(f"<article><p>One</p>{inner}<p>Two two</p><p>Three</p></article><p>After</p>")]
    assert got == ["One", *want, "Two two", "Three", "After"]


def test_pages_of_the_table(spark):
    import html as h
    import re

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = [" ".join(h.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert html_extraction.main_text(r.html, html_extraction.trained()) == "\n".join(x for x in want if x)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, cell string, score double")


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, q, turn = rng.normal(size=(2000, 64)), rng.normal(size=(5, 64)), nearest.rotation(64)
    center = x.mean(0)
    low, high = nearest.bounds(*nearest.encode(x, center, turn), (q - center) @ turn)
    true = ((x[None] - q[:, None]) ** 2).sum(2)
    assert ((low <= true) & (true <= high)).mean() > 0.98


def test_nearest_of_few_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=8).tolist()) for i in range(40)] + [(100 + i, [1.0] * 8) for i in range(30)]
    bad = [(50, None), (51, [0.0] * 8), (52, [1.0, None] + [0.0] * 6), (53, [float("nan")] * 8), (54, [float("inf")] * 8), (None, [1.0] * 8), (55, [1.0] * 3), (56, [])]
    df = vectors(spark, good + bad)
    got = nearest.search(df, df.filter("vec_id % 10 = 0"), k=5, block=16).collect()
    x = {i: np.array(v, np.float32).astype(float) for i, v in good}
    for q in {r.query_id for r in got}:
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        want = sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), i) for i, v in x.items() if i != q)[:5]
        assert [(r["rank"], r.vec_id) for r in own] == [(k + 1, i) for k, (_, i) in enumerate(want)]
        assert [r.score for r in own] == pytest.approx([d for d, _ in want])
    assert {r.query_id for r in got} == {i for i in x if i % 10 == 0}
    few = vectors(spark, good[:3])
    assert nearest.search(few, few).count() == 6
    assert nearest.search(vectors(spark, []), vectors(spark, [])).count() == 0


def test_each_length_is_searched_for_itself(spark):
    rng = np.random.default_rng(4)
    lengths = [8, 5, 5, 8, 5, 8, 3]
    rows = [(i, rng.normal(size=lengths[i % 7]).tolist()) for i in range(105)] + [(200, [1.0, 2.0]), (210, [3.0] * 9)]
    df = vectors(spark, rows)
    got: dict[int, list] = {}
    asked = df.filter("vec_id % 10 = 0").unionByName(vectors(spark, [(300, [1.0] * 4)]))  # of this length no vector is indexed
    for r in nearest.search(df, asked, k=4, cells=3, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    want = {q: [i for _, i in sorted((float(np.linalg.norm(x[q] - v)), i) for i, v in x.items() if i != q and len(v) == len(x[q]))[:4]] for q in x if q % 10 == 0}
    assert got == {q: w for q, w in want.items() if w}


def test_cells_are_in_order():
    rng = np.random.default_rng(5)
    x, centers = rng.normal(size=(50, 6)), rng.normal(size=(30, 6))
    full = nearest._order(x, centers, 30)
    assert all((nearest._order(x, centers, n) == full[:, :n]).all() for n in (1, 2, 7, 29))


@pytest.mark.parametrize(("n", "every"), [(3000, 50), (20_000, 200)])
def test_recall_with_cells(spark, n, every):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(n, 32)) + 2 * rng.normal(size=(20, 32))[rng.integers(0, 20, n)]).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 32).cast(pa.list_(pa.float32()))}))
    got: dict[int, set] = {}
    for r in nearest.search(df, df.filter(f"vec_id % {every} = 0"), block=500).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    d = x.astype(float)
    hit = 0
    for q in range(0, n, every):
        a = ((d - d[q]) ** 2).sum(1)
        a[q] = np.inf
        hit += len(set(np.argsort(a)[:10].tolist()) & got[q])
    assert hit >= 0.9 * 10 * len(got) and len(got) == n // every


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.test_text_operators import brute_components, brute_repeats
    from tidemark.llm import decontamination
    from tidemark.llm.common import keep, table

    docs = table(spark, SF, "documents").filter("doc_id < 300")
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "near dedup", "substring dedup", "decontamination", "packing"]
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(keep(stage(spark, steps[-1], SF), name.replace(" ", "-")))
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    assert all(s.columns == docs.columns for s in steps[:-1])
    known = [i for i in ids[0] if i in labels]
    assert np.mean([(i in ids[1]) == bool(labels[i]) for i in known]) > 0.97
    one = [(r.doc_id, r.text) for r in steps[1].collect()]
    assert ids[2] == {i for i, _, _, kept in brute_components(one, 5, 80) if kept}
    two = [(r.doc_id, r.text) for r in steps[2].collect()]
    cut = {r.doc_id: r.text for r in steps[3].collect()}
    for i, _, removed, kept in brute_repeats(two, 50):
        assert " ".join(cut[i].split()) == " ".join(kept.split()) and (removed or cut[i] == dict(two)[i])
    bad = {r.doc_id for r in decontamination.contaminations(steps[3], table(spark, SF, "benchmark")).collect()}
    assert ids[4] == ids[3] - bad and ids[5] == ids[4]


def test_random_texts_have_finite_statistics():
    rng = random.Random(8)
    assert np.isfinite(quality.statistics([b"", b" ", prose(rng, 50).encode(), b"x" * 100_000, "é\n".encode() * 50])).all()


@pytest.mark.parametrize("bad", ["<b", "<a ", '<a "', '<p title="', "<b<", "</script", "<!--", '<a x="><a x="y'])
def test_pages_with_unclosed_tags_are_scanned_once(bad):
    """1 MB of each, with and without a > at the end."""
    import time

    for page in (bad * (10**6 // len(bad)), bad * (10**6 // len(bad)) + ">"):
        start = time.perf_counter()
        blocks(page)
        assert time.perf_counter() - start < 3


def test_unclosed_quotes_and_late_brackets_are_text():
    assert [b.text for b in blocks('<p>one<p title="two>three')] == ["one", "three"]
    assert [b.text for b in blocks("<p>a < b and c <d")] == ["a < b and c <d"]
    assert [b.text for b in blocks("<p>x<!-- never closed <p>y")] == ["x"]
    assert [(b.text, b.linked) for b in blocks("<p><a href=/x/>link</a> rest")] == [("link rest", 4)]
    many = "".join(f'<i t="{i}>w{i} ' for i in range(41))  # the last quote has no partner, so scans fail again and again
    assert blocks("<p>" + many + "<b>end</b>")[-1].text.endswith("end")


def test_deep_nesting_has_a_bound():
    page = "<div>" * 3000 + "text" + "</div>" * 3000 + "<p>after"
    found = blocks(page)
    assert [b.text for b in found] == ["text", "after"] and len(found[0].path) == 512 and found[1].path == ("p",)
