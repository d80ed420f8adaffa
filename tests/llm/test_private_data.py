"""Personal data: base spans against the plain patterns, the model on held-out examples, the query on its whole table."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest

from tests.llm.fixtures import odd_documents
from tidemark.llm import private_data, private_spans
from tidemark.llm.common import table
from tidemark.llm.private_spans import KINDS, Span
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(PLAIN[kind], text) if passes(kind, m[0]))


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_are_those_of_the_patterns(seed):
    rng = random.Random(seed)
    bits = ["a", "b.c", "@", ".", "-", "+", " ", "(", ")", "1", "12", "255", "256", "0007", "4111111111111111", "4111 1111 1111 1111", "+1 (487) 555-7209", "10.0.0.1", "x@y.z", "é", "\U0001f600", "%", "_", "\n", "٣"]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert [tuple(s) for s in private_spans.base_spans(text)] == brute(text), text


def test_query_on_the_whole_table(spark):
    got = {r.doc_id: r for r in QUERIES["op13_private_data"](spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        want, r = brute(d.text or ""), got[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        base = [f"{KINDS[k]}:{s}:{e}" for s, k, e in want]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = [x for x in r.spans.split(",") if x]
        assert set(base) <= set(spans)
        assert spans == sorted(spans, key=lambda x: (int(x.split(":")[1]), KINDS.index(x.split(":")[0])))


def test_odd_documents(spark):
    rows = [*odd_documents(), (None, "call (487) 555-7209 now"), (7001, "one 4111 1111 1111 1111 and a@b.co"), (7001, "one 4111 1111 1111 1111 and a@b.co"), (7002, "\U0001f600 tel: 487-555-7209. write me at jo.doe [at] mail3.com")]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id bigint, text string, spans string, redacted string, n_ip int")
    got = private_data.find_private(df, with_text=True).collect()
    assert len(got) == len(rows)
    own = {r.doc_id: r for r in got}
    assert own[110].spans == "" and own[110].redacted == "" and own[110].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert own[None].spans == "phone:5:19" and own[None].redacted == "call <PHONE> now" and own[None].n_phone == 0
    assert own[7001].redacted == "one <CARD> and <EMAIL>"
    assert own[7002].spans == "phone:7:19,email:33:54"
    assert private_data.find_private(df.limit(0)).count() == 0


def test_selected_spans_of_unseen_examples():
    model = private_spans.trained()
    x, good = private_spans.examples(3000, 77)
    chance = model.chance(x)
    for k in range(4):
        own = x[:, k] == 1
        chosen = own & (chance >= model.thresholds[k])
        assert good[chosen].mean() >= 0.98 and good[chosen].sum() >= 0.85 * good[own].sum(), KINDS[k]
    # calibrated: of the candidates that get a chance near p, about p are spans
    for lo in np.arange(0, 1, 0.25):
        near = (chance >= lo) & (chance <= lo + 0.25)
        if near.sum() >= 100:
            assert abs(good[near].mean() - chance[near].mean()) < 0.1


def test_trees_fit_what_no_single_feature_tells():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = private_spans.Trees(x[:1500], y[:1500], rounds=60)
    assert ((trees.raw(x[1500:]) > 0) == y[1500:]).mean() > 0.95
    assert (private_spans.Trees(x[:50], np.ones(50), rounds=3).raw(x[:5]) > 0).all()


@pytest.mark.parametrize("bad", ["1", "a", "+1(", "1.1.", "a@", "1 ", "a at ", "1-", "abcd:", "+", "ab.", "1111 ", "@", "+1 "])
def test_long_odd_texts_are_scanned_once(bad):
    text = bad * (500_000 // len(bad))
    start = time.perf_counter()
    base = private_spans.base_spans(text)
    private_spans.added_spans(text, base, private_spans.trained())
    assert time.perf_counter() - start < 8


def test_added_spans_touch_no_base_span_and_no_other():
    model, rng = private_spans.trained(), random.Random(5)
    bits = ["call 487-555-7209", "tel (487) 555-7209", "x@y.com", "10.0.0.1", "card 4111.1111.1111.1111", " at ", "jo (at) a.com", ", ", "555 ", "+1 487 555 7209"]
    for _ in range(300):
        text = " ".join(rng.choices(bits, k=8))
        base = private_spans.base_spans(text)
        added = private_spans.added_spans(text, base, model)
        assert added == sorted(added) and all(a.end <= b.start for a, b in zip(added[:-1], added[1:], strict=True))
        assert not any(a.start < b.end and b.start < a.end for a in added for b in base)
    assert private_spans.added_spans("nothing here", [], model) == [] and isinstance(added, list) and Span(1, 2, 3).kind == 2
