"""Substring dedup, near dedup and decontamination against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import frame, odd_documents, prose, words
from tidemark.llm import decontamination, near_dedup, substring_dedup
from tidemark.llm.components import components


def brute_repeats(rows, size):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [50, 7])
def test_repeats_are_removed_exactly(spark, size):
    rows = [*odd_documents(), (None, odd_documents()[0][1])]
    got = substring_dedup.remove_repeats(frame(spark, rows), window=size)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_repeats(rows, size)


def test_repeats_keep_space_and_columns(spark):
    rng = random.Random(4)
    p = prose(rng, 60)
    docs = frame(spark, [(1, p), (2, "Before \n\n it.\n" + p + "\n\tAfter  it"), (3, " clean\n text ")])
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs, carry=("n_words", "kept"), keep_space=True).toDF("doc_id", "a", "b", "text", "c1", "c2").collect()}
    assert got[3].text == " clean\n text " and got[2].text == "Before \n\n it.\nAfter  it"
    assert (got[1].c1, got[1].c2) == ("n", "k")


def test_repeats_of_an_empty_table(spark):
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def shingles(text, size, lower=True):
    t = text or ""
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) if lower else t)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(i), top(j)
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(x), top(i), top(i) == i) for i, x in sets)


@pytest.mark.parametrize(("size", "percent", "rows"), [(3, 85, 8), (5, 80, 6)])
def test_near_duplicates_are_all_found(spark, size, percent, rows):
    docs = odd_documents()
    rng = random.Random(9)
    line = prose(rng, 40)
    docs += [(200 + i, line + " " + prose(rng, 9)) for i in range(60)]  # unlike, but with a common line
    chain = line.split()
    for i in range(8):  # each like the next, the last unlike the first
        chain = [f"y{i}", *chain[:-1]]
        docs.append((300 + i, " ".join(chain)))
    got = near_dedup.near_duplicates(frame(spark, docs), size=size, percent=percent, rows=rows)
    assert sorted(map(tuple, got.collect())) == brute_components(docs, size, percent)


def test_near_duplicates_of_null_ids_and_nothing(spark):
    got = near_dedup.near_duplicates(frame(spark, [(None, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, None, True), (1, 1, True)}
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (None, 3), (500, 499)]
    got = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 120)}, 500: 499}


def test_contaminations_are_exact(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, n)) for i, n in enumerate([30, 45, 12, 5, 60, 33])] + [(6, None), (7, ""), (8, "two words"), (9, "Single")]
    docs = odd_documents()
    for i, t in items[:6]:
        w = t.split()
        docs.append((400 + i, prose(rng, 500) + " " + t.upper() + " " + prose(rng, 900)))
        docs.append((500 + i, prose(rng, 50) + " " + " ".join([*w[: len(w) * 9 // 10], "zz"])))
        docs.append((600 + i, " ".join(w[: len(w) // 2])))
    docs += [(700, "has two  words\nhere"), (701, "single"), (702, None), (None, items[0][1])]
    bench = spark.createDataFrame([(i, t, "d") for i, t in items], "item_id bigint, text string, doc_id string")
    got = {tuple(r) for r in decontamination.contaminations(frame(spark, docs), bench).select("doc_id", "item_id", "n_item", "n_common").collect()}
    want = {}
    for i, t in items:
        w = words((t or "").lower())
        if not w:
            continue
        k = min(5, len(w))
        s = shingles((t or "").lower(), k)
        for d, x in docs:
            n = len(s & shingles((x or "").lower(), k)) if d is not None and len(words(x)) >= k else 0
            if n >= 0.8 * len(s):
                want[d, i] = (d, i, len(s), n)
    assert got == set(want.values()) and len(got) > 10
    bad = {d for d, _ in want}
    clean = decontamination.clean_documents(frame(spark, docs), bench)
    assert sorted(map(repr, (r.doc_id for r in clean.collect()))) == sorted(repr(d) for d, _ in docs if d not in bad)
    assert decontamination.contaminations(frame(spark, []), bench).count() == 0
    assert decontamination.contaminations(frame(spark, docs), bench.limit(0)).count() == 0


def test_contaminations_run_no_python(spark):
    plan = decontamination.contaminations(frame(spark, [(1, "a b c d e f")]), spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string"))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_digest_column(spark):
    got = substring_dedup.remove_repeats(frame(spark, [(1, " a  b\n")])).select(F.sha2("kept", 256).alias("d")).first().d
    assert got == hashlib.sha256(b"a b").hexdigest()


def test_ids_with_a_common_factor_are_dealt_evenly():
    """Parts of places are chosen by a mix of the id: all ids are multiples of 1,000, and of the number of parts."""
    from tidemark.llm.substring_dedup import _deal

    docs = np.arange(64_000, dtype=np.int64) * 1000
    sizes = [n for _, _, n, _ in _deal(docs, np.zeros(len(docs)), np.zeros(len(docs)), 40)]
    assert len(sizes) == 40 and sum(sizes) == len(docs) and max(sizes) < 1.2 * len(docs) / 40
