"""Prefix trie of conversations against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tidemark.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, n string, block int"


def brute(rows):
    convs: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            h = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, h, (role, text)))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in convs.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = own.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])[:h] + turns[h:]
    members: dict[tuple, list] = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids: dict[tuple, list] = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        below = [out[k] for k in kids.get(p, [])]
        saved = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        ends = sorted(c for c in members[p] if len(seqs[c]) == len(p))
        out[p] = (
            min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), sum(b[5] for b in below) or 1, saved + sum(b[6] for b in below),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return sorted(out.values())


def found(spark, rows):
    df = spark.createDataFrame([(*r, 3, "n", 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in prefix_trie.trie(df).collect())


def test_random_conversations_share_prefixes(spark):
    rng, rows = random.Random(3), []
    for c in range(-12, 60):
        for t in range(rng.choice((1, 2, 3, 5, 8, 9, 13))):
            rows.append((c, t, "user" if t % 2 == 0 else None, rng.choice(("hi", "héllo", "hi", "", None))))
    assert found(spark, rows) == brute(rows)


def test_copies_long_conversations_nulls_and_ties(spark):
    rng = random.Random(8)
    common = [(t, "user", f"turn {t}") for t in range(37)]
    rows = [(c, t, r, x) for c in range(0, 100, 5) for t, r, x in common[: rng.choice((20, 36, 37))]]
    rows += [(c, t, "user", "one opening") for c in range(200, 320) for t in range(2)]  # many equal conversations
    rows += [(401, None, "system", "null turn first"), (401, 3, "user", "b"), (401, 3, "user", "a"), (401, 3, "user", "a"), (402, 0, None, None)]
    rows += [(None, 0, "user", "no id"), (10**15 + 3, 0, "user", "x"), (503, 7, "user", "own turns fewer than shared")]
    assert found(spark, rows) == brute(rows)


def test_ends_of_a_crowded_sequence_travel_in_chunks(spark, monkeypatch):
    ids = [3 * i for i in range(40_000)]
    names = spark.createDataFrame([(i, 4, "a" if i % 2 else "b") for i in ids] + [(1, 2, "c")], "conv long, len long, name string")
    chunks = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {r.end: r.ends_sha256 for r in prefix_trie.ends_digests(names).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", chunks)
    want = {}
    for own in ([i for i in ids if i % 2], [i for i in ids if not i % 2], [1]):
        want[own[0]] = hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
    assert got == want


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(4, None, None, None)], [(2, 0, "user", "a"), (2, 1, "user", "b")]])
def test_few_or_no_turns(spark, rows):
    assert found(spark, rows) == brute(rows)
