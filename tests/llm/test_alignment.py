"""Tokenizer alignment against a plain loop over tokens and their byte ranges."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.fixtures import odd_documents
from tidemark.llm import alignment
from tidemark.llm.common import table
from tidemark.llm.queries import QUERIES
from tidemark.llm.tokens import PieceEncoder

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(texts):
    """Rows without ids, by loops."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    shown, extra = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            shown[chr(byte)] = byte
        else:
            shown[chr(extra)], extra = byte, extra + 1
    names = {i: t for t, i in first.get_vocab().items()}
    links, rows = [], []
    for text in texts:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        a_bytes = [bytes(shown[c] for c in names[i]) for i in a]
        b_bytes = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        a_at, b_at = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        own, i, j = [], 0, 0
        if len(a) < 400:
            spans = [(y, b_at[m - 1] if m else 0, b_at[m]) for m, y in enumerate(b)]
            for k, x in enumerate(a):
                lo, hi = a_at[k - 1] if k else 0, a_at[k]
                own += [(x, y) for y, start, end in spans if max(lo, start) < min(hi, end)]
        while len(a) >= 400 and i < len(a):  # the same by two pointers
            own.append((a[i], b[j]))
            x, y = a_at[i], b_at[j]
            i, j = i + (x <= y), j + (y <= x)
        groups = []
        both, i, j = sorted(set(a_at) & set(b_at)), 0, 0
        for cut in both:
            left, right = [], []
            while i < len(a) and a_at[i] <= cut:
                left.append(str(a[i]))
                i += 1
            while j < len(b) and b_at[j] <= cut:
                right.append(str(b[j]))
                j += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        links.append(own)
        rows.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(x for own in links for x in own)
    most: dict[int, int] = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return [(n_a, n_b, n_groups, len(own), sum(count[x] == most[x[1]] for x in own), sum(count[x] for x in own), sha) for (n_a, n_b, n_groups, sha), own in zip(rows, links, strict=True)]


def found(df):
    return [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()]


def same(got, ids, texts):
    want = [(i, *r) for i, r in zip(ids, brute(texts), strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_query_on_the_whole_table(spark):
    rows = [(r.doc_id, r.text or "") for r in table(spark, SF, "documents").collect()]
    same(found(QUERIES["op12_alignment"](spark, SF)), *zip(*rows, strict=True))


ODD = ["<|endoftext|> and <s> </s>", "two  spaces ", "\n\nbreaks\n", "café é ﬁ", "a▁b", "▁", " ", "  lead", " nbsp  ", "\x00\x01", "😀😀 漢字かな", "tab\tand\r\n", "x" * 3000, "<0x41> <unk>"]


@pytest.mark.parametrize("run", [7, 2_000_000])
def test_odd_texts_and_many_runs(spark, run):
    """run 7: many runs of a slice each, more than are merged at once."""
    rows = [*odd_documents(), *((1000 + i, t) for i, t in enumerate(ODD * 2)), (None, "a null id"), (None, None)]
    df = spark.createDataFrame([(i, t, 5, "x", 1) for i, t in rows], "doc_id bigint, text string, n_a int, run string, part int").repartition(12 if run == 7 else 3)
    same(found(alignment.align_documents(df, A, B, run_links=run, fan_bits=2)), [i for i, _ in rows], [t or "" for _, t in rows])


def test_no_documents(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id bigint, text string"), A, B).count() == 0


def test_only_empty_texts(spark):
    got = found(alignment.align_documents(spark.createDataFrame([(1, None), (1, "")], "doc_id bigint, text string"), A, B))
    assert got == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_merge_by_heap_of_many_blocks():
    rng = np.random.default_rng(2)
    runs, total = [], Counter()
    for size in (0, 1, 5000, 30_000, 30_000, 17):
        p = np.sort(rng.choice(60_000, size, replace=False)).astype(np.uint32) * np.uint32(60_001)
        n = rng.integers(1, 1 << 40, size).astype(np.uint64)
        runs.append((p, n))
        total.update(dict(zip(p.tolist(), n.tolist(), strict=True)))
    heads = [alignment.head_of(iter([r])) for r in runs]
    for head, (p, n) in zip(heads, runs, strict=True):
        back = list(alignment.blocks_of(head))
        assert all(len(x) <= alignment.BLOCK for x, _ in back)
        assert [v for x, _ in back for v in x.tolist()] == p.tolist() and [v for _, x in back for v in x.tolist()] == n.tolist()
    got = list(alignment.merged([alignment.blocks_of(h) for h in heads]))
    pairs = [v for x, _ in got for v in x.tolist()]
    assert pairs == sorted(total) and dict(zip(pairs, (v for _, x in got for v in x.tolist()), strict=True)) == total


def test_pieces_are_the_models_pieces():
    own, plain = PieceEncoder(B), sentencepiece.SentencePieceProcessor(model_file=B)
    texts = [*ODD, *(t for _, t in odd_documents() if t), "", "word " * 50, "line\nline two\n\nthree"]
    for _ in range(2):
        assert [x.tolist() for x in own.encode(texts)] == plain.encode(texts)
        own.shrink(1)
