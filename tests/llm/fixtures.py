"""Small documents with every odd case, and helpers."""

from __future__ import annotations

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, n_words string, kept string, score string"


def words(text):
    return WORD.findall(text or "")


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijkäé,.", k=rng.randint(1, 7))) for _ in range(n))


def odd_documents(seed=1):
    """(id, text) with copies, near copies, shared passages, nulls, empties, a very long text, repeated rows."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 160)) for _ in range(30)]
    passage = prose(rng, 60)
    rows = list(enumerate(base))
    rows += [(100, base[3]), (101, base[3]), (102, base[3] + " extra"), (103, base[7] + "\n" + passage), (104, passage + " " + base[8]), (105, base[9] + " " + passage + " " + base[10])]
    rows += [(110, None), (111, ""), (112, " \n\t "), (113, "one"), (114, "one"), (115, "one two"), (116, "One two")]
    rows += [(120, prose(rng, 9000) + " " + passage), (121, "same " * 300), (122, "same " * 280), (123, "a\x0bb\x0cc d e " * 40)]
    rows += [(100, base[3]), (130, passage), (131, passage)]
    for i in range(12):
        w = base[5].split()
        if len(w) > 40:
            w[i % len(w)] = f"x{i}"
        rows.append((140 + i, " ".join(w)))
    return rows


def frame(spark, rows):
    """With extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "n", "k", "s") for i, t in rows], SCHEMA)
