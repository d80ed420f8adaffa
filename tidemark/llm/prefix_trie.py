"""Prefix trie of conversations.

Method: van Emde Boas recursion. Trees of height 2^(j+1) are cut at half their depth; a cut prefix
is named by its smallest member and its depth, and the name is the root of the lower trees that
hang below it. Upper and lower trees of all sizes are cut in the same rounds, so there are as many
rounds as the greatest depth has bits. Then sums of whole lower trees are grafted onto the cut nodes
in two sweeps over the same cuts: trees are summed from small to large, and what hangs below a cut
is handed down the cuts from large to small, to all nodes above it. Work is linear in the nodes, not
in nodes times depth.

Turns are compared by 128 bits of SHA-256, aligned blocks of 2^j turns by a digest of their
halves' digests; so a cut is one comparison whatever its length, and no conversation, prefix or
group of copies is ever gathered in one row. Copies of a sequence become one row with their number
before the first cut. A crowded prefix meets its name in a join that AQE splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.windows import numbered

from .common import drop, keep, table

FAMILY = 5
LONGEST_SHARED = 9
CHUNK = 1 << 20
"""Bytes of joined ids that travel as one row."""


def shared_turns(conv: Column) -> Column:
    """Turns that a conversation takes from the first of its family."""
    return (F.crc32(conv.cast("string").cast("binary")) % LONGEST_SHARED).cast("long")


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _digest(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv, pos, turn, bytes): turns numbered from 0, turn a digest of role and text; a written table.

    Null turns come first, turns of one number by their digests; rows with a null conv_id take no part.
    """
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv"), conversations["turn"].cast("long").alias("at"),
        _digest(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("turn"), F.octet_length(text).cast("long").alias("bytes"),
    ).filter("conv is not null")
    return keep(numbered(rows, ["conv"], [F.col("at").asc_nulls_first(), F.col("turn")]).select("conv", F.col("n").alias("pos"), "turn", "bytes"), "turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv, pos, turn, bytes, len), and (conv, len) of all of them; written tables.

    Conversation c starts with the first h turns of c - c % 5, all if it has fewer, and goes on with its
    own turns after its first h. c % 5 has the sign of c.
    """
    c = F.col("conv")
    sizes = keep(turns.groupBy("conv").agg(F.count("*").alias("own")), "sizes")
    first = sizes.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    taken = F.least(shared_turns(c), F.coalesce("base_own", F.lit(0)))
    lengths = sizes.join(first, c - c % FAMILY == F.col("base"), "left").select("conv", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("own") - shared_turns(c))).alias("len"))
    lengths = keep(lengths, "lengths")
    # a first turn goes to the few conversations of its family
    family = turns.filter(F.col("pos") < LONGEST_SHARED - 1).filter(c % FAMILY == 0)
    family = family.select(F.explode(F.sequence(c - FAMILY + 1, c + FAMILY - 1)).alias("member"), "conv", "pos", "turn", "bytes")
    family = family.filter((F.col("member") - F.col("member") % FAMILY == F.col("conv")) & (F.col("pos") < shared_turns(F.col("member")))).select(F.col("member").alias("conv"), "pos", "turn", "bytes")
    own = turns.filter(F.col("pos") >= shared_turns(c))
    shared = family.join(lengths.select("conv", "len"), "conv")
    rest = own.join(lengths, "conv").select("conv", (F.col("taken") + F.col("pos") - shared_turns(c)).alias("pos"), "turn", "bytes", "len")
    out = keep(shared.unionByName(rest), "rebuilt")
    drop(sizes)
    return out, lengths


def _blocks(turns: DataFrame, levels: int) -> list[DataFrame]:
    """Of each level j the digests of aligned blocks of 2^j turns: (conv, i, len, block)."""
    out = [turns.select("conv", F.col("pos").alias("i"), "len", F.col("turn").alias("block"))]
    for j in range(1, levels + 1):
        half = F.struct("i", "block")
        pairs = out[-1].groupBy("conv", F.shiftright("i", 1).alias("k")).agg(F.count("*").alias("n"), F.first("len").alias("len"), F.min(half).alias("a"), F.max(half).alias("b"))
        out.append(keep(pairs.filter("n = 2").select("conv", F.col("k").alias("i"), "len", _digest(F.col("a.block"), F.col("b.block")).alias("block")), f"blocks-{j}"))
    return out


def _sequences(lengths: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """(conv, len, name): equal names are equal sequences; from at most one block a bit of the length."""
    parts = []
    for j, b in enumerate(blocks):
        last = (F.shiftright("len", j).bitwiseAND(F.lit(1)) == 1) & (F.col("i") == F.shiftright("len", j + 1) * 2)
        parts.append(b.filter(last).select("conv", F.struct(F.lit(-j).alias("j"), "block").alias("part")))
    found = _union(parts).groupBy("conv").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    name = F.substring(F.sha2(F.array_join(F.transform("parts", lambda p: p["block"]), ""), 256), 1, 32)
    return lengths.select("conv", "len").join(found, "conv", "left").select("conv", "len", F.when(F.col("len") > 0, name).otherwise("").alias("name"))


def ends_digests(sequences: DataFrame) -> DataFrame:
    """(end, ends_sha256) of each sequence: its smallest conversation, and SHA-256 of all in ascending order.

    Conversations are dealt by ranges of (sequence, id). A task digests the sequences that lie inside its
    range; those at its ends may go on in the next and travel as chunks of joined ids. SHA-256 has no
    parts that could be made apart, so one task reads a sequence's chunks, one at a time.
    """
    chunk = T.StructType([T.StructField("name", T.StringType()), T.StructField("end", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("sha", T.StringType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # only the first run of a range may have begun before it, and only the last may go on
        now, first, ids, size, part = None, None, [], 0, True

        def row(part: bool) -> tuple:
            """What is left of the run, as a chunk if it is a part of one, else its digest."""
            joined = ",".join(ids).encode()
            return (now, first, joined, None) if part else (None, first, None, hashlib.sha256(joined).hexdigest())

        out: list[tuple] = []
        for batch in batches:
            for name, conv in zip(batch.column("name").to_pylist(), batch.column("conv").to_pylist(), strict=True):
                if name != now:
                    if now is not None:
                        out.append(row(part))
                        part = False
                    now, first, ids, size = name, conv, [], 0
                elif size > CHUNK:
                    out.append(row(True))
                    first, ids, size, part = conv, [], 0, True
                ids.append(str(conv))
                size += len(ids[-1]) + 1
                if len(out) >= 4096 or sum(len(r[2] or b"") for r in out[-8:]) > CHUNK:
                    yield pa.RecordBatch.from_pylist([dict(zip(chunk.names, r, strict=True)) for r in out], schema=arrow)
                    out = []
        if now is not None:
            out.append(row(True))
        yield pa.RecordBatch.from_pylist([dict(zip(chunk.names, r, strict=True)) for r in out], schema=arrow)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, sha = None, None, None
        for batch in batches:
            out = []
            for name, end, ids in zip(batch.column("name").to_pylist(), batch.column("end").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if name != now:
                    if now is not None:
                        out.append({"end": first, "ends_sha256": sha.hexdigest()})
                    now, first, sha = name, end, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids)
            yield pa.RecordBatch.from_pylist(out, schema=result)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"end": first, "ends_sha256": sha.hexdigest()}], schema=result)

    arrow = pa.schema([("name", pa.string()), ("end", pa.int64()), ("ids", pa.binary()), ("sha", pa.string())])
    result = pa.schema([("end", pa.int64()), ("ends_sha256", pa.string())])
    named = sequences.select(F.concat(F.col("len").cast("string"), F.lit(":"), "name").alias("name"), "conv")
    ranged = named.repartitionByRange("name", "conv").sortWithinPartitions("name", "conv")
    found = keep(ranged.mapInArrow(local, chunk), "ends")
    chunks = found.filter("ids is not null").select("name", "end", "ids").repartition("name").sortWithinPartitions("name", "end")
    whole = found.filter("ids is null").select("end", F.col("sha").alias("ends_sha256"))
    return whole.unionByName(chunks.mapInArrow(joined, "end long, ends_sha256 string"))


def _cut(pieces: DataFrame, blocks: DataFrame, j: int) -> DataFrame:
    """Cuts trees of height 2^(j+1) at half their depth.

    A piece (root, depth, conv, n, len, end) is what a group of n equal sequences has in the tree named
    (root, depth); conv is its smallest member, end the smallest of those that stop at its end.
    """
    half = 1 << j
    reach = pieces.filter(F.col("len") >= half).join(blocks.select("conv", "i", "block"), (pieces["conv"] == blocks["conv"]) & (blocks["i"] * half == pieces["depth"])).select(pieces["*"], "block")
    reach = keep(reach, f"reach-{j}")
    names = reach.groupBy("root", "depth", "block").agg(F.min("conv").alias("name"), F.sum("n").alias("n"), F.min(F.when(F.col("len") == half, F.col("end"))).alias("end"))
    upper = names.select("root", "depth", F.col("name").alias("conv"), "n", F.lit(half).cast("long").alias("len"), "end")
    beyond = reach.filter(F.col("len") > half).join(names.select("root", "depth", "block", "name"), ["root", "depth", "block"])
    lower = beyond.select(F.col("name").alias("root"), (F.col("depth") + half).alias("depth"), "conv", "n", (F.col("len") - half).alias("len"), "end")
    out = keep(pieces.filter(F.col("len") < half).unionByName(upper).unionByName(lower), f"pieces-{j}")
    drop(reach)
    return out


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first d turns of the rebuilt conversations, the root (d = 0) included.

    conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves
    (childless nodes of its subtree), saved_tokens (over its subtree, members beyond the first times UTF-8 bytes of the
    last text), ends_sha256 (of the members with just these turns, ids ascending and joined by commas).

    Null roles and texts are empty ones; null turns come first, repeated rows are turns of their own, ties as in
    turns_in_order. Rows with a null conv_id take no part; an empty table has no nodes. Extra columns are ignored.
    """
    spark = conversations.sparkSession
    raw = turns_in_order(conversations)
    turns, lengths = rebuilt(raw)
    root, n_all, longest = lengths.agg(F.min("conv"), F.count("*"), F.max("len")).first()
    levels = max(0, (longest or 0) - 1).bit_length()
    blocks = _blocks(turns, levels)
    sequences = keep(_sequences(lengths, blocks), "sequences")
    ends = keep(ends_digests(sequences), "ends-digests")
    copies = sequences.groupBy("len", "name").agg(F.min("conv").alias("conv"), F.count("*").alias("n"))
    pieces = keep(copies.select(F.lit(root).cast("long").alias("root"), F.lit(0).cast("long").alias("depth"), "conv", "n", "len", F.col("conv").alias("end")), "pieces")
    stopped = pieces.filter("len = 0").select("end").first()  # at most one row
    top, cuts = pieces, []
    pieces = pieces.filter("len > 0")
    for j in reversed(range(max(1, levels))):
        pieces = _cut(pieces, blocks[j], j)
        # full pieces end in a node at each 2^j-th depth: (conv, depth), and the node 2^j turns above it
        cuts.append(pieces.filter(F.col("len") == 1 << j).select("conv", (F.col("depth") + (1 << j)).alias("depth"), F.col("root").alias("up")))
    cuts.reverse()
    size = turns.select("conv", (F.col("pos") + 1).alias("depth"), "bytes")
    nodes = pieces.select("conv", (F.col("depth") + 1).alias("depth"), F.col("root").alias("parent"), "n", "end").join(size, ["conv", "depth"])
    top_row = spark.createDataFrame([(root, 0, None, n_all, stopped.end if stopped else None, 0)] if n_all else [], "conv long, depth long, parent long, n long, end long, bytes long")
    nodes = keep(nodes.unionByName(top_row), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("children"))
    own = nodes.join(children, ["conv", "depth"], "left").select(nodes["*"], F.coalesce("children", F.lit(0)).alias("children"), F.when(F.col("children").isNull(), 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("bytes")).alias("saved"))
    own = keep(own, "own")

    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    # whole trees, from small to large: a tree of height 2^(j+1) is its upper one and all lower ones
    trees = [keep(own.filter("depth > 0").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(*sums), "trees-0")]
    for j in range(levels):
        t, step = trees[-1], 1 << j
        odd = F.col("depth") % (2 * step) == step
        lower = t.filter(odd).join(cuts[j], ["conv", "depth"]).select(F.col("up").alias("conv"), (F.col("depth") - step).alias("depth"), "leaves", "saved")
        trees.append(keep(t.filter(~odd).unionByName(lower).groupBy("conv", "depth").agg(*sums), f"trees-{j + 1}"))
    # grafts, from large to small: what hangs below a cut node belongs to all nodes above it in its tree
    grafts = trees[-1].filter("depth > 0")
    used = []
    for j in reversed(range(levels)):
        step = 1 << j
        both = F.array(F.struct("conv", "depth"), F.struct(F.col("up").alias("conv"), (F.col("depth") - step).alias("depth")))
        handed = grafts.join(cuts[j], ["conv", "depth"]).select(F.explode(both).alias("v"), "leaves", "saved").select("v.*", "leaves", "saved")
        grafts = keep(handed.unionByName(trees[j].filter(F.col("depth") % (2 * step) == step)).groupBy("conv", "depth").agg(*sums), f"grafts-{j}")
        used.append(grafts)
    below = grafts.unionByName(trees[-1].filter("depth = 0"))
    total = own.join(below.select("conv", "depth", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved")), ["conv", "depth"], "left")
    out = total.join(ends.withColumnRenamed("end", "e"), F.col("end") == F.col("e"), "left")
    none = hashlib.sha256(b"").hexdigest()
    zero = F.lit(0)
    out = out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("n_leaves"), (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
    out = keep(out, "trie")
    drop(raw, turns, lengths, sequences, ends, top, nodes, own, *blocks[1:], *trees, *used)
    return out


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(turn, -9223372036854775808) AS turn_no, turn IS NOT NULL AS has_turn, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn,
    sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS h
  FROM conversations WHERE conv_id IS NOT NULL
), s AS (
  SELECT c, list(turn ORDER BY has_turn, turn_no, h) AS own FROM t GROUP BY c
), k AS (
  SELECT c, own, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, i: xor(a >> 1, 3988292384 * (a & 1))))) % 9 AS h FROM s
), r AS (
  SELECT k.c, list_concat(coalesce(b.own, [])[1:k.h], k.own[k.h + 1:]) AS seq FROM k LEFT JOIN s b ON b.c = k.c - k.c % 5
), p AS (
  SELECT c, len(seq) AS len, d, seq[1:d] AS prefix, CASE WHEN d > 0 THEN strlen(seq[d].text) ELSE 0 END AS bytes FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM r)
), v AS (
  SELECT d, prefix, min(c) AS id, count(*) AS n, any_value(bytes) AS bytes, string_agg(CASE WHEN len = d THEN c::VARCHAR END, ',' ORDER BY c) AS ends FROM p GROUP BY d, prefix
), u AS (
  SELECT v.*, q.id AS parent FROM v LEFT JOIN v q ON q.d = v.d - 1 AND q.prefix = v.prefix[1:v.d - 1]
), w AS (
  SELECT u.*, (SELECT count(*) FROM u x WHERE x.d = u.d + 1 AND x.parent = u.id) AS n_children FROM u
), a AS (
  SELECT k, prefix[1:k] AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n - 1) * bytes) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM w) GROUP BY 1, 2
)
SELECT w.id AS conv_id, w.d AS depth, w.parent AS parent_conv_id, w.n AS n_convs, w.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN a ON a.k = w.d AND a.prefix = w.prefix
"""
