"""WARC archives, sharding, packing and binary records: round trips and brute force."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyarrow import fs
from tokenizers import Tokenizer

from tests.llm.fixtures import frame, odd_documents
from tidemark.llm import binary_records, packing, sharding, warc
from tidemark.llm.tokens import Encoder


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id bigint, url string, html string, path string, digest string")


def test_warc_round_trip_over_small_splits(spark, tmp_path):
    rng = random.Random(3)
    long = "".join(chr(rng.randint(32, 900)) for _ in range(60_000))
    rows = [(i, f"http://h/{i}\r\n", f"<p>{i}</p>" * 30) for i in range(40)]
    rows += [(50, None, None), (51, "u", ""), (52, "u", "short"), (53, "u", "short"), (54, "u", long), (56, "u", long), (55, "u", long), (57, "u", long), (None, "u", long), (58, "u", "WARC/1.1\r\n\r\n" * 20)]
    archives = warc.write_archives(pages(spark, rows), str(tmp_path / "w"))
    got = warc.read_archives(archives, split_bytes=700).collect()
    assert len(got) == len(rows)
    by = {r.record_id: r for r in got}
    for i, _, h in rows:
        r, payload = by[str(i) if i is not None else "null"], (h or "").encode()
        revisit = h == long and i != 54
        assert (r.type, r.refers_to) == (("revisit", "54") if revisit else ("response", None))
        assert r.digest == hashlib.sha256(payload).hexdigest() and r.payload_length == len(payload)
        assert bytes(r.content) == (b"" if revisit else payload)
    for path in {r.path for r in got}:
        assert gzip.open(path.removeprefix("file:")).read().startswith(b"WARC/1.1")


def test_warc_reader_rejects_false_magic(tmp_path):
    record = warc.member("response", "1", "u", "d", b"payload", 7)
    path = tmp_path / "a.gz"
    path.write_bytes(b"junk" + warc.MAGIC + b"junk" + gzip.compress(b"no warc") + record + warc.MAGIC)
    from tidemark.llm.files import reader

    with reader(str(path)) as f:
        assert [c for _, _, c in warc.records_in(f, 0, f.size())] == [b"payload"]


class Counted:
    """An open file that counts the bytes read."""

    def __init__(self, data):
        self.data, self.at, self.n = data, 0, 0

    def size(self):
        return len(self.data)

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        self.n += len(out)
        return out


def test_an_archive_is_read_once():
    rng = random.Random(4)
    data = b"".join(warc.member("response", str(i), "u", "d", rng.randbytes(rng.randint(0, 900)), 0) for i in range(10_000))
    file, found = Counted(data), []
    for lo in range(0, len(data), 1 << 20):
        found += [h["warc-record-id"] for _, h, _ in warc.records_in(file, lo, min(lo + (1 << 20), len(data)))]
    assert found == [f"<urn:row:{i}>" for i in range(10_000)]
    assert file.n < 2 * len(data)


def test_records_across_every_chunk_border():
    rng = random.Random(6)
    payloads = [rng.randbytes(rng.randint(0, 300)) for _ in range(20)]
    data = b"".join(warc.member("response", str(i), "u", "d", p, 0) for i, p in enumerate(payloads))
    for chunk in (7, 64, 300, 1000):
        for split in (50, 777, len(data)):
            got = [c for lo in range(0, len(data), split) for _, _, c in warc.records_in(Counted(data), lo, min(lo + split, len(data)), chunk)]
            assert got == payloads


def test_warc_of_nothing(spark, tmp_path):
    archives = warc.write_archives(pages(spark, []), str(tmp_path / "w"))
    assert archives.count() == 0 and warc.read_archives(archives).count() == 0


def sizes_strategy(seed):
    rng = random.Random(seed)
    return [sharding.Shard(f"s{i}", rng.choice([10, 50, 300, 5000, 40_000]) + rng.randint(0, 9)) for i in range(50)]


@pytest.mark.parametrize("seed", range(3))
def test_merges_stay_in_a_tier_and_below_the_target(seed):
    shards = sizes_strategy(seed)
    groups = sharding.plan_merges(shards, target=60_000, fan_in=4, least=100)
    used = [s.path for g in groups for s in g]
    assert len(used) == len(set(used)) and all(len(g) > 1 for g in groups)
    for g in groups:
        assert len({sharding.tier(s.n_bytes, 4, 100) for s in g}) == 1 and sum(s.n_bytes for s in g) <= 60_000


def test_shards_keep_every_row(spark, tmp_path):
    docs = frame(spark, odd_documents())
    store = sharding.shard_documents(docs, str(tmp_path / "t"), arrivals=6, target=1 << 20, fan_in=3, least=1 << 10)
    key = lambda df: sorted(map(repr, map(tuple, df.select(docs.columns).collect())))
    assert key(store.read()) == key(docs)
    last, before = store.version(), store.shards(1)
    assert last >= 7 and len(store.shards()) < 6 * 4
    small = sharding.ShardTable(spark, str(tmp_path / "s"), target=15_000, fan_in=3, least=1 << 10)
    for k in range(12):
        small.append(spark.range(k * 500, k * 500 + 500).selectExpr("id as doc_id", "hash(id) as h").coalesce(1))
    sizes = [s.n_bytes for s in small.shards()]
    small.compact("doc_id")
    merged = [s.n_bytes for s in small.shards()]
    assert 1 < len(merged) < len(sizes) and max(merged) < 20_000 and small.read().count() == 6000
    assert store.read(1).count() <= docs.count() and store.shards(1) == before
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit([], last - 1)
    assert store.version() == last


def test_an_empty_table_has_a_manifest_and_columns(spark, tmp_path):
    docs = frame(spark, [])
    store = sharding.shard_documents(docs, str(tmp_path / "e"))
    assert store.version() == 1 and store.shards() == [] and store.read().count() == 0
    assert store.read().columns == docs.columns
    store.append(frame(spark, [(None, None), (1, "x")]))
    assert store.read().count() == 2 and store.read(1).count() == 0
    docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    assert sharding.op7(spark, str(tmp_path / "sf")).collect() == []


def test_an_append_that_loses_a_race_is_tried_again(spark, tmp_path):
    store = sharding.ShardTable(spark, str(tmp_path / "r"))
    store.append(frame(spark, [(1, "a")]))
    rival, commit = sharding.ShardTable(spark, str(tmp_path / "r")), store.commit

    def late(shards, base):
        store.commit = commit
        rival.append(frame(spark, [(2, "b")]))
        return commit(shards, base)

    store.commit = late
    store.append(frame(spark, [(3, "c")]))
    assert store.version() == 3 and sorted(r.doc_id for r in store.read().collect()) == [1, 2, 3]


def compactable(spark, root, n=6):
    store = sharding.ShardTable(spark, root, target=1 << 20, fan_in=3, least=1 << 20)
    for k in range(n):
        store.append(spark.range(k * 50, k * 50 + 50).selectExpr("id as doc_id").coalesce(1))
    return store


def ids_of(store):
    return sorted(r.doc_id for r in store.read().collect())


def test_a_compaction_that_loses_a_race_to_an_append_is_kept(spark, tmp_path):
    store = compactable(spark, str(tmp_path / "r"))
    rival, commit = sharding.ShardTable(spark, store.root), store.commit

    def late(shards, base):
        store.commit = commit
        rival.append(spark.range(300, 350).selectExpr("id as doc_id").coalesce(1))
        return commit(shards, base)

    store.commit = late
    store.compact("doc_id")
    assert ids_of(store) == list(range(350)) and len(store.shards()) == 2
    assert sum("merged" in s.path for s in store._written(f"{store.root}/data")) == 1


def test_of_two_compactions_one_leaves_files(spark, tmp_path):
    store = compactable(spark, str(tmp_path / "r"))
    rival, commit = sharding.ShardTable(spark, store.root, target=1 << 20, fan_in=3, least=1 << 20), store.commit

    def late(shards, base):
        store.commit = commit
        rival.compact("doc_id")
        return commit(shards, base)

    store.commit = late
    store.compact("doc_id")
    assert ids_of(store) == list(range(300)) and len(store.shards()) == 1
    assert [s.path for s in store._written(f"{store.root}/data") if "merged" in s.path] == [store.shards()[0].path]


def test_a_commit_whose_answer_is_lost_counts_once(spark, tmp_path):
    store = compactable(spark, str(tmp_path / "r"))
    commit = store.commit

    def lost(shards, base):
        store.commit = commit
        commit(shards, base)
        raise OSError("connection reset")

    store.commit = lost
    store.append(spark.range(300, 350).selectExpr("id as doc_id").coalesce(1))
    assert ids_of(store) == list(range(350))
    store.commit = lost
    store.compact("doc_id")
    assert ids_of(store) == list(range(350)) and len(store.shards()) == 1


def test_files_of_a_merge_that_fails_go(spark, tmp_path):
    store = compactable(spark, str(tmp_path / "r"))
    with pytest.raises(Exception, match="nothing"):
        store.compact("nothing")  # no such column
    assert not any("merged" in s.path for s in store._written(f"{store.root}/data"))

    def failed(shards, base):
        raise OSError("no space")

    commit, store.commit = store.commit, failed
    with pytest.raises(OSError, match="no space"):
        store.compact("doc_id")
    assert ids_of(store) == list(range(300)) and store.expire(age=0) == 1  # the merged file
    store.commit = commit
    store.compact("doc_id")
    assert ids_of(store) == list(range(300)) and len(store.shards()) == 1


def test_expiry_keeps_what_the_last_versions_name(spark, tmp_path):
    store = compactable(spark, str(tmp_path / "r"))
    first = store.shards(5)
    store.compact("doc_id")
    assert store.expire() == 0 and len(store.read(5).collect()) == 250  # all files are young
    assert store.expire(versions=3, age=0) == 0 and store.shards(5) == first
    assert store.expire(age=0) == 6 and ids_of(store) == list(range(300))
    assert [s.path for s in store._written(f"{store.root}/data")] == [s.path for s in store.shards()] and store.version() == 7
    store.append(spark.range(300, 310).selectExpr("id as doc_id"))
    assert store.version() == 8 and ids_of(store) == list(range(310))


def test_arrivals_of_other_columns(spark, tmp_path):
    store = sharding.ShardTable(spark, str(tmp_path / "r"), fan_in=2)
    store.append(spark.sql("select 1L as doc_id, 'a' as text").coalesce(1))
    store.append(spark.sql("select 2L as doc_id").coalesce(1))
    for odd in ("select 3L as doc_id, 'c' as other", "select 'x' as doc_id, 'c' as text"):
        with pytest.raises(ValueError, match="other|doc_id"):
            store.append(spark.sql(odd))
    store.compact("doc_id")
    assert len(store.shards()) == 1 and sorted(map(tuple, store.read().collect())) == [(1, "a"), (2, None)]


def test_a_clashing_name_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="_arrival"):
        sharding.shard_documents(frame(spark, []).withColumnRenamed("score", "_arrival"), str(tmp_path / "c"))


def test_op7_tells_each_row_and_its_place(spark, tmp_path):
    rows = [*odd_documents(), (None, "null id")]
    frame(spark, rows).write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    got = sharding.op7(spark, str(tmp_path / "sf")).collect()
    digest = lambda t: (len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest())
    assert sorted((repr(r.doc_id), r.n_bytes, r.text_sha256) for r in got) == sorted((repr(i), *digest(t)) for i, t in rows)
    assert len({(r.shard, r.row) for r in got}) == len(rows) and len({r.version for r in got}) == 1
    for shard in {r.shard for r in got}:
        own = sorted((r for r in got if r.shard == shard), key=lambda r: r.row)
        assert [r.row for r in own] == list(range(len(own)))
        assert [r.doc_id or -1 for r in own] == sorted(r.doc_id or -1 for r in own)


@pytest.mark.parametrize(("name", "byte_level"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_ids_are_the_tokenizers_ids(name, byte_level):
    own = Encoder(public_tokenizers.path(name), byte_level)
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    texts = [t or "" for _, t in odd_documents()]
    texts += ["", " ", "  ", " a", "a ", "a  b", "\n", "a\n", "\na", "a\n\nb", "Hello, world! don't\tx y", "foo \n bar", "x y", "it's, 's 'S", "É́ áb", "<|endoftext|> x", "\x1c a\x1cb", "a\r\nb", "ΑΣ Σ İ ß", "日本 語。テ", "…. a…"]
    rng = random.Random(5)
    texts += ["".join(rng.choices("aB'.,! \n\t ́é1_", k=rng.randint(1, 40))) for _ in range(300)]
    texts += [" " + t for t in texts]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_records_round_trip(spark, tmp_path):
    rows = [*odd_documents(), (None, "null id")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = binary_records.write_records(frame(spark, rows), str(tmp_path / "r"), path, end_id=2, shard_bytes=20_000)
    got = binary_records.read_records(manifest).collect()
    plain = Tokenizer.from_file(path)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(plain.encode(t or "", add_special_tokens=False).ids + [2])
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == start and ids in want[r.doc_id]
        want[r.doc_id].remove(ids)
        start += len(ids)
    assert not any(want.values())
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    shard = manifest.first()
    with binary_records.reader(shard.path) as f, open(shard.path.removeprefix("file:").removesuffix(".bin") + ".idx", "rb") as x:
        places = np.frombuffer(x.read(), "<u8")
        all_ = list(binary_records.records(f))
        assert len(places) == shard.n_records and list(binary_records.records(f, places[::-1])) == all_[::-1]


def test_a_damaged_record_is_noticed(tmp_path):
    data = bytearray(binary_records.frame(binary_records.record(1, np.array([1, 2, 3]), 2)))
    data[14] ^= 1
    (tmp_path / "x.bin").write_bytes(bytes(data))
    with binary_records.reader(str(tmp_path / "x.bin")) as f, pytest.raises(ValueError, match="bad data"):
        list(binary_records.records(f))


def brute_fullest(items, room):
    best = {0}
    for x in items:
        best |= {b + x for b in best if b + x <= room}
    return max(best)


@pytest.mark.parametrize("seed", range(8))
def test_fullest_combination(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(1, 60), 8), reverse=True)
    counts = [rng.randint(1, 4) for _ in lengths]
    room = rng.randint(5, 120)
    got = packing.fullest(lengths, counts, room)
    assert all(k <= counts[lengths.index(n)] for n, k in got)
    assert sum(n * k for n, k in got) == brute_fullest([n for n, c in zip(lengths, counts, strict=True) for _ in range(c)], room)


def test_plan_uses_every_piece_once():
    rng = random.Random(1)
    histogram = {n: rng.randint(1, 50) for n in rng.sample(range(1, 2049), 300)}
    bins = packing.plan(histogram)
    used = {}
    for times, taken in bins:
        assert sum(n * k for n, k in taken) <= 2048
        for n, k in taken:
            used[n] = used.get(n, 0) + times * k
    assert used == histogram
    total = sum(n * c for n, c in histogram.items())
    assert sum(t for t, _ in bins) <= 1.03 * total / 2048 + 1


def test_packing_is_whole_and_gapless(spark):
    rows = [*odd_documents(), (None, "null id")]
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(frame(spark, rows), path, capacity=256, with_ids=True).collect()
    plain = Tokenizer.from_file(path)
    want = sorted(repr((i, k // 256, k, o)) for i, t in rows for ids in [plain.encode(t or "", add_special_tokens=False).ids + [0]] for k in range(0, len(ids), 256) for o in [ids[k : k + 256]])
    assert sorted(repr((r.doc_id, r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= sum(r.length for r in got) / 256 * 1.05 + 1
    assert packing.pack_documents(frame(spark, []), path).count() == 0


def test_records_of_nothing(spark, tmp_path):
    manifest = binary_records.write_records(frame(spark, []), str(tmp_path / "r"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    assert manifest.agg(F.sum("n_records")).first()[0] is None and binary_records.read_records(manifest).count() == 0


MARKED = [(1, "end <|endoftext|> next"), (2, "plain text"), (3, "a<|startoftext|>b\nc"), (4, "end <|ENDOFTEXT|> next"), (5, "<|endoftext|>")]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_have_their_ids(spark, tmp_path, name):
    path, byte_level = public_tokenizers.path(name), name.startswith("byte")
    default = Tokenizer.from_file(path)
    want = {i: [*default.encode(t, add_special_tokens=False).ids, 2] for i, t in MARKED}
    assert want[1] == ([437, 220, 50256, 1306, 2] if byte_level else [806, 49407, 1131, 2])
    if byte_level:
        rows = binary_records.read_records(binary_records.write_records(frame(spark, MARKED), str(tmp_path / "r"), path, end_id=2))
    else:
        rows = packing.pack_documents(frame(spark, MARKED), path, end_id=2, with_ids=True)
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows.collect()} == want


@pytest.mark.parametrize("length", ["", "x", "-3", "1e3", "９", "99999999999999999999", "7"])
def test_a_malformed_length_takes_the_whole_body(tmp_path, length):
    """Such a record is read as far as its member goes; the one after it is read too."""
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:row:1>\r\nContent-Length: {length}\r\n\r\n".encode()
    data = gzip.compress(head + b"payload\r\n\r\n") + warc.member("response", "2", "u", "d", b"next", 4)
    (tmp_path / "a.warc.gz").write_bytes(data)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "a.warc.gz")) as f:
        assert [c for _, _, c in warc.records_in(f, 0, f.size())] == [b"payload" if length == "7" else b"payload\r\n\r\n", b"next"]
