"""Sharded tables that grow by small arrivals, with size-tiered compaction.

An arrival adds small immutable Parquet shards. Compaction merges shards of one size tier
(powers of fan_in) into files of about the target size, never over it by more than a shard,
and leaves tiers of fewer than fan_in shards alone, so a row is rewritten once for each tier
at most. A table's state is a manifest, a list of shards under a version number; a new one
appears by a rename that fails if that version exists. Whoever loses that race, appending or
compacting, commits again on what the winner left. Readers of a version are never disturbed:
its shards stay until `expire` lets its manifest go.

Rows only move by Spark's reads, shuffles and writes; the driver sees names and sizes, about
200 bytes a shard: for a table of 100 TB choose a target of some GB.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch_path, setting, table

TARGET = 64 << 20
FAN_IN = 4
LEAST = 256 << 10
JOB_GROUPS = 64
"""Groups that one Spark job merges."""
UNION = "spark.sql.unionOutputPartitioning"
TRIES = 20
"""Commits that a writer tries while others write."""
DAY = 86_400.0
"""Seconds after which a file that no manifest names isn't one of a writer at work."""


@dataclass(frozen=True)
class Shard:
    path: str
    n_bytes: int


def tier(n_bytes: int, fan_in: int = FAN_IN, least: int = LEAST) -> int:
    return 0 if n_bytes <= least else 1 + int(math.log(n_bytes / least, fan_in))


def plan_merges(shards: list[Shard], target: int = TARGET, fan_in: int = FAN_IN, least: int = LEAST) -> list[list[Shard]]:
    """Groups of at least two shards of one tier, each of about target bytes at most."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if s.n_bytes < target // 2:
            tiers.setdefault(tier(s.n_bytes, fan_in, least), []).append(s)
    groups = []
    for level in sorted(tiers):
        own = sorted(tiers[level], key=lambda s: (s.n_bytes, s.path))
        if len(own) < fan_in:
            continue
        group: list[Shard] = []
        total = 0
        for s in own:
            if group and total + s.n_bytes > target:
                groups.append(group)
                group, total = [], 0
            group.append(s)
            total += s.n_bytes
        groups.append(group)
    return [g for g in groups if len(g) > 1]


class ShardTable:
    """A sharded table below a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fan_in: int = FAN_IN, least: int = LEAST):
        self.spark, self.root, self.target, self.fan_in, self.least = spark, root, target, fan_in, least
        self.jvm = spark._jvm
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _listed(self, folder: str):
        path = self._path(folder)
        return list(self.fs.listStatus(path)) if self.fs.exists(path) else []

    def version(self) -> int:
        """The latest version; 0 for a table with no manifest."""
        names = [s.getPath().getName() for s in self._listed(f"{self.root}/manifests")]
        return max([int(n[1:-5]) for n in names if n.endswith(".json") and n.startswith("v")], default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        return [Shard(**json.loads(x)) for x in self._text(f"{self.root}/manifests/v{version:010d}.json").splitlines()]

    def _create(self, name: str, text: str) -> None:
        """A file that appears whole by a rename; an error if there is one of that name."""
        draft = self._path(f"{self.root}/.{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.mkdirs(self._path(name).getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(self._path(name)), options)
        except Exception:
            self.fs.delete(draft, False)
            raise

    def _text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, shards: list[Shard], base: int) -> int:
        """Makes shards the state after version base; an error if another writer was first."""
        self._create(f"{self.root}/manifests/v{base + 1:010d}.json", "".join(json.dumps(asdict(s)) + "\n" for s in shards))
        return base + 1

    def add(self, shards: list[Shard], gone: frozenset[str] = frozenset()) -> int | None:
        """Commits the latest state with shards in place of those gone; after a lost race, on what the winner left.

        None, and nothing committed, where the latest state has not all that should go: another writer merged them.
        """
        own, seen = {s.path for s in shards}, self.version()
        for attempt in range(TRIES):
            base = self.version()
            for v in range(seen + 1, base + 1):  # a commit whose answer was lost may have come through
                if own and own <= {s.path for s in self.shards(v)}:
                    return v
            seen, now = base, self.shards(base)
            if not gone <= {s.path for s in now}:
                return None
            try:
                return self.commit([s for s in now if s.path not in gone] + shards, base)
            except Exception:
                if attempt + 1 == TRIES or self.version() == base:
                    raise
        raise AssertionError

    def schema(self) -> T.StructType:
        """That of the table's first arrival."""
        return T.StructType.fromJson(json.loads(self._text(f"{self.root}/schema.json")))

    def _written(self, folder: str) -> list[Shard]:
        found, todo = [], [folder]
        while todo:
            for s in self._listed(todo.pop()):
                if s.isDirectory():
                    todo.append(s.getPath().toString())
                elif s.getPath().getName().endswith(".parquet"):
                    found.append(Shard(s.getPath().toString(), s.getLen()))
        return sorted(found, key=lambda s: s.path)

    def append(self, arrivals: DataFrame, by: str | None = None) -> int:
        """Adds rows as new shards; with by, one version for each value of that column, in its order.

        The column isn't stored. No rows add a version with no new shard. The first arrival's schema
        is that of the table: columns that a later one lacks are null there, a column that the table lacks
        or has of another type is an error. Returns the latest version.
        """
        own, name = T.StructType([f for f in arrivals.schema.fields if f.name != by]), f"{self.root}/schema.json"
        if not self.fs.exists(self._path(name)):
            try:
                self._create(name, own.json())
            except Exception:
                if not self.fs.exists(self._path(name)):  # else another first arrival was faster
                    raise
        known = {f.name: f.dataType.simpleString() for f in self.schema().fields}
        odd = [f.name for f in own.fields if known.get(f.name) != f.dataType.simpleString()]
        if odd:
            raise ValueError(f"columns that the table has not, or not of this type: {', '.join(odd)}")
        folder = f"{self.root}/data/arrival-{uuid.uuid4().hex}"
        writer = arrivals.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(folder)
        parts: dict[str, list[Shard]] = {}
        for s in self._written(folder):
            parts.setdefault(s.path.rsplit("/", 1)[0], []).append(s)
        for name in sorted(parts, key=lambda n: (len(n), n)) or [""]:
            self.add(parts.get(name, []))
        return self.version()

    def compact(self, order: str) -> int:
        """Merges until no tier has fan_in shards; rows of a merged shard are sorted by order.

        A merge is kept if others only appended meanwhile. If another writer merged some of the same shards, its
        files are deleted and what is left is planned anew. Those of a merge that fails are deleted too; where only
        the commit fails, and may yet have come through, they stay until `expire`.
        """
        while True:
            now = self.shards()
            groups = plan_merges(now, self.target, self.fan_in, self.least)
            if not groups:
                return self.version()
            folder = f"{self.root}/data/merged-{uuid.uuid4().hex}"
            try:
                for k in range(0, len(groups), JOB_GROUPS):
                    # a task a group: no shuffle, and no task reads more than the target
                    parts = [self._read(g).coalesce(1) for g in groups[k : k + JOB_GROUPS]]
                    merged = parts[0]
                    for p in parts[1:]:
                        merged = merged.unionByName(p)
                    with setting(self.spark, UNION, "false"):  # else the groups' single partitions become one
                        merged.sortWithinPartitions(order).write.mode("append").option("compression", "zstd").parquet(folder)
            except Exception:
                self.fs.delete(self._path(folder), True)
                raise
            if self.add(self._written(folder), frozenset(s.path for g in groups for s in g)) is None:
                self.fs.delete(self._path(folder), True)

    def expire(self, versions: int = 1, age: float = DAY) -> int:
        """Deletes all but the last versions, and what no version left names; returns the number of shards deleted.

        Manifests and files younger than age seconds stay: a writer may build on the one and not have committed
        the other. An age of 0 only where none writes.
        """
        before = (time.time() - age) * 1000
        manifests = sorted(self._listed(f"{self.root}/manifests"), key=lambda s: s.getPath().getName())
        for m in manifests[:-versions]:
            if m.getModificationTime() <= before:
                self.fs.delete(m.getPath(), False)
        if not manifests:
            return 0
        stay = {s.path for m in self._listed(f"{self.root}/manifests") for s in self.shards(int(m.getPath().getName()[1:-5]))}
        for s in self._listed(self.root):
            if s.isFile() and s.getPath().getName().startswith(".") and s.getModificationTime() <= before:
                self.fs.delete(s.getPath(), False)  # a draft that its writer left
        n = 0
        for s in self._written(f"{self.root}/data"):
            path = self._path(s.path)
            if s.path not in stay and self.fs.getFileStatus(path).getModificationTime() <= before:
                n += self.fs.delete(path, False)
        return n

    def _read(self, shards: list[Shard]) -> DataFrame:
        return self.spark.read.schema(self.schema()).parquet(*[s.path for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default; none for a table with no shards."""
        shards = self.shards(version)
        return self._read(shards) if shards else self.spark.createDataFrame([], self.schema())


def shard_documents(docs: DataFrame, root: str, arrivals: int = 8, order: str = "doc_id", **sizes) -> ShardTable:
    """A compacted table of docs that came in `arrivals` batches, dealt by a hash of order.

    All columns are kept as they are; nulls, null ids, empty and very long texts and repeated rows too.
    An empty table gives a table with a manifest and no rows. A column named _arrival is an error.
    """
    store = ShardTable(docs.sparkSession, root, **sizes)
    if "_arrival" in docs.columns:
        raise ValueError("_arrival is a name of this operator")
    store.append(docs.withColumn("_arrival", F.pmod(F.xxhash64(order), F.lit(arrivals)).cast("int")), "_arrival")
    store.compact(order)
    return store


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from the compacted shards: where it lies, and a digest of its text."""
    docs = table(spark, sf_dir, "documents")
    store = shard_documents(docs, scratch_path(spark, "shards"))
    store.expire(age=0)
    if not store.shards():
        return docs.select("doc_id", F.lit("").alias("shard"), F.lit(0).cast("long").alias("row"), F.lit(0).alias("version"), F.lit(0).cast("long").alias("n_bytes"), F.lit("").alias("text_sha256")).limit(0)
    back = store.read()
    return back.select("doc_id", F.regexp_extract("_metadata.file_name", "^(.*)$", 1).alias("shard"), F.col("_metadata.row_index").alias("row"), F.lit(store.version()).alias("version"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
