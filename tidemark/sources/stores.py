"""Table sinks and sources: content-addressed artifacts, partitioned publication, idempotent appends."""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commits import Files
from .scratch import discard, written


def _row_hash(columns: list[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in columns]).cast("decimal(38,0)")


def _id_of(schema: T.StructType, n: int, total: object) -> str:
    """An id from the schema and an order-insensitive digest of the rows."""
    described = "|".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(schema.fields, key=lambda f: f.name))
    return f"artifact_{hashlib.sha256(f'{described}|{n}|{total or 0}'.encode()).hexdigest()[:40]}"


def _observed(seen: Observation) -> dict:
    """What was observed in a write that has ended; nothing where Spark saw beforehand that there are no rows."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def artifact_id(df: DataFrame) -> str:
    """The id that a table is published under."""
    r = df.agg(F.count("*").alias("n"), F.sum(_row_hash(sorted(df.columns))).alias("total")).first()
    return _id_of(df.schema, r.n, r.total)


def publish(df: DataFrame, root: str, partition: str | None = None) -> str:
    """Writes zstd Parquet, by partition if asked, and returns the path of its manifest, named by its content.

    The digest is taken while the rows are written, so df is computed once. The table appears when its manifest
    does, a small file that is put only if there is none of that name: no data is renamed, and of publishers of one
    content the first wins and the others drop what they wrote. What a name stands for never changes.
    """
    spark, files = df.sparkSession, Files(df.sparkSession, root)
    seen, folder = Observation(), f"data/{uuid.uuid4().hex}"
    watched = df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(_row_hash(sorted(df.columns))).alias("total"))
    writer = watched.write.option("compression", "zstd")
    (writer.partitionBy(partition) if partition else writer).parquet(f"{files.root}/{folder}")
    found = _observed(seen)
    name = _id_of(df.schema, found.get("n", 0), found.get("total"))
    manifest = {"folder": folder, "rows": found.get("n", 0), "schema": json.loads(df.schema.json())}
    if not files.put_if_absent(f"{name}.json", json.dumps(manifest)):
        files.remove(folder)
        _verified(read_published(spark, f"{files.root}/{name}.json"), name)
    return f"{files.root}/{name}.json"


def _verified(df: DataFrame, name: str) -> DataFrame:
    if artifact_id(df) != name:
        raise ValueError(f"content differs from {name}")
    return df


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The table of a manifest, with the schema that it was published with."""
    root, name = path.rsplit("/", 1)
    manifest = json.loads(Files(spark, root).text(name))
    schema = T.StructType.fromJson(manifest["schema"])
    return spark.read.schema(schema).parquet(f"{root}/{manifest['folder']}").select(schema.names)


def read_verified(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> DataFrame:
    """A published table; an error if its schema differs, its content isn't what its id says, or a required
    field has nulls."""
    df = read_published(spark, path)
    have = [(f.name, f.dataType) for f in df.schema.fields]
    if have != [(f.name, f.dataType) for f in schema.fields]:
        raise ValueError(f"schema differs: {df.schema.simpleString()}")
    _verified(df, path.rsplit("/", 1)[1].removesuffix(".json"))
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required]).first() if required else ()
    if any(nulls):
        raise ValueError(f"nulls in required fields: {nulls}")
    return df


BUCKETS = 64
BITS_A_KEY = 24
PROBES = 5
"""Bits that a key sets: with BITS_A_KEY a key that isn't there passes about once in 4,000."""
CROWDED = 16_000
"""Rows asked of a bucket from which on its filters aren't asked: of so many some key passes any filter."""


class Append(NamedTuple):
    """One committed append: a folder of data by bucket, and one of its index."""

    name: str
    words: int
    """64-bit words of the Bloom filter of each bucket."""


class KeyedTable:
    """A table to which rows of unseen keys are appended, once whatever is sent again.

    Rows lie in buckets of a hash of their key. Beside each append there is an index: the least and greatest key
    of each bucket and a Bloom filter, as rows of 64-bit words. New keys meet the index, and only files that may
    hold one of them are read. An append is a numbered commit that fails if another came first; then it looks at the
    new commits too and tries again, so of two writers of one key one leaves it. A null key is a key like others.
    """

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.files, self.key = spark, Files(spark, root), key

    def appends(self) -> list[Append]:
        return [Append(**json.loads(self.files.text(f"log/{n}"))) for n in self.files.names("log")]

    def read(self, schema: T.StructType | None = None) -> DataFrame:
        """All rows. An empty table has the schema that is given."""
        return self._data([f"data/_append={a.name}" for a in self.appends()], schema)

    def _data(self, folders: list[str], schema: T.StructType | None = None) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        rows = reader.option("mergeSchema", schema is None).option("basePath", f"{self.files.root}/data").parquet(*[f"{self.files.root}/{f}" for f in folders])
        return rows.drop("_append", "_bucket")

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with their bucket and two hashes of their key."""
        k = F.col(self.key)
        return rows.withColumn("_h", F.xxhash64(k)).withColumn("_g", F.xxhash64(k, F.lit(29))).withColumn("_bucket", F.pmod("_h", F.lit(BUCKETS)).cast("int"))

    @staticmethod
    def _bits(words: Column) -> Column:
        """(word, mask) of each bit that a key sets in a filter of so many words."""
        places = [F.pmod(F.shiftrightunsigned("_h", 8) + F.col("_g") % F.lit(1 << 40) * i, words * 64) for i in range(PROBES)]
        return F.array(*[F.struct(F.shiftright(p, 6).alias("word"), (p % 64).cast("int").alias("bit")) for p in places])

    def may_hold(self, keys: DataFrame, appends: list[Append]) -> list[str]:
        """Folders of data (an append and bucket each) that may hold one of the keys: by their range, then by their filter."""
        if not appends:
            return []
        known = self.spark.createDataFrame(appends, "name string, words long")
        root = f"{self.files.root}/index"
        asked = self._placed(keys.select(self.key))
        ranges = self.spark.read.parquet(*[f"{root}/{a.name}/ranges" for a in appends])
        own = asked.groupBy("_bucket").agg(F.min(self.key).alias("_lo"), F.max(self.key).alias("_hi"), F.max(F.col(self.key).isNull()).alias("_null"), (F.count("*") >= CROWDED).alias("crowded"))
        near = ranges.join(own, ranges["bucket"] == own["_bucket"]).filter(((F.col("_lo") <= F.col("greatest")) & (F.col("_hi") >= F.col("least"))) | (F.col("_null") & F.col("has_null")))
        near = near.select("name", "bucket", "least", "greatest", "has_null", "crowded").join(known, "name")
        found = [r.asDict() for r in near.collect()]  # a row a file at most
        held = [f"data/_append={r['name']}/_bucket={r['bucket']}" for r in found if r["crowded"]]
        near = [{k: x for k, x in r.items() if k != "crowded"} for r in found if not r["crowded"]]
        if not near:
            return sorted(held)
        near_rows = self.spark.createDataFrame(near, ranges.select("name", "bucket", "least", "greatest", "has_null").schema.add("words", T.LongType()))
        k = F.col(self.key)
        tried = asked.distinct().join(near_rows, asked["_bucket"] == near_rows["bucket"]).filter(k.between(F.col("least"), F.col("greatest")) | (k.isNull() & F.col("has_null")))
        tried = tried.select("name", "bucket", "_h", F.explode(F.array_distinct(self._bits(F.col("words")))).alias("b")).select("name", "bucket", "_h", "b.*")
        blooms = self.spark.read.parquet(*[f"{root}/{n}/bloom" for n in sorted({r["name"] for r in near})])
        lit = F.expr("shiftright(bits, bit) & 1") == 1
        passed = tried.join(blooms, ["name", "bucket", "word"], "left").groupBy("name", "bucket", "_h").agg(F.bool_and(F.coalesce(lit, F.lit(False))).alias("hit")).filter("hit")
        return sorted(held + [f"data/_append={r.name}/_bucket={r.bucket}" for r in passed.select(F.col("name"), "bucket").distinct().collect()])  # a row a file at most

    def _index(self, name: str, rows: DataFrame, words: int) -> None:
        placed = self._placed(rows.select(self.key))
        folder = f"{self.files.root}/index/{name}"
        ranges = placed.groupBy(F.col("_bucket").alias("bucket")).agg(F.min(self.key).alias("least"), F.max(self.key).alias("greatest"), F.max(F.col(self.key).isNull()).alias("has_null"))
        ranges.select(F.lit(name).alias("name"), "*").coalesce(1).write.parquet(f"{folder}/ranges")
        bits = placed.select(F.col("_bucket").alias("bucket"), F.explode(self._bits(F.lit(words))).alias("b")).groupBy("bucket", "b.word").agg(F.bit_or(F.expr("shiftleft(1L, b.bit)")).alias("bits"))
        bits.select(F.lit(name).alias("name"), "*").write.parquet(f"{folder}/bloom")

    def append(self, new: DataFrame) -> int:
        """Appends one row for each key that the table doesn't hold; returns how many."""
        rows = written(new.dropDuplicates([self.key]), "arrivals")
        try:
            return self._append(rows, new.schema)
        finally:
            discard(rows)

    def _append(self, rows: DataFrame, schema: T.StructType) -> int:
        while True:
            before = self.appends()
            held = self.may_hold(rows, before)
            fresh = rows
            if held:
                old = self._data(held).select(F.col(self.key).alias("_k"))
                fresh = rows.join(old, F.col(self.key).eqNullSafe(F.col("_k")), "left_anti")
            name, seen = uuid.uuid4().hex, Observation()
            placed = self._placed(fresh).drop("_h", "_g").observe(seen, F.count(F.lit(1)).alias("n"))
            placed.repartition("_bucket").write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.files.root}/data/_append={name}")
            n = _observed(seen).get("n", 0)
            if not n:
                self.files.remove(f"data/_append={name}")
                return 0
            words = 1 << max(0, (-(-n * BITS_A_KEY // (64 * BUCKETS)) - 1).bit_length())
            self._index(name, self._data([f"data/_append={name}"], schema), words)
            if self.files.put_if_absent(f"log/{len(before) + 1:012d}.json", json.dumps(Append(name, words)._asdict())):
                return n
            self.files.remove(f"data/_append={name}", f"index/{name}")


def append_unseen(new: DataFrame, path: str, key: str) -> int:
    """Appends rows of keys that the stored table doesn't hold; returns how many."""
    return KeyedTable(new.sparkSession, path, key).append(new)
