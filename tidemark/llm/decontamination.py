"""Benchmark decontamination: short test items inside long documents.

Method: size-partitioned MinHash containment search. A signature of a whole document
can't find an item of 40 shingles in one of 4,000 (their Jaccard similarity is 0.01), so
the signature is the item's: the least hash of an item's shingles lies in a document with
a chance equal to the item's containment there. Items are partitioned by size, in powers of
two, and each partition takes the k least shingles of its items as probes, k one more than
the most shingles that an item of that partition may lack. An item contained to the asked
share therefore has at least one probe in the document: no recall is lost, whatever the
document's length. All shingles of all documents are held against the probes. The documents
hit are then verified by exact containment of the shingles' texts.

Everything is DataFrame expressions: one scan with generated code, hash joins and sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep, table

BROADCAST_BYTES = 48 << 20
"""Tables of at most so many bytes, counted, are broadcast; larger ones are joined by a shuffle."""
_SPACE = " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    trimmed = F.btrim(F.lower(text), F.lit(_SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def _shingles(rows: DataFrame, size: int) -> DataFrame:
    """Adds i, the start of each run of size words; rows with fewer words go."""
    starts = F.when(F.size("words") >= size, F.sequence(F.lit(0), F.size("words") - size))
    return rows.select("*", F.explode_outer(starts).alias("i")).filter("i is not null")


def _hash(size: int) -> Column:
    return F.xxhash64(*[F.col("words")[F.col("i") + k] for k in range(size)])


def _text(size: int) -> Column:
    return F.concat_ws(" ", *[F.col("words")[F.col("i") + k] for k in range(size)])


def _small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if its rows and texts, counted, are small. df is a written table."""
    texts = [F.coalesce(F.octet_length(n), F.lit(0)) for n, t in df.dtypes if t == "string"]
    size = F.lit(16 * len(df.columns) + 32)
    for t in texts:
        size = size + t
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df


def contaminations(docs: DataFrame, items: DataFrame, size: int = 5, share: float = 0.8, doc_id: str = "doc_id", item_id: str = "item_id", doc_text: str = "text", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_common): pairs in which the document has at least `share`
    of the item's distinct shingles of size words. Case is ignored.

    An item of fewer words is one shingle, its whole sequence; empty and null items, empty and
    null documents and null ids are in no pair. Rows of one id count as one document or item,
    their shingles pooled. Extra columns are ignored.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    own = items.select(items[item_id].alias("item_id"), _words(items[item_text]).alias("words")).filter("item_id is not null and size(words) > 0")
    parts = []
    for k in range(1, size + 1):
        those = own.filter(F.size("words") == k) if k < size else own.filter(F.size("words") >= size)
        parts.append(_shingles(those, k).select("item_id", F.lit(k).alias("k"), _hash(k).alias("h"), _text(k).alias("shingle")))
    shingles = parts[0]
    for p in parts[1:]:
        shingles = shingles.unionByName(p)
    shingles = shingles.distinct()
    by_item = Window.partitionBy("item_id")
    n = F.count("*").over(by_item)
    # 1e-9: 0.2 * 35 must not become 6.999
    lacking = F.floor((F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1) * F.lit(1 - share) + F.lit(1e-9))
    ranked = shingles.withColumn("n", n).withColumn("rank", F.row_number().over(by_item.orderBy(F.xxhash64("h", F.lit(97)), "shingle"))).withColumn("probe", F.col("rank") <= lacking + 1)
    ranked = keep(ranked.drop("rank"), "item-shingles")
    sizes = [r[0] for r in ranked.select("k").distinct().collect()]  # at most `size` numbers

    words = docs.select(docs[doc_id].alias("doc_id"), _words(docs[doc_text]).alias("words")).filter("doc_id is not null")
    probes = _small(keep(ranked.filter("probe").select("k", "h").distinct(), "probes"))
    hits = None
    for k in sizes:
        found = _shingles(words, k).select("doc_id", _hash(k).alias("h")).join(probes.filter(F.col("k") == k).select("h"), "h", "left_semi").select("doc_id").distinct()
        hits = found if hits is None else hits.unionByName(found)
    empty = "doc_id long, item_id long, n_item long, n_common long"
    if hits is None:
        return docs.sparkSession.createDataFrame([], empty)
    hits = _small(keep(hits.distinct(), "hit-documents"))
    exact = _small(ranked.select("k", "shingle", "item_id", "n"))
    common = None
    for k in sizes:
        own = _shingles(words.join(hits, "doc_id", "left_semi"), k).select("doc_id", _text(k).alias("shingle"))
        found = own.join(exact.filter(F.col("k") == k).drop("k"), "shingle").groupBy("doc_id", "item_id", "n", "shingle").agg(F.lit(1).alias("one"))
        common = found if common is None else common.unionByName(found)
    pairs = common.groupBy("doc_id", "item_id").agg(F.max("n").alias("n_item"), F.count("*").alias("n_common"))
    return pairs.filter(F.col("n_common") >= F.col("n_item") * F.lit(share) - F.lit(1e-9))


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold none of the items. Rows with a null id stay."""
    key = options.get("doc_id", "doc_id")
    bad = _small(keep(contaminations(docs, items, **options).select(F.col("doc_id").alias(key)).distinct(), "contaminated"))
    return docs.join(bad, key, "left_anti").select(docs.columns)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which it has at least 80 % of the 5-word shingles."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS words FROM benchmark
), i AS (
  SELECT DISTINCT item_id, least(len(words), 5) AS k, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT item_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM b WHERE len(words) > 0)
), s AS (
  SELECT DISTINCT doc_id, k, array_to_string(words[i:i + k - 1], ' ') AS shingle
  FROM (SELECT doc_id, words, k, unnest(generate_series(1, len(words) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM i) WHERE len(words) >= k)
), n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
SELECT s.doc_id, i.item_id, max(n.n) AS n_item, count(*) AS n_common
FROM s JOIN i USING (k, shingle) JOIN n ON n.item_id = i.item_id
GROUP BY s.doc_id, i.item_id HAVING 10 * count(*) >= 8 * max(n.n)
"""
