"""Text jobs on documents and pages: disclosures, announcements, fixed rows, links."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def disclosures(documents: DataFrame, pattern: str, normalize: bool = True) -> DataFrame:
    """Of each document the one value that the pattern's group finds, or why there is none.

    Spark has no NFKC, so that step is a vectorised function; white space is dropped after it.
    """
    text = F.pandas_udf(_nfkc, "string")("text") if normalize else F.col("text")
    found = documents.select("doc_id", F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, r"\s+", ""), F.lit(pattern), F.lit(1))).alias("v"))
    n = F.coalesce(F.size("v"), F.lit(0))
    return found.select("doc_id", F.when(n == 1, F.col("v")[0]).alias("value"), F.when(n == 0, "MISSING").when(n > 1, "CONFLICTING").otherwise("FOUND").alias("state"))


def announcements(responses: DataFrame, require: str, reject: list[str]) -> DataFrame:
    """Of each query the latest announcement whose title, without markup, has a marker and no rejected one.

    responses: query and a JSON list of id, title and time.
    """
    items = responses.select("query", F.explode(F.from_json("body", "array<struct<id:bigint,title:string,time:bigint>>")).alias("a")).select("query", "a.*")
    items = items.withColumn("title", F.trim(F.regexp_replace("title", "<[^>]+>", "")))
    keep = F.contains("title", F.lit(require))
    for r in reject:
        keep = keep & ~F.contains("title", F.lit(r))
    return items.filter(keep).groupBy("query").agg(F.max_by(F.struct("id", "title"), F.struct("time", "id")).alias("a")).select("query", "a.*")


def neighbour_rows(pages: DataFrame, pattern: str) -> DataFrame:
    """Lines that match a pattern with the lines before and after, for texts where just one line does."""
    lines = pages.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    w = Window.partitionBy("doc_id").orderBy("n")
    rows = lines.withColumn("before", F.lag("line").over(w)).withColumn("after", F.lead("line").over(w)).filter(F.col("line").rlike(pattern))
    rows = rows.withColumn("matches", F.count("*").over(Window.partitionBy("doc_id"))).filter("matches = 1")
    return rows.select("doc_id", F.col("n").alias("line_no"), F.regexp_extract("line", pattern, 0).alias("found"), F.concat(F.trim(F.coalesce("before", F.lit(""))), F.lit("|"), F.trim(F.coalesce("after", F.lit("")))).alias("around"))


def links(pages: DataFrame, pattern: str = '<a href="([^"]*)">') -> DataFrame:
    """The anchors of each page in order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("n", "href"))
