"""Snapshots, lineage and quality evidence: landing, replay, progress, coverage, set checks.

Checks return the rows that are wrong, so that a missing key is an answer, not a dropped row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import numbered

VERSION = "^[0-9a-f]{40}$"


def row_digest(columns: list[str]) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def landed(rows: DataFrame, snapshot: str, order: str, payload: list[str]) -> DataFrame:
    """Rows with their place in the snapshot and a digest of the payload."""
    n = F.row_number().over(Window.partitionBy(snapshot).orderBy(order)) - 1
    return rows.withColumn("row_ordinal", n).withColumn("row_sha256", row_digest(payload))


def unseen(new: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows to append: one for each key that the target doesn't hold."""
    return new.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def fan_out(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A quality row and a lineage row for each event."""
    quality = events.select(F.col("event_id").alias("artifact_id"), F.lit("PASSED").alias("status"))
    lineage = events.select(F.col("event_id").alias("artifact_id"), F.col("source_id").alias("parent_id"))
    return quality, lineage


def replay_violations(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Snapshots that aren't accepted, or whose rows don't match the manifest or number 0 to n - 1."""
    g = rows.groupBy("snapshot_id").agg(F.count("*").alias("n"), F.min("row_ordinal").alias("lo"), F.max("row_ordinal").alias("hi"), F.count_distinct("row_ordinal").alias("places"))
    x = manifest.join(g, "snapshot_id", "full_outer")
    why = F.array_compact(F.array(F.when(F.col("status").isNull(), "NO_MANIFEST"), F.when(F.col("status") != "ACCEPTED", "NOT_ACCEPTED"), F.when(F.coalesce("n", F.lit(0)) != F.col("expected"), "ROW_COUNT"), F.when((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("places") != F.col("n")), "ORDINALS")))
    return x.select("snapshot_id", F.array_join(why, ",").alias("violations")).filter("violations <> ''")


def accepted(snapshots: DataFrame, endpoints: list[str], parameter: str, values: list[int]) -> DataFrame:
    """Accepted snapshots of some endpoints whose JSON parameter is one of the values."""
    p = F.get_json_object("params", f"$.{parameter}").cast("bigint")
    return snapshots.filter((F.col("status") == "ACCEPTED") & F.col("endpoint").isin(endpoints)).withColumn("parameter", p).filter(F.col("parameter").isin(values))


def typed_scan(rows: DataFrame, wanted: DataFrame, key: str, columns: list[str], symbols: list[int] | None = None) -> DataFrame:
    """Chosen columns of the rows of a set of keys; the symbol filter reaches the scan."""
    if symbols is not None:
        rows = rows.filter(F.col("symbol").isin(symbols))
    return rows.join(wanted.select(key).distinct(), key, "left_semi").select(columns)


def open_calendar(days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open days, and days with conflicting flags."""
    g = days.groupBy("day").agg(F.min("is_open").alias("lo"), F.max("is_open").alias("hi"))
    return g.filter("lo = hi and hi = 1").select("day"), g.filter("lo <> hi").select("day")


def outside(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't on the frozen list."""
    return rows.join(allowed.select(key).distinct(), key, "left_anti")


def portable_hash(columns: list[str]) -> Column:
    """A number from SHA-256 of a row's columns as text; other engines can compute it too."""
    return F.conv(F.substring(row_digest(columns), 1, 15), 16, 10)


def table_digest(df: DataFrame, row_hash: Column | None = None) -> DataFrame:
    """Rows and an order-insensitive digest of a table, from the sum of its rows' hashes."""
    h = F.xxhash64(*[F.col(c) for c in df.columns]) if row_hash is None else row_hash
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", F.sum(h.cast("decimal(38,0)")).cast("string"), F.count("*").cast("string")), 256).alias("digest"))


def key_digest(df: DataFrame, by: str, key: str, size: int = 10_000) -> DataFrame:
    """Number and digest of the distinct numeric keys of each group: the digest of the digests of its
    sorted keys in chunks of `size`. No group is gathered; what meets in one row is 65 bytes a chunk."""
    keys = numbered(df.select(by, key).distinct(), [by], [key])
    chunks = keys.groupBy(by, F.floor(F.col("n") / size).alias("chunk")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(key)).cast("array<string>"), "|"), 256).alias("d"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "d"))), lambda x: x["d"]), "|")
    return chunks.groupBy(by).agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("digest"))


def missing_required(df: DataFrame, required: list[str]) -> DataFrame:
    """Nulls in required fields, by field, in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return one.unpivot([], required, "field", "nulls")


def completed_days(snapshots: DataFrame, lineage: DataFrame, quality: DataFrame, endpoints: int) -> DataFrame:
    """Days on which all endpoints have an accepted snapshot with lineage and passed quality."""
    rows = snapshots.filter("status = 'ACCEPTED'").join(lineage, "snapshot_id").join(quality.filter("passed"), "artifact_id")
    return rows.groupBy("day").agg(F.count_distinct("endpoint").alias("n")).filter(F.col("n") == endpoints).select("day")


def completed_keys(snapshots: DataFrame, lineage: DataFrame, quality: DataFrame, batches: DataFrame, key: str) -> DataFrame:
    """Keys with a chain from accepted snapshot to a passed batch."""
    rows = snapshots.filter("status = 'ACCEPTED'").join(lineage, "snapshot_id").join(batches, "artifact_id").join(quality.filter("passed"), "artifact_id")
    return rows.select(key).distinct()


def pending(days: DataFrame, done: DataFrame, most: int) -> DataFrame:
    """The first `most` days that aren't done."""
    return days.select("day").distinct().join(done, "day", "left_anti").orderBy("day").limit(most)


def backfill(batches: DataFrame, done: DataFrame, key: str, most: int) -> DataFrame:
    """The next `most` batches that aren't done, and whether there are more."""
    left = batches.select(key).distinct().join(done.select(key), key, "left_anti")
    some = left.orderBy(key).limit(most + 1).withColumn("n", F.row_number().over(Window.orderBy(key))).withColumn("has_more", F.max("n").over(Window.partitionBy()) > most)
    return some.filter(F.col("n") <= most).select(key, "has_more")


def month_grid(codes: DataFrame, start: str, end: str) -> DataFrame:
    """Each month clipped to [start, end], for each code."""
    s, e = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    m = codes.select("code", F.explode(F.sequence(F.trunc(s, "MM"), e, F.expr("interval 1 month"))).alias("m"))
    return m.select("code", F.greatest("m", s).alias("first"), F.least(F.last_day("m"), e).alias("last"))


def day_year_grid(codes: DataFrame, start: str, end: str) -> DataFrame:
    """A row a year, clipped, with its number of days, for each code."""
    s, e = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    d = codes.select("code", F.explode(F.sequence(s, e)).alias("day"))
    return d.groupBy("code", F.year("day").alias("year")).agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days"))


def audit(artifacts: DataFrame, snapshots: DataFrame, lineage: DataFrame, quality: DataFrame) -> DataFrame:
    """C14: blockers of each artifact over its evidence."""
    rows = artifacts.join(lineage, "artifact_id", "left").join(snapshots.select("snapshot_id", "status"), "snapshot_id", "left").join(quality, "artifact_id", "left")
    flags = F.array_compact(F.array(F.when(F.col("snapshot_id").isNull(), "NO_LINEAGE"), F.when(F.col("status") != "ACCEPTED", "SNAPSHOT_NOT_ACCEPTED"), F.when(F.col("passed").isNull(), "NO_QUALITY"), F.when(~F.col("passed"), "QUALITY_FAILED")))
    return rows.groupBy("artifact_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(flags)))), ",").alias("blockers"))


def governed(snapshots: DataFrame, lineage: DataFrame, quality: DataFrame) -> DataFrame:
    """Each snapshot's artifacts: how many have a versioned lineage, and how many of those passed."""
    rows = snapshots.join(lineage, "snapshot_id", "left").join(quality, "artifact_id", "left")
    versioned = F.col("code_version").rlike(VERSION)
    return rows.groupBy("snapshot_id").agg(F.count_if(versioned).alias("versioned"), F.count_if(versioned & F.col("passed")).alias("qualified"))


def chain_coverage(snapshots: DataFrame, lineage: DataFrame, quality: DataFrame) -> DataFrame:
    """The days that all endpoints cover by snapshots with a passed child: greatest first, least last."""
    fine = lineage.join(quality.filter("passed"), "artifact_id", "left_semi")
    g = snapshots.join(fine, "snapshot_id", "left_semi").groupBy("endpoint").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    return g.agg(F.max("lo").alias("first"), F.min("hi").alias("last"), F.count("*").alias("endpoints"))


def dated_coverage(days: DataFrame, endpoints: DataFrame, evidence: DataFrame) -> DataFrame:
    """For each day and endpoint the smallest qualified snapshot, or what failed.

    days x endpoints is a calendar times a short list.
    """
    grid = days.join(F.broadcast(endpoints))
    g = evidence.groupBy("day", "endpoint").agg(F.min(F.when(F.col("failure").isNull(), F.col("snapshot_id"))).alias("snapshot_id"), F.array_join(F.array_sort(F.collect_set("failure")), ",").alias("failures"))
    rows = grid.join(g, ["day", "endpoint"], "left")
    return rows.select("day", "endpoint", "snapshot_id", F.when(F.col("snapshot_id").isNotNull(), "").otherwise(F.coalesce("failures", F.lit("MISSING"))).alias("failures"))


def qualification(sources: DataFrame) -> DataFrame:
    """Common interval of the sources of each dataset, sorted blockers, and the status."""
    g = sources.groupBy("dataset").agg(F.max("start").alias("start"), F.min("end").alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("blockers")))).alias("b"))
    b = F.when(F.col("start") > F.col("end"), F.array_append("b", F.lit("NO_COMMON_INTERVAL"))).otherwise(F.col("b"))
    return g.select("dataset", "start", "end", F.array_join(b, ",").alias("blockers"), F.when(F.size(b) == 0, "QUALIFIED").otherwise("BLOCKED").alias("status"))


def date_bounds(rows: DataFrame, clock: str, by: str) -> DataFrame:
    """D25."""
    return rows.groupBy(by).agg(F.min(clock).alias("first"), F.max(clock).alias("last"))


def industry_batches(rows: DataFrame, most: int) -> DataFrame:
    """A batch has one code and less than `most` rows."""
    return rows.groupBy("batch").agg(F.count_distinct("code").alias("codes"), F.count("*").alias("n")).filter((F.col("codes") > 1) | (F.col("n") >= most))


def taxonomy_codes(rows: DataFrame, source: str) -> DataFrame:
    """Distinct codes of one source."""
    return rows.filter(F.col("source") == source).select("code").distinct()


def preferred_listing(events: DataFrame) -> DataFrame:
    """Of each symbol the events of the better kind; their dates must agree."""
    p = F.when(F.col("kind") == "LISTED", 0).otherwise(1)
    best = events.withColumn("p", p).withColumn("m", F.min("p").over(Window.partitionBy("symbol"))).filter("p = m")
    return best.groupBy("symbol").agg(F.min("day").alias("day"), F.max("kind").alias("kind"), (F.count_distinct("day") == 1).alias("agrees"))


def consistency(observations: DataFrame, least: int = 3) -> DataFrame:
    """How stable repeated observations of a query are."""
    g = observations.groupBy("query").agg(F.count("*").alias("n"), F.count_distinct("outcome").alias("outcomes"), F.count_distinct("document").alias("documents"), F.max("outcome").alias("one"))
    return g.select("query", F.when(F.col("n") < least, "INSUFFICIENT").when((F.col("outcomes") > 1) | (F.col("documents") > 1), "UNSTABLE").when(F.col("one") == "FOUND", "STABLE_FOUND").otherwise("STABLE_EMPTY").alias("state"))


def admission_report(selected: DataFrame, admitted: DataFrame) -> DataFrame:
    """Symbols missing, unexpected, admitted more than once or under differing codes."""
    a = admitted.groupBy("symbol").agg(F.count("*").alias("n"), F.count_distinct("code").alias("codes"))
    rows = selected.select("symbol", F.lit(True).alias("s")).distinct().join(a, "symbol", "full_outer")
    why = F.when(F.col("n").isNull(), "MISSING").when(F.col("s").isNull(), "UNEXPECTED").when(F.col("codes") > 1, "CONFLICTING").when(F.col("n") > 1, "DUPLICATE").otherwise("ADMITTED")
    return rows.select("symbol", why.alias("state"))


def period_grid(found: DataFrame, first: int, last: int, parts: int, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Every (year, part), of each `by` that occurs: found, found twice, or missing."""
    spark = found.sparkSession
    grid = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"), F.explode(F.sequence(F.lit(1), F.lit(parts))).alias("part"))
    if by:
        grid = found.select(*by).distinct().join(F.broadcast(grid))
    key = [*by, "year", "part"]
    rows = grid.join(found.groupBy(*key).agg(F.count("*").alias("n")), key, "left")
    return rows.select(*key, F.when(F.col("n").isNull(), "MISSING").when(F.col("n") > 1, "DUPLICATE").otherwise("FOUND").alias("state"))


def discovery_counts(planned: DataFrame, observed: DataFrame) -> DataFrame:
    """Of each shard the planned, observed and missing keys."""
    rows = planned.join(observed.select("key", F.lit(True).alias("seen")).distinct(), "key", "left")
    return rows.groupBy("shard").agg(F.count("*").alias("planned"), F.count("seen").alias("observed"), F.count_if(F.col("seen").isNull()).alias("missing"))


def bar_violations(bars: DataFrame) -> DataFrame:
    """Bars out of order or shape: not positive or finite, high below low, open outside, limits reversed."""
    p = [F.col(c) for c in ("open", "high", "low", "close")]
    positive = F.lit(True)
    for c in p:
        positive = positive & c.isNotNull() & ~F.isnan(c) & (c > 0)
    shape = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high"))
    after = F.lead("idx").over(Window.partitionBy("symbol").orderBy("idx"))
    why = F.array_compact(F.array(F.when(~positive, "PRICE"), F.when(~shape, "GEOMETRY"), F.when(F.col("volume") < 0, "VOLUME"), F.when(F.col("limit_up") < F.col("limit_down"), "LIMITS"), F.when(after == F.col("idx"), "DUPLICATE"), F.when(F.col("available") > after * 28, "LATE")))
    return bars.select("symbol", "idx", F.array_join(why, ",").alias("violations")).filter("violations <> ''")


def input_violations(sessions: DataFrame, bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Repeated sessions, repeated bars, and signals on days that are no session."""
    a = sessions.groupBy("idx").count().filter("count > 1").select(F.lit("SESSION").alias("what"), F.col("idx"))
    b = bars.groupBy("symbol", "idx").count().filter("count > 1").select(F.lit("BAR").alias("what"), F.col("idx"))
    c = signals.select("idx").distinct().join(sessions, "idx", "left_anti").select(F.lit("SIGNAL").alias("what"), F.col("idx"))
    return a.unionByName(b).unionByName(c)


def close_to(stored: DataFrame, full: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """Stored keys that the full table lacks or whose values differ."""
    rows = stored.select(*key, F.col(value).alias("a")).join(full.select(*key, F.col(value).alias("b"), F.lit(True).alias("known")), key, "left")
    return rows.select(*key, F.when(F.col("known").isNull(), "UNKNOWN_KEY").when(F.abs(F.col("a") - F.col("b")) > tolerance, "DIFFERS").alias("violation")).filter("violation is not null")


def union_checked(a: DataFrame, b: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The union and the keys that both hold."""
    u = a.unionByName(b)
    return u, u.groupBy(*key).count().filter("count > 1").drop("count")


def key_difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys that one side lacks."""
    x, y = a.select(*key).distinct(), b.select(*key).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("LEFT_ONLY")).unionByName(y.exceptAll(x).withColumn("side", F.lit("RIGHT_ONLY")))


def shared_lineage(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Lineage ids of both features and labels; should be none."""
    return features.select(key).intersect(labels.select(key))


def by_quarter(rows: DataFrame, date: str) -> DataFrame:
    """Rows with their quarter, as a partition column for a writer."""
    return rows.withColumn("quarter", F.trunc(date, "quarter"))


def one_schema(shapes: dict[str, DataFrame]) -> DataFrame:
    """Sources of different shapes as one table with the kind of source."""
    out = None
    for kind, df in shapes.items():
        df = df.withColumn("source_kind", F.lit(kind))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
