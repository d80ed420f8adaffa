"""Queries of the evidence and coverage operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import evidence as E
from tidemark.operators import pit as P
from tidemark.operators.models import version_scan

from .registry import query
from .window_queries import rounded


@query("a01_landed_rows", "SELECT user_id AS snapshot_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS row_ordinal, sha256(event_type || '|' || props) AS row_sha256 FROM events")
def _(v):
    rows = v("events").withColumnRenamed("user_id", "snapshot_id")
    return E.landed(rows, "snapshot_id", "event_id", ["event_type", "props"]).select("snapshot_id", "event_id", "row_ordinal", "row_sha256")


@query("a02_unseen_rows", "SELECT DISTINCT event_id FROM events WHERE event_id % 3 > 0")
def _(v):
    e = v("events").select("event_id")
    return E.unseen(e.unionAll(e), e.filter("event_id % 3 = 0"), "event_id")


@query("a02_appended_keys", "SELECT event_id % 4 AS k, count(*) AS n, min(event_id) AS least, max(event_id) AS greatest FROM events GROUP BY 1")
def _(v):
    """Events arrive in three overlapping batches, the last twice; the table holds each once."""
    from tidemark.sources.scratch import scratch_root
    from tidemark.sources.stores import KeyedTable

    e = v("events").select("event_id", "event_type", "value")
    table = KeyedTable(e.sparkSession, f"{scratch_root(e.sparkSession)}/keyed-{uuid.uuid4().hex}", "event_id")
    for batch in ("event_id % 3 = 0", "event_id % 3 < 2", "event_id % 3 > 0", "event_id % 3 > 0"):
        table.append(e.filter(batch))
    return table.read(e.schema).groupBy((F.col("event_id") % 4).alias("k")).agg(F.count("*").alias("n"), F.min("event_id").alias("least"), F.max("event_id").alias("greatest"))


@query("a03_replay_keys", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def _(v):
    o = v("orders").select("o_orderkey")
    return E.unseen(o, v("orders").filter("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey")


@query("a04_evidence_fan_out", "SELECT event_id AS artifact_id, 'PASSED' AS status, user_id AS parent_id FROM events")
def _(v):
    q, line = E.fan_out(v("events").select("event_id", F.col("user_id").alias("source_id")))
    return q.join(line, "artifact_id")


@query("a05_replay_violations", "WITH r AS (SELECT user_id AS s, CASE WHEN user_id = 7 AND k = 3 THEN 2 ELSE k END AS k FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events) WHERE user_id <> 9), g AS (SELECT s, count(*) AS n, min(k) AS lo, max(k) AS hi, count(DISTINCT k) AS d FROM r GROUP BY s), m AS (SELECT user_id AS s, count(*) + CASE WHEN user_id % 31 = 0 THEN 1 ELSE 0 END AS e, CASE WHEN user_id % 29 = 0 THEN 'REJECTED' ELSE 'ACCEPTED' END AS st FROM events GROUP BY user_id), x AS (SELECT m.s AS snapshot_id, concat_ws(',', CASE WHEN st <> 'ACCEPTED' THEN 'NOT_ACCEPTED' END, CASE WHEN coalesce(n, 0) <> e THEN 'ROW_COUNT' END, CASE WHEN lo <> 0 OR hi <> n - 1 OR d <> n THEN 'ORDINALS' END) AS violations FROM m LEFT JOIN g ON m.s = g.s) SELECT * FROM x WHERE violations <> ''")
def _(v):
    e = v("events").withColumnRenamed("user_id", "snapshot_id")
    rows = E.landed(e, "snapshot_id", "event_id", ["props"]).filter("snapshot_id <> 9").withColumn("row_ordinal", F.when((F.col("snapshot_id") == 7) & (F.col("row_ordinal") == 3), 2).otherwise(F.col("row_ordinal")))
    m = e.groupBy("snapshot_id").agg((F.count("*") + F.when(F.col("snapshot_id") % 31 == 0, 1).otherwise(0)).alias("expected"), F.when(F.col("snapshot_id") % 29 == 0, "REJECTED").otherwise("ACCEPTED").alias("status"))
    return E.replay_violations(rows, m)


@query("a06_accepted_snapshots", "SELECT snapshot_id, endpoint, CAST(json_extract(params, '$.k') AS BIGINT) AS parameter FROM snapshot WHERE status = 'ACCEPTED' AND endpoint IN ('click', 'view') AND CAST(json_extract(params, '$.k') AS BIGINT) IN (3, 5, 8, 13)")
def _(v):
    return E.accepted(v("snapshot"), ["click", "view"], "k", [3, 5, 8, 13]).select("snapshot_id", "endpoint", "parameter")


@query("a07_typed_scan", "SELECT symbol, idx, volume FROM bar WHERE symbol IN (1, 2, 3) AND idx IN (SELECT idx FROM calendar WHERE idx % 4 = 0)")
def _(v):
    return E.typed_scan(v("bar"), v("calendar").filter("idx % 4 = 0"), "idx", ["symbol", "idx", "volume"], [1, 2, 3])


@query("a08_range_overlap_scan", "SELECT o_orderkey AS snapshot_id FROM orders WHERE o_orderkey % 500 <= 120 AND o_orderkey % 500 + 30 >= 100")
def _(v):
    k = F.col("o_orderkey")
    s = v("orders").select((k % 500).cast("int").alias("start"), (k % 500 + 30).cast("int").alias("end"), k.alias("snapshot_id"))
    return P.range_overlap(s, 100, 120).select("snapshot_id")


@query("a09_benchmark_opens", "SELECT idx, round(open, 8) AS open FROM benchmark_bar WHERE idx BETWEEN 10 AND 40")
def _(v):
    """Each session is recorded twice. Copies come of one computed row: a mean that is computed twice may differ in its last bit."""
    b = v("benchmark_bar").withColumn("id", F.explode(F.array(F.lit(0), F.lit(1))))
    return rounded(P.fold_replays(b, ["idx"], ["open"], "id").filter("idx between 10 and 40 and not conflict").select("idx", "open"), "open")


@query("a10_open_calendar", "SELECT day FROM (SELECT day, min(is_open) AS lo, max(is_open) AS hi FROM (SELECT CAST(l_shipdate AS DATE) AS day, CASE WHEN $day(l_shipdate) % 7 >= 5 THEN 0 WHEN $day(l_shipdate) % 29 = 0 AND l_linenumber = 1 THEN 0 ELSE 1 END AS is_open FROM lineitem) GROUP BY day) WHERE lo = hi AND hi = 1".replace("$day(l_shipdate)", "date_diff('day', DATE '1994-12-26', CAST(l_shipdate AS DATE))"))
def _(v):
    n = F.datediff("l_shipdate", F.lit("1994-12-26").cast("date"))
    is_open = F.when((n % 7 >= 5) | ((n % 29 == 0) & (F.col("l_linenumber") == 1)), 0).otherwise(1)
    return E.open_calendar(v("lineitem").select(F.to_date("l_shipdate").alias("day"), is_open.alias("is_open")))[0]


@query("a11_bound_calendar", "SELECT idx FROM calendar WHERE idx >= 80")
def _(v):
    return E.outside(v("calendar").select("idx"), v("calendar").filter("idx < 80"), "idx")


@query("a12_version_scan", "SELECT event_id, metric FROM financial_version WHERE available <= 800")
def _(v):
    return version_scan(v("financial_version"), 800).select("event_id", "metric")


_BAR_ROW = "concat_ws('|', symbol, idx, CAST(round(open * 1e6) AS BIGINT), CAST(round(close * 1e6) AS BIGINT), volume, amount)"


@query("a13_table_digest", f"SELECT count(*) AS rows, sha256(CAST(sum(CAST('0x' || substr(sha256({_BAR_ROW}), 1, 15) AS BIGINT)) AS VARCHAR) || '|' || count(*)) AS digest FROM bar")
def _(v):
    """Prices in millionths."""
    rows = v("bar").select("symbol", "idx", *[F.round(F.col(c) * 1e6).cast("bigint").alias(c) for c in ("open", "close")], "volume", "amount")
    return E.table_digest(rows, E.portable_hash(rows.columns))


@query("a13_content_digest")
def _(v):
    return E.table_digest(v("bar"))


@query("a14_missing_required", "SELECT 'previous_close' AS field, count(*) FILTER (previous_close IS NULL) AS nulls FROM bar UNION ALL SELECT 'close', count(*) FILTER (close IS NULL) FROM bar")
def _(v):
    return E.missing_required(v("bar"), ["previous_close", "close"])


@query("a16_completed_days", "SELECT CAST(day AS VARCHAR) AS day FROM snapshot s JOIN lineage l USING (snapshot_id) JOIN quality q ON q.artifact_id = l.artifact_id AND q.passed WHERE status = 'ACCEPTED' GROUP BY day HAVING count(DISTINCT endpoint) = 5")
def _(v):
    return E.completed_days(v("snapshot"), v("lineage"), v("quality"), 5).select(F.col("day").cast("string").alias("day"))


@query("a17_completed_keys", "SELECT DISTINCT user_id FROM snapshot s JOIN lineage l USING (snapshot_id) JOIN quality q ON q.artifact_id = l.artifact_id AND q.passed WHERE status = 'ACCEPTED'")
def _(v):
    return E.completed_keys(v("snapshot"), v("lineage"), v("quality"), v("lineage").select("artifact_id"), "user_id")


@query("a18_pending_days", "SELECT idx AS day FROM calendar WHERE idx % 3 > 0 ORDER BY idx LIMIT 12")
def _(v):
    c = v("calendar").select(F.col("idx").alias("day"))
    return E.pending(c, c.filter("day % 3 = 0"), 12)


@query("a19_backfill", "SELECT o_custkey, true AS has_more FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 2 = 1 ORDER BY 1 LIMIT 20)")
def _(v):
    return E.backfill(v("orders"), v("orders").filter("o_custkey % 2 = 0"), "o_custkey", 20)


@query("a20_month_grid", "SELECT code, CAST(greatest(m, DATE '2020-01-15') AS VARCHAR) AS first, CAST(least(last_day(m), DATE '2020-05-10') AS VARCHAR) AS last FROM (SELECT DISTINCT s_nationkey AS code FROM supplier), (SELECT CAST(unnest(generate_series(DATE '2020-01-01', DATE '2020-05-01', INTERVAL 1 MONTH)) AS DATE) AS m)")
def _(v):
    g = E.month_grid(v("supplier").select(F.col("s_nationkey").alias("code")).distinct(), "2020-01-15", "2020-05-10")
    return g.select("code", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"))


@query("a21_day_year_grid", "SELECT code, CAST(year(d) AS INTEGER) AS year, CAST(min(d) AS VARCHAR) AS first, CAST(max(d) AS VARCHAR) AS last, count(*) AS days FROM (SELECT DISTINCT s_nationkey AS code FROM supplier), (SELECT CAST(unnest(generate_series(DATE '2019-11-15', DATE '2021-02-10', INTERVAL 1 DAY)) AS DATE) AS d) GROUP BY 1, 2")
def _(v):
    g = E.day_year_grid(v("supplier").select(F.col("s_nationkey").alias("code")).distinct(), "2019-11-15", "2021-02-10")
    return g.withColumns({c: F.col(c).cast("string") for c in ("first", "last")})


_KEYS = "WITH r AS (SELECT {by}, floor((row_number() OVER (PARTITION BY {by} ORDER BY k) - 1) / 10000) AS c, k FROM (SELECT DISTINCT {by}, {key} AS k FROM {t})), d AS (SELECT {by}, c, count(*) AS n, sha256(string_agg(CAST(k AS VARCHAR), '|' ORDER BY k)) AS d FROM r GROUP BY 1, 2) SELECT {by}, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, '|' ORDER BY c)) AS digest FROM d GROUP BY 1"


@query("b37_key_digest", _KEYS.format(by="o_orderstatus", key="o_custkey", t="orders"))
def _(v):
    return E.key_digest(v("orders"), "o_orderstatus", "o_custkey")


@query("c13_close_to", "SELECT symbol, idx, CASE WHEN idx > 80 THEN 'UNKNOWN_KEY' ELSE 'DIFFERS' END AS violation FROM score WHERE idx > 80 OR symbol = 5")
def _(v):
    s = v("score")
    return E.close_to(s, s.filter("idx <= 80").withColumn("score", F.when(F.col("symbol") == 5, F.col("score") + 1e-6).otherwise(F.col("score"))), ["symbol", "idx"], "score", 1e-12)


_AUDIT = "a AS (SELECT event_id * 2 AS artifact_id FROM events WHERE event_id % 3 = 0), x AS (SELECT a.artifact_id, l.snapshot_id, s.status, q.passed FROM a LEFT JOIN lineage l USING (artifact_id) LEFT JOIN snapshot s ON s.snapshot_id = l.snapshot_id LEFT JOIN quality q ON q.artifact_id = a.artifact_id)"


@query("c14_audit", f"WITH {_AUDIT} SELECT artifact_id, concat_ws(',', CASE WHEN snapshot_id IS NULL THEN 'NO_LINEAGE' END, CASE WHEN passed IS NULL THEN 'NO_QUALITY' END, CASE WHEN NOT passed THEN 'QUALITY_FAILED' END, CASE WHEN status <> 'ACCEPTED' THEN 'SNAPSHOT_NOT_ACCEPTED' END) AS blockers FROM x")
def _(v):
    return E.audit(v("events").filter("event_id % 3 = 0").select((F.col("event_id") * 2).alias("artifact_id")), v("snapshot"), v("lineage"), v("quality"))


@query("c15_governed", "SELECT s.snapshot_id, count(*) FILTER (regexp_matches(code_version, '^[0-9a-f]{40}$')) AS versioned, count(*) FILTER (regexp_matches(code_version, '^[0-9a-f]{40}$') AND passed) AS qualified FROM snapshot s LEFT JOIN lineage l ON l.snapshot_id = s.snapshot_id LEFT JOIN quality q ON q.artifact_id = l.artifact_id GROUP BY 1")
def _(v):
    return E.governed(v("snapshot"), v("lineage"), v("quality"))


@query("c16_chain_coverage", "WITH f AS (SELECT l.snapshot_id FROM lineage l JOIN quality q ON q.artifact_id = l.artifact_id AND q.passed), g AS (SELECT endpoint, min(day) AS lo, max(day) AS hi FROM snapshot WHERE snapshot_id IN (SELECT snapshot_id FROM f) GROUP BY 1) SELECT CAST(max(lo) AS VARCHAR) AS first, CAST(min(hi) AS VARCHAR) AS last, count(*) AS endpoints FROM g")
def _(v):
    return E.chain_coverage(v("snapshot"), v("lineage"), v("quality")).withColumns({c: F.col(c).cast("string") for c in ("first", "last")})


@query("d22_dated_coverage", "WITH e AS (SELECT day, endpoint, snapshot_id, CASE WHEN status <> 'ACCEPTED' THEN 'NOT_ACCEPTED' WHEN snapshot_id % 97 > 2 THEN 'WRONG_SCHEMA' END AS failure FROM snapshot), g AS (SELECT day, endpoint, min(CASE WHEN failure IS NULL THEN snapshot_id END) AS snapshot_id, string_agg(DISTINCT failure, ',' ORDER BY failure) AS f FROM e GROUP BY 1, 2), k AS (SELECT * FROM (SELECT DISTINCT day FROM snapshot), (SELECT DISTINCT endpoint FROM snapshot UNION ALL SELECT 'other')) SELECT CAST(k.day AS VARCHAR) AS day, k.endpoint, g.snapshot_id, CASE WHEN g.snapshot_id IS NOT NULL THEN '' ELSE coalesce(f, 'MISSING') END AS failures FROM k LEFT JOIN g ON g.day = k.day AND g.endpoint = k.endpoint")
def _(v):
    s = v("snapshot")
    e = s.withColumn("failure", F.when(F.col("status") != "ACCEPTED", "NOT_ACCEPTED").when(F.col("snapshot_id") % 97 > 2, "WRONG_SCHEMA"))
    names = s.select("endpoint").distinct().unionByName(s.limit(1).select(F.lit("other").alias("endpoint")))
    return E.dated_coverage(s.select("day").distinct(), names, e).withColumn("day", F.col("day").cast("string"))


_SOURCES = "SELECT c_nationkey AS dataset, CAST(c_custkey % 50 AS INTEGER) AS s, CAST(c_custkey % 50 + 45 AS INTEGER) AS e, c_custkey % 41 = 0 AS b1, c_custkey % 43 = 0 AS b2 FROM customer"


@query("d23_qualification", f"WITH x AS ({_SOURCES}), g AS (SELECT dataset, max(s) AS start, min(e) AS e, bool_or(b1) AS b1, bool_or(b2) AS b2 FROM x GROUP BY 1) SELECT dataset, start, e AS end, concat_ws(',', CASE WHEN b1 THEN 'LINEAGE' END, CASE WHEN b2 THEN 'QUALITY' END, CASE WHEN start > e THEN 'NO_COMMON_INTERVAL' END) AS blockers, CASE WHEN b1 OR b2 OR start > e THEN 'BLOCKED' ELSE 'QUALIFIED' END AS status FROM g")
def _(v):
    k = F.col("c_custkey")
    s = v("customer").select(F.col("c_nationkey").alias("dataset"), (k % 50).cast("int").alias("start"), (k % 50 + 45).cast("int").alias("end"), F.array_compact(F.array(F.when(k % 41 == 0, "LINEAGE"), F.when(k % 43 == 0, "QUALITY"))).alias("blockers"))
    return E.qualification(s)


@query("d24_input_manifest", _KEYS.format(by="event_type", key="user_id", t="events"))
def _(v):
    return E.key_digest(v("events"), "event_type", "user_id")


@query("d25_date_bounds", "SELECT symbol, min(available) AS first, max(available) AS last FROM financial_version GROUP BY 1")
def _(v):
    return E.date_bounds(v("financial_version"), "available", "symbol")


@query("d35_industry_batches", "SELECT s_nationkey AS batch, count(DISTINCT s_suppkey % 2) AS codes, count(*) AS n FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey % 2) > 1 OR count(*) >= 5")
def _(v):
    return E.industry_batches(v("supplier").select(F.col("s_nationkey").alias("batch"), (F.col("s_suppkey") % 2).alias("code")), 5)


@query("d36_taxonomy_codes", "SELECT DISTINCT p_brand AS code FROM part WHERE p_type = 'ECONOMY'")
def _(v):
    return E.taxonomy_codes(v("part").select(F.col("p_type").alias("source"), F.col("p_brand").alias("code")), "ECONOMY")


@query("d37_known_codes", "SELECT DISTINCT symbol AS code FROM security_event WHERE kind = 'LISTED'")
def _(v):
    return E.taxonomy_codes(v("security_event").select(F.col("kind").alias("source"), F.col("symbol").alias("code")), "LISTED")


@query("d38_preferred_listing", "WITH e AS (SELECT symbol, kind, effective AS day FROM security_event WHERE kind = 'LISTED' AND symbol % 3 > 0 UNION ALL SELECT symbol, 'FIRST_TRADED', CAST(min(idx) AS INTEGER) FROM bar GROUP BY symbol), m AS (SELECT symbol, max(kind) AS kind FROM e GROUP BY 1) SELECT e.symbol, min(day) AS day, m.kind, count(DISTINCT day) = 1 AS agrees FROM e JOIN m ON m.symbol = e.symbol AND m.kind = e.kind GROUP BY e.symbol, m.kind")
def _(v):
    listed = v("security_event").filter("kind = 'LISTED' and symbol % 3 > 0").select("symbol", "kind", F.col("effective").alias("day"))
    traded = P.first_trades(v("bar")).select("symbol", "kind", F.col("effective").cast("int").alias("day"))
    return E.preferred_listing(listed.unionByName(traded))


@query("d39_consistency", "WITH o AS (SELECT o_custkey AS q, CASE WHEN o_totalprice > 450000 THEN 'EMPTY' ELSE 'FOUND' END AS outcome, o_custkey % 5 * (o_orderkey % 2) AS doc FROM orders), g AS (SELECT q, count(*) AS n, count(DISTINCT outcome) AS c, count(DISTINCT doc) AS d, max(outcome) AS x FROM o GROUP BY q) SELECT q AS query, CASE WHEN n < 3 THEN 'INSUFFICIENT' WHEN c > 1 OR d > 1 THEN 'UNSTABLE' WHEN x = 'FOUND' THEN 'STABLE_FOUND' ELSE 'STABLE_EMPTY' END AS state FROM g")
def _(v):
    o = v("orders").select(F.col("o_custkey").alias("query"), F.when(F.col("o_totalprice") > 450000, "EMPTY").otherwise("FOUND").alias("outcome"), (F.col("o_custkey") % 5 * (F.col("o_orderkey") % 2)).alias("document"))
    return E.consistency(o)


# what was found: large orders of high priority
_FOUND = "o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 300000"


@query("d40_admission_report", f"WITH s AS (SELECT c_custkey AS symbol FROM customer WHERE c_acctbal >= 0), a AS (SELECT o_custkey AS symbol, count(*) AS n, count(DISTINCT o_orderstatus) AS c FROM orders WHERE {_FOUND} GROUP BY 1) SELECT coalesce(s.symbol, a.symbol) AS symbol, CASE WHEN n IS NULL THEN 'MISSING' WHEN s.symbol IS NULL THEN 'UNEXPECTED' WHEN c > 1 THEN 'CONFLICTING' WHEN n > 1 THEN 'DUPLICATE' ELSE 'ADMITTED' END AS state FROM s FULL JOIN a ON s.symbol = a.symbol")
def _(v):
    return E.admission_report(v("customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("symbol")), v("orders").filter(_FOUND).select(F.col("o_custkey").alias("symbol"), F.col("o_orderstatus").alias("code")))


@query("d41_period_grid", "WITH f AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS part, count(*) AS n FROM orders GROUP BY 1, 2, 3), g AS (SELECT k.o_custkey, CAST(y AS INTEGER) AS year, CAST(p AS INTEGER) AS part FROM (SELECT DISTINCT o_custkey FROM orders) k, (SELECT unnest(generate_series(1995, 2001)) AS y), (SELECT unnest(generate_series(1, 4)) AS p)) SELECT g.o_custkey, g.year, g.part, CASE WHEN n IS NULL THEN 'MISSING' WHEN n > 1 THEN 'DUPLICATE' ELSE 'FOUND' END AS state FROM g LEFT JOIN f USING (o_custkey, year, part)")
def _(v):
    return E.period_grid(v("orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("part")), 1995, 2001, 4, ["o_custkey"])


@query("d42_discovery_counts", f"SELECT c_nationkey AS shard, count(*) AS planned, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders WHERE {_FOUND})) AS observed, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {_FOUND})) AS missing FROM customer GROUP BY 1")
def _(v):
    return E.discovery_counts(v("customer").select(F.col("c_nationkey").alias("shard"), F.col("c_custkey").alias("key")), v("orders").filter(_FOUND).select(F.col("o_custkey").alias("key")))


@query("d44_bar_violations", "WITH b AS (SELECT symbol, idx, CASE WHEN symbol = 3 AND idx % 5 = 0 THEN low * 0.5 ELSE high END AS high, low, open, close, CASE WHEN symbol = 4 THEN -volume ELSE volume END AS volume, limit_up, limit_down, idx * 28 + CASE WHEN symbol = 5 AND idx % 7 = 0 THEN 40 ELSE 10 END AS available FROM bar), x AS (SELECT symbol, idx, concat_ws(',', CASE WHEN NOT (high >= greatest(open, close, low) AND low <= least(open, close, high)) THEN 'GEOMETRY' END, CASE WHEN volume < 0 THEN 'VOLUME' END, CASE WHEN available > lead(idx) OVER (PARTITION BY symbol ORDER BY idx) * 28 THEN 'LATE' END) AS violations FROM b) SELECT * FROM x WHERE violations <> ''")
def _(v):
    s, i = F.col("symbol"), F.col("idx")
    b = v("bar").withColumn("high", F.when((s == 3) & (i % 5 == 0), F.col("low") * 0.5).otherwise(F.col("high"))).withColumn("volume", F.when(s == 4, -F.col("volume")).otherwise(F.col("volume"))).withColumn("available", i * 28 + F.when((s == 5) & (i % 7 == 0), 40).otherwise(10))
    return E.bar_violations(b)


@query("d45_input_violations", "SELECT 'BAR' AS what, idx FROM bar WHERE symbol = 2 AND idx % 10 = 0 UNION ALL SELECT 'SIGNAL', idx FROM calendar WHERE idx % 8 = 0")
def _(v):
    b = v("bar").select("symbol", "idx")
    return E.input_violations(v("calendar").filter("idx % 8 > 0").select("idx"), b.unionAll(b.filter("symbol = 2 and idx % 10 = 0")), v("calendar").select("idx"))


@query("g01_overlapping_keys", "SELECT symbol, idx FROM bar WHERE idx = 50")
def _(v):
    b = v("bar").select("symbol", "idx")
    return E.union_checked(b.filter("idx <= 50"), b.filter("idx >= 50"), ["symbol", "idx"])[1]


@query("g01_union", "SELECT symbol, idx FROM bar WHERE idx <= 50 UNION ALL SELECT symbol, idx FROM bar WHERE idx > 50")
def _(v):
    b = v("bar").select("symbol", "idx")
    return E.union_checked(b.filter("idx <= 50"), b.filter("idx > 50"), ["symbol", "idx"])[0]


@query("g02_key_difference", "SELECT o_custkey AS k, 'LEFT_ONLY' AS side FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1 UNION ALL SELECT o_custkey, 'RIGHT_ONLY' FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def _(v):
    o = v("orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return E.key_difference(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), ["k"])


@query("g03_set_difference", f"SELECT c_custkey AS symbol FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {_FOUND})")
def _(v):
    return v("customer").select(F.col("c_custkey").alias("symbol")).subtract(v("orders").filter(_FOUND).select(F.col("o_custkey").alias("symbol")))


@query("g04_shared_lineage", "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')")
def _(v):
    o = v("orders").withColumnRenamed("o_custkey", "id")
    return E.shared_lineage(o.filter("o_orderpriority = '1-URGENT'"), o.filter("o_orderpriority = '5-LOW'"), "id")


@query("g05_by_quarter", "SELECT CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) AS VARCHAR) AS quarter, count(*) AS n FROM orders GROUP BY 1")
def _(v):
    rows = E.by_quarter(v("orders"), "o_orderdate")
    return rows.groupBy(F.col("quarter").cast("string").alias("quarter")).agg(F.count("*").alias("n"))


@query("g06_one_schema", "SELECT c_custkey AS symbol, c_name AS name, CAST(NULL AS BIGINT) AS orders, CAST(NULL AS DOUBLE) AS balance, 'NOTICE' AS source_kind FROM customer UNION ALL SELECT o_custkey, NULL, count(*), NULL, 'BULLETIN' FROM orders GROUP BY o_custkey UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal, 'ASSOCIATION' FROM supplier UNION ALL SELECT p_partkey, p_name, NULL, NULL, 'PROSPECTUS' FROM part")
def _(v):
    return E.one_schema({
        "NOTICE": v("customer").select(F.col("c_custkey").alias("symbol"), F.col("c_name").alias("name")),
        "BULLETIN": v("orders").groupBy(F.col("o_custkey").alias("symbol")).agg(F.count("*").alias("orders")),
        "ASSOCIATION": v("supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        "PROSPECTUS": v("part").select(F.col("p_partkey").alias("symbol"), F.col("p_name").alias("name")),
    })


@query("a15_partitioned_publication", "SELECT feature_id, count(*) AS n, count(value) AS valued, round(sum(value), 4) AS total FROM feature GROUP BY 1")
def _(v):
    """The long feature table, published by feature and read back."""
    from tidemark.sources.scratch import scratch_root
    from tidemark.sources.stores import publish, read_published

    rows = v("feature")
    spark = rows.sparkSession
    back = read_published(spark, publish(rows, f"{scratch_root(spark)}/artifacts", "feature_id"))
    return rounded(back.groupBy("feature_id").agg(F.count("*").alias("n"), F.count("value").alias("valued"), F.sum("value").alias("total")), "total", n=4)
