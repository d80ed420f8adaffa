"""Queries of the point-in-time operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import pit as P

from .registry import query
from .window_queries import rounded

_ROWS = "x AS (SELECT o_orderkey AS row_id, o_custkey AS symbol, CAST(o_orderdate AS DATE) AS event, o_orderkey % 6 AS k, o_totalprice AS price, o_orderstatus AS status FROM orders)"
POLICIES = ("observed_master_snapshot", "trade_date_close_plus_provider_delay", "known_before_trade_date_open", "observed_calendar_snapshot", "announcement_date_or_observed", "financial_actual_announcement_or_observed")


def _rows(v):
    return v("orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("event"), (F.col("o_orderkey") % 6).alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))


@query("b01_canonical_records", "SELECT o_orderkey AS row_id, 'record_' || sha256('s1|' || o_orderstatus || '|' || o_custkey || '|' || o_orderkey) AS record_id, CASE WHEN o_orderstatus = 'P' THEN 'QUARANTINED' ELSE 'ACCEPTED' END AS quality_status FROM orders")
def _(v):
    rows = P.canonical(_rows(v).withColumnRenamed("status", "endpoint"), ["symbol", "row_id"], "s1", ["P"])
    return rows.select("row_id", "record_id", "quality_status")


@query("b02_availability", f"WITH {_ROWS}, t AS (SELECT *, event + INTERVAL 3 DAY + INTERVAL 12 HOUR AS observed, CASE WHEN row_id % 4 > 0 THEN event + CAST(row_id % 5 AS INTEGER) END AS ann, CASE WHEN row_id % 3 = 0 THEN event + 1 END AS act FROM x) SELECT row_id, CAST(CASE WHEN k = 0 THEN observed WHEN k = 1 THEN event + INTERVAL 15 HOUR ELSE CAST(event AS TIMESTAMP) END AS VARCHAR) AS event_time, CAST(CASE WHEN k = 0 OR k = 3 THEN observed WHEN k = 1 THEN event + INTERVAL 16 HOUR WHEN k = 2 THEN event + INTERVAL 565 MINUTE WHEN k = 4 THEN CASE WHEN ann IS NULL THEN observed ELSE least(ann + INTERVAL 18 HOUR, observed) END ELSE CASE WHEN coalesce(act, ann) IS NULL THEN observed ELSE least(coalesce(act, ann) + INTERVAL 18 HOUR, observed) END END AS VARCHAR) AS available_at FROM t")
def _(v):
    rows = _rows(v).withColumn("policy", F.coalesce(*[F.when(F.col("k") == i, p) for i, p in enumerate(POLICIES)]))
    day = F.col("event")
    observed = F.to_timestamp(F.concat(F.date_add(day, 3).cast("string"), F.lit(" 12:00:00")))
    announced = F.when(F.col("row_id") % 4 > 0, F.date_add(day, (F.col("row_id") % 5).cast("int")))
    clocks = P.availability(F.col("policy"), day, observed, announced, F.when(F.col("row_id") % 3 == 0, F.date_add(day, 1)))
    return rows.select("row_id", clocks.alias("c")).select("row_id", F.col("c.event_time").cast("string").alias("event_time"), F.col("c.available_at").cast("string").alias("available_at"))


@query("b03_visible", "SELECT event_id, symbol FROM financial_version WHERE update_flag AND available <= 1500 AND report_period <= 15")
def _(v):
    rows = v("financial_version").withColumn("quality_status", F.when(F.col("update_flag"), "ACCEPTED").otherwise("REJECTED")).withColumnRenamed("available", "available_at")
    return P.visible(rows, F.lit(1500)).filter("report_period <= 15").select("event_id", "symbol")


@query("b04_quarantine", "SELECT event_type AS endpoint, CASE WHEN event_type IN ('error', 'signup') THEN 'QUARANTINED' ELSE 'ACCEPTED' END AS quality_status, count(*) AS n FROM events GROUP BY 1, 2")
def _(v):
    rows = P.canonical(v("events").withColumnRenamed("event_type", "endpoint"), ["event_id"], "s1", ["error", "signup"])
    return rows.groupBy("endpoint", "quality_status").agg(F.count("*").alias("n"))


@query("b05_normalized_units", "SELECT symbol, idx, CAST(trunc(high * 100) AS BIGINT) AS volume, round(low * 1000, 4) AS amount, round(coalesce(previous_close, 0), 8) AS previous_close FROM bar")
def _(v):
    rows = P.normalized_units(v("bar").select("symbol", "idx", F.col("high").alias("volume_hands"), F.col("low").alias("amount_thousand"), "previous_close"))
    return rounded(rounded(rows.select("symbol", "idx", "volume", "amount", "previous_close"), "amount", n=4), "previous_close")


_MASTER = "m AS (SELECT c_custkey AS symbol, CAST(c_custkey % 900 AS INTEGER) AS list_day, CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 900 + 300 AS INTEGER) END AS delist_day, CAST(400 AS INTEGER) AS observed_day, c_mktsegment AS name FROM customer)"


def _master(v):
    k = F.col("c_custkey")
    return v("customer").select(k.alias("symbol"), (k % 900).cast("int").alias("list_day"), F.when(k % 5 == 0, (k % 900 + 300).cast("int")).alias("delist_day"), F.lit(400).alias("observed_day"), F.col("c_mktsegment").alias("name"))


@query("b06_lifecycle_events", f"WITH {_MASTER}, e AS (SELECT symbol, 'LISTED' AS kind, list_day AS effective, observed_day, CAST(NULL AS BOOLEAN) AS is_st FROM m UNION ALL SELECT symbol, 'DELISTED', delist_day, observed_day, NULL FROM m WHERE delist_day IS NOT NULL UNION ALL SELECT symbol, 'NAME_STATUS', observed_day, observed_day, contains(upper(name), 'ST') FROM m) SELECT symbol, kind, effective, least(effective, observed_day) AS available, is_st FROM e")
def _(v):
    return P.lifecycle_events(_master(v))


@query("b07_name_status", "SELECT p_partkey AS symbol, contains(upper(p_name), 'ST') AS is_st FROM part")
def _(v):
    p = v("part").select(F.col("p_partkey").alias("symbol"), F.lit(0).alias("list_day"), F.lit(None).cast("int").alias("delist_day"), F.lit(1).alias("observed_day"), F.col("p_name").alias("name"))
    return P.lifecycle_events(p).filter("kind = 'NAME_STATUS'").select("symbol", "is_st")


@query("b08_first_trades", "SELECT symbol, min(idx) AS effective, 'FIRST_TRADED' AS kind FROM bar GROUP BY symbol")
def _(v):
    return P.first_trades(v("bar"))


_DIV = "d AS (SELECT o_custkey AS symbol, o_totalprice AS cash, CAST(o_orderkey % 700 AS INTEGER) AS plan_day, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 700 + 40 AS INTEGER) END AS implemented_day, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 700 + 50 AS INTEGER) END AS ex_day FROM orders)"


@query("b09_dividend_events", f"WITH {_DIV} SELECT symbol, cash, 'PLAN_ANNOUNCED' AS kind, plan_day AS available, CAST(NULL AS INTEGER) AS ex_day FROM d UNION ALL SELECT symbol, cash, 'IMPLEMENTATION_ANNOUNCED', implemented_day, ex_day FROM d WHERE implemented_day IS NOT NULL")
def _(v):
    k, f = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    return P.dividend_events(v("orders").select(F.col("o_custkey").alias("symbol"), F.col("o_totalprice").alias("cash"), (k % 700).cast("int").alias("plan_day"), F.when(f, (k % 700 + 40).cast("int")).alias("implemented_day"), F.when(f, (k % 700 + 50).cast("int")).alias("ex_day")))


def _versions(v, **metrics):
    return v("orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").cast("string").alias("symbol"), F.date_format("o_orderdate", "yyyyMMdd").alias("period"), *[e.alias(n) for n, e in metrics.items()])


_KEYS = {"event_id": "bigint", "symbol": "bigint", "period": "int"}
_VERSION = "SELECT o_orderkey AS event_id, o_custkey AS symbol, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS period, {} FROM orders"


@query("b10_income_versions", _VERSION.format("o_totalprice AS revenue, CAST(NULL AS DOUBLE) AS profit"))
def _(v):
    return P.typed_versions(_versions(v, revenue=F.col("o_totalprice").cast("string"), profit=F.col("o_orderstatus")), _KEYS, ["revenue", "profit"])


@query("b11_balance_versions", _VERSION.format("o_totalprice * 3 AS assets, o_totalprice AS equity"))
def _(v):
    return P.typed_versions(_versions(v, assets=F.col("o_totalprice") * 3, equity=F.col("o_totalprice").cast("string")), _KEYS, ["assets", "equity"])


@query("b12_cashflow_versions", _VERSION.format("CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS operating"))
def _(v):
    return P.typed_versions(_versions(v, operating=F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("string")).otherwise("n/a")), _KEYS, ["operating"])


@query("b13_indicator_versions", _VERSION.format(", ".join(f"CAST(o_orderkey % {k + 7} AS DOUBLE) AS m{k}" for k in range(35))))
def _(v):
    return P.typed_versions(_versions(v, **{f"m{k}": (F.col("o_orderkey") % (k + 7)).cast("string") for k in range(35)}), _KEYS, [f"m{k}" for k in range(35)])


@query("b14_weight_violations", "SELECT s_suppkey AS symbol, s_acctbal AS weight FROM supplier WHERE s_acctbal IS NULL OR s_acctbal <= 0")
def _(v):
    return P.weight_violations(v("supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_acctbal").alias("weight")))


@query("b15_interval_violations", "SELECT o_orderkey AS id, CAST(o_orderkey % 91 AS INTEGER) AS effective_from, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 97 AS INTEGER) END AS effective_to FROM orders WHERE o_orderkey % 4 > 0 AND o_orderkey % 97 < o_orderkey % 91")
def _(v):
    k = F.col("o_orderkey")
    return P.interval_violations(v("orders").select(k.alias("id"), (k % 91).cast("int").alias("effective_from"), F.when(k % 4 > 0, (k % 97).cast("int")).alias("effective_to")))


@query("b16_typing_violations", "SELECT o_orderkey AS row_id, 'price:WRONG_TYPE' AS violation FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'status:MISSING' FROM orders WHERE o_orderkey % 11 = 0")
def _(v):
    k = F.col("o_orderkey")
    rows = v("orders").select(k.alias("row_id"), F.when(k % 7 == 0, F.lit("x")).otherwise(F.col("o_totalprice").cast("string")).alias("price"), F.when(k % 11 > 0, F.col("o_orderstatus")).alias("status"))
    return P.typing_violations(rows, {"price": "double", "status": "string"}, ["status"])


@query("b17_date_precision", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'DATE_ONLY' ELSE 'EXACT_MILLISECOND' END AS precision FROM orders")
def _(v):
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp")) - 8 * 3600 * 1000 + (F.col("o_orderkey") % 2) * 1234
    return v("orders").select(F.col("o_orderkey").alias("id"), P.date_precision(ms).alias("precision"))


@query("b18_content_ids", "SELECT c_custkey AS symbol, 'factor_trial_' || sha256(c_custkey || '|' || c_name || '|' || c_mktsegment) AS trial_id FROM customer")
def _(v):
    return v("customer").select(F.col("c_custkey").alias("symbol"), P.content_id("factor_trial_", "c_custkey", "c_name", "c_mktsegment").alias("trial_id"))


@query("b19_id_chunks", "WITH r AS (SELECT o_orderstatus, o_orderkey, floor((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) / 1000) AS chunk FROM orders) SELECT o_orderstatus, CAST(chunk AS BIGINT) AS chunk, count(*) AS n, sha256(string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderkey)) AS digest FROM r GROUP BY 1, 2")
def _(v):
    return P.id_chunks(v("orders"), "o_orderkey", "o_orderstatus")


@query("b20_field_lineage", "SELECT unnest(['open', 'volume', 'previous_close']) AS field, unnest(['trade.price', 'trade.qty', 'bar.close']) AS upstream, unnest(['first', 'sum', 'lag']) AS transformation, unnest([count(*), count(*), count(*)]) AS rows, unnest([count(open), count(volume), count(previous_close)]) AS valued FROM bar")
def _(v):
    return P.field_lineage(v("bar"), {"open": ("trade.price", "first"), "volume": ("trade.qty", "sum"), "previous_close": ("bar.close", "lag")})


@query("b21_round14", "SELECT symbol, idx, CAST(printf('%.13e', close / 3) AS DOUBLE) AS x14 FROM bar")
def _(v):
    return v("bar").withColumn("x", F.col("close") / 3).select("symbol", "idx", P.round14("x").alias("x14"))


@query("b22_safe_scalars", "SELECT s_suppkey AS symbol, round(CASE WHEN s_acctbal > 0 THEN 1 / s_acctbal END, 10) AS inverse, round(s_acctbal / 100, 8) AS share, round(CASE WHEN s_acctbal > 0 THEN ln(s_acctbal * 10000) END, 8) AS log_value FROM supplier")
def _(v):
    a = F.col("s_acctbal")
    rows = P.safe_scalars(v("supplier").select(F.col("s_suppkey").alias("symbol"), a.alias("ratio"), a.alias("percent"), a.alias("value")))
    return rounded(rounded(rows.select("symbol", "inverse", "share", "log_value"), "share", "log_value"), "inverse", n=10)


@query("b23_null_reasons", "WITH x AS (SELECT symbol, idx, idx + 1 AS calendar_sessions, count(*) OVER (PARTITION BY symbol ORDER BY idx RANGE 11 PRECEDING) AS present FROM bar) SELECT symbol, idx, CASE WHEN calendar_sessions >= 12 THEN CASE WHEN present < 12 THEN 'MISSING_TRADING_SESSION' END WHEN present < 12 THEN 'INSUFFICIENT_HISTORY' END AS window_reason FROM x")
def _(v):
    from tidemark.operators.windows import own

    rows = v("bar").withColumn("calendar_sessions", F.col("idx") + 1).withColumn("present", F.count("*").over(own().rangeBetween(-11, 0)))
    return rows.select("symbol", "idx", P.null_reasons(rows, 12))


_LABELS = """c AS (SELECT idx, lead(idx, 1) OVER (ORDER BY idx) AS entry, lead(idx, 3) OVER (ORDER BY idx) AS exit FROM calendar),
  l AS (SELECT b.symbol, b.idx, c.entry, c.exit, e.open AS eo, e.suspended AS es, e.limit_up AS eu, x.open AS xo, x.suspended AS xs, x.limit_down AS xd, me.open AS me, mx.open AS mx FROM bar b JOIN c ON c.idx = b.idx LEFT JOIN bar e ON e.symbol = b.symbol AND e.idx = c.entry LEFT JOIN bar x ON x.symbol = b.symbol AND x.idx = c.exit LEFT JOIN benchmark_bar me ON me.idx = c.entry LEFT JOIN benchmark_bar mx ON mx.idx = c.exit),
  r AS (SELECT *, CASE WHEN entry IS NULL THEN 'NO_ENTRY_SESSION' WHEN exit IS NULL THEN 'NO_EXIT_SESSION' WHEN eo IS NULL THEN 'MISSING_ENTRY_BAR' WHEN es THEN 'ENTRY_SUSPENDED' WHEN eu IS NULL THEN 'MISSING_ENTRY_LIMIT' WHEN eo >= eu THEN 'ENTRY_LIMIT_UP' WHEN xo IS NULL THEN 'MISSING_EXIT_BAR' WHEN xs THEN 'EXIT_SUSPENDED' WHEN xd IS NULL THEN 'MISSING_EXIT_LIMIT' WHEN xo <= xd THEN 'EXIT_LIMIT_DOWN' WHEN me IS NULL OR mx IS NULL THEN 'BENCHMARK_MISSING' END AS reason FROM l)"""


def _labels(v):
    return P.forward_labels(v("bar"), v("benchmark_bar"), P.offset_sessions(v("calendar"), 1, 3))


@query("b24_label_reasons", f"WITH {_LABELS} SELECT reason, count(*) AS n FROM r GROUP BY reason")
def _(v):
    return _labels(v).groupBy("reason").agg(F.count("*").alias("n"))


@query("b25_label_values", f"WITH {_LABELS} SELECT symbol, idx, entry, exit, round(CASE WHEN reason IS NULL THEN xo / eo - mx / me END, 8) AS label, reason FROM r")
def _(v):
    return rounded(_labels(v), "label")


@query("b26_label_clocks", "WITH t AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) + 1 AS entry_date, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) + 21 END AS exit_date, o_orderdate + INTERVAL 22 DAY AS c1, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 15 DAY END AS c2 FROM orders) SELECT id, CAST(entry_date + INTERVAL 570 MINUTE AS VARCHAR) AS entry_at, CAST(exit_date + INTERVAL 570 MINUTE AS VARCHAR) AS exit_at, CAST(CASE WHEN exit_date IS NOT NULL THEN greatest(exit_date + INTERVAL 18 HOUR, c1, coalesce(c2, c1)) END AS VARCHAR) AS available_at FROM t")
def _(v):
    d = F.to_date("o_orderdate")
    rows = v("orders").select(F.col("o_orderkey").alias("id"), F.date_add(d, 1).alias("entry_date"), F.when(F.col("o_orderkey") % 5 > 0, F.date_add(d, 21)).alias("exit_date"), F.expr("o_orderdate + interval 22 day").alias("c1"), F.when(F.col("o_orderkey") % 3 == 0, F.expr("o_orderdate + interval 15 day")).alias("c2"))
    rows = P.label_clocks(rows, ["c1", "c2"])
    return rows.select("id", *[F.col(c).cast("string").alias(c) for c in ("entry_at", "exit_at", "available_at")])


@query("c01_market_bundle", "WITH d AS (SELECT symbol, idx, close FROM bar), f AS (SELECT symbol, idx, adj FROM bar WHERE (symbol + idx) % 17 > 0), l AS (SELECT symbol, idx, limit_up FROM bar WHERE (symbol + idx) % 13 > 0), x AS (SELECT d.*, f.adj, l.limit_up, v.pe, f.symbol AS fs, l.symbol AS ls FROM d LEFT JOIN f USING (symbol, idx) LEFT JOIN l USING (symbol, idx) LEFT JOIN valuation v USING (symbol, idx)) SELECT symbol, idx, round(adj, 8) AS adj, round(limit_up, 8) AS limit_up, round(pe, 8) AS pe, CASE WHEN fs IS NULL THEN 'MISSING_FACTOR' WHEN ls IS NULL THEN 'MISSING_LIMIT' END AS rejection FROM x")
def _(v):
    b, k = v("bar"), F.col("symbol") + F.col("idx")
    rows = P.market_bundle(b.select("symbol", "idx", "close"), b.filter(k % 17 > 0).select("symbol", "idx", "adj"), b.filter(k % 13 > 0).select("symbol", "idx", "limit_up"), v("valuation").select("symbol", "idx", "pe"), ["symbol", "idx"])
    return rounded(rows.drop("close"), "adj", "limit_up", "pe")


@query("c02_suspension_overlay", "SELECT symbol, idx, EXISTS (SELECT 1 FROM trade t WHERE t.symbol = b.symbol AND t.idx = b.idx AND flag = 'R' AND qty > 45) AS is_suspended FROM bar b")
def _(v):
    n = v("trade").filter("qty > 45").select("symbol", "idx", F.when(F.col("flag") == "R", "S").otherwise("R").alias("type"))
    return P.suspension_overlay(v("bar").select("symbol", "idx"), n, ["symbol", "idx"])


@query("c03_label_evidence", "WITH d AS (SELECT symbol, idx, idx * 10 + 1 AS daily_at FROM bar WHERE symbol % 3 > 0), l AS (SELECT symbol, idx, idx * 10 + 4 AS limit_at FROM bar WHERE symbol % 4 > 0), s AS (SELECT symbol, idx, idx * 10 + 2 AS suspended_at FROM bar WHERE suspended), x AS (SELECT coalesce(d.symbol, l.symbol) AS symbol, coalesce(d.idx, l.idx) AS idx, daily_at, limit_at FROM d FULL JOIN l ON d.symbol = l.symbol AND d.idx = l.idx) SELECT coalesce(x.symbol, s.symbol) AS symbol, coalesce(x.idx, s.idx) AS idx, greatest(daily_at, limit_at, suspended_at) AS available, CASE WHEN suspended_at IS NOT NULL THEN 'SUSPENSION' WHEN limit_at IS NOT NULL THEN 'LIMIT' ELSE 'DAILY' END AS source FROM x FULL JOIN s ON x.symbol = s.symbol AND x.idx = s.idx")
def _(v):
    b = v("bar")
    return P.label_evidence(b.filter("symbol % 3 > 0").selectExpr("symbol", "idx", "idx * 10 + 1 as daily_at"), b.filter("symbol % 4 > 0").selectExpr("symbol", "idx", "idx * 10 + 4 as limit_at"), b.filter("suspended").selectExpr("symbol", "idx", "idx * 10 + 2 as suspended_at"), ["symbol", "idx"])


@query("c04_as_of", "WITH x AS (SELECT d.symbol, d.day, v.report_period, v.available, v.event_id, v.metric, row_number() OVER (PARTITION BY d.symbol, d.day ORDER BY v.report_period DESC, v.available DESC, v.update_flag DESC, v.event_id DESC) AS k FROM decision d LEFT JOIN financial_version v ON v.symbol = d.symbol AND v.available <= d.day) SELECT symbol, CAST(day AS INTEGER) AS day, report_period, available, event_id, metric FROM x WHERE k = 1")
def _(v):
    keys = v("decision").withColumn("day", F.col("day").cast("int"))
    rows = P.as_of(v("financial_version"), keys, ["report_period", "available", "update_flag", "event_id"], ["metric"])
    return rows.drop("update_flag")


_GRID = "g AS (SELECT s.symbol, d.day FROM (SELECT DISTINCT symbol FROM bar) s CROSS JOIN (SELECT DISTINCT CAST(idx * 28 AS INTEGER) AS day FROM calendar ) d)"


def _grid(v):
    days = v("calendar").select((F.col("idx") * 28).cast("int").alias("day")).distinct()
    return v("bar").select("symbol").distinct().join(days)


_STATE = _GRID + """,
  ev AS MATERIALIZED (SELECT *, CASE kind WHEN 'LISTED' THEN 0 WHEN 'NAME_STATUS' THEN 1 ELSE 2 END AS pr FROM security_event),
  pt AS (SELECT DISTINCT symbol, greatest(effective, available) AS point FROM ev),
  e AS MATERIALIZED (SELECT pt.symbol, point, kind, effective, is_st, row(effective, pr, available, event_id) AS o FROM pt JOIN ev ON ev.symbol = pt.symbol AND effective <= point AND available <= point),
  ll AS (SELECT symbol, point, max(o) AS l FROM e WHERE kind = 'LISTED' GROUP BY 1, 2),
  le AS (SELECT e.symbol, e.point, max(o) AS d FROM e JOIN ll ON ll.symbol = e.symbol AND ll.point = e.point WHERE kind = 'DELISTED' AND o < l GROUP BY 1, 2),
  sp AS (SELECT e.symbol, e.point, min(effective) AS listed_at FROM e LEFT JOIN le ON le.symbol = e.symbol AND le.point = e.point WHERE kind = 'LISTED' AND (d IS NULL OR o > d) GROUP BY 1, 2),
  la AS (SELECT symbol, point, arg_max(kind, o) FILTER (kind <> 'NAME_STATUS') AS last, arg_max(is_st, o) FILTER (kind = 'NAME_STATUS') AS is_st FROM e GROUP BY 1, 2),
  ch AS MATERIALIZED (SELECT la.symbol, la.point, sp.listed_at, coalesce(la.last = 'DELISTED', false) AS delisted, la.is_st FROM la LEFT JOIN sp ON sp.symbol = la.symbol AND sp.point = la.point),
  st AS (SELECT g.symbol, g.day, ch.listed_at, coalesce(ch.delisted, false) AS delisted, ch.is_st FROM g ASOF LEFT JOIN ch ON ch.symbol = g.symbol AND g.day >= ch.point)"""


@query("c05_replay_state", f"WITH {_STATE} SELECT symbol, day, listed_at, delisted, is_st FROM st")
def _(v):
    return P.replay_state(v("security_event"), _grid(v))


@query("c05_state_intervals", f"WITH {_STATE}, w AS (SELECT *, row(listed_at, delisted, is_st) IS DISTINCT FROM lag(row(listed_at, delisted, is_st)) OVER o OR lag(point) OVER o IS NULL AS new FROM ch WINDOW o AS (PARTITION BY symbol ORDER BY point)) SELECT symbol, point AS day_from, lead(point) OVER (PARTITION BY symbol ORDER BY point) AS day_to, listed_at, delisted, is_st FROM w WHERE new")
def _(v):
    return P.state_intervals(v("security_event"))


@query("c06_universe_panel", f"WITH {_STATE}, a AS (SELECT symbol, CAST(idx * 28 AS INTEGER) AS day, count(*) OVER (PARTITION BY symbol ORDER BY idx RANGE 5 PRECEDING) AS active FROM bar) SELECT st.symbol, st.day, concat_ws(',', CASE WHEN listed_at IS NULL THEN 'NOT_LISTED' END, CASE WHEN delisted THEN 'DELISTED' END, CASE WHEN is_st IS NULL THEN 'UNKNOWN_STATUS' END, CASE WHEN is_st THEN 'SPECIAL_TREATMENT' END, CASE WHEN coalesce(active, 0) < 5 THEN 'RARELY_TRADED' END) AS reasons, (listed_at IS NOT NULL AND NOT delisted AND is_st IS NOT NULL AND NOT is_st AND coalesce(active, 0) >= 5) AS eligible FROM st LEFT JOIN a ON a.symbol = st.symbol AND a.day = st.day")
def _(v):
    from tidemark.operators.windows import own

    a = v("bar").select("symbol", (F.col("idx") * 28).cast("int").alias("day"), F.count("*").over(own().rangeBetween(-5, 0)).alias("active"))
    return P.universe_panel(P.replay_state(v("security_event"), _grid(v)), a)


@query("c07_offset_sessions", "SELECT idx, lead(idx, 1) OVER (ORDER BY idx) AS entry, lead(idx, 3) OVER (ORDER BY idx) AS exit FROM calendar")
def _(v):
    return P.offset_sessions(v("calendar"), 1, 3)


@query("c17_first_trade_fallback", "SELECT symbol, min(idx) AS first_idx, round(min_by(open, idx), 8) AS open FROM bar WHERE symbol % 4 = 1 GROUP BY symbol")
def _(v):
    return rounded(P.first_trade_fallback(v("bar"), v("security_event").filter("symbol % 4 <> 1")), "open")


@query("c18_next_open", "WITH c AS (SELECT DISTINCT CAST(idx * 28 AS INTEGER) AS o FROM calendar), p AS (SELECT event_id AS id, available AS day FROM financial_version) SELECT id, day, (SELECT min(o) FROM c WHERE o > day) AS next_open FROM p")
def _(v):
    cal = v("calendar").select((F.col("idx") * 28).cast("int").alias("day"))
    return P.next_open(cal, v("financial_version").select(F.col("event_id").alias("id"), F.col("available").alias("day"))).select("id", "day", "next_open")


@query("c19_admission_clock", "WITH c AS (SELECT DISTINCT CAST(idx * 28 AS INTEGER) AS o FROM calendar), p AS (SELECT event_id AS id, available AS day, event_id % 2 = 0 AS d, CAST(event_id % 2000 AS INTEGER) AS listed_day FROM financial_version) SELECT id, greatest(CASE WHEN d THEN (SELECT min(o) FROM c WHERE o > day) ELSE day END, listed_day) AS usable_from FROM p")
def _(v):
    cal = v("calendar").select((F.col("idx") * 28).cast("int").alias("day"))
    rows = v("financial_version").select(F.col("event_id").alias("id"), F.col("available").alias("day"), F.when(F.col("event_id") % 2 == 0, "DATE_ONLY").otherwise("EXACT").alias("precision"), (F.col("event_id") % 2000).cast("int").alias("listed_day"))
    return P.admission_clock(rows, P.next_open(cal, rows.select("day"))).select("id", "usable_from")


_IV = "i AS (SELECT o_custkey AS k, CAST(o_orderkey % 500 AS INTEGER) AS s, CASE WHEN o_orderkey % 6 > 0 THEN CAST(o_orderkey % 500 + 30 AS INTEGER) END AS e, o_orderstatus AS st FROM orders)"


def _intervals(v, which):
    k = F.col("o_orderkey")
    return v("orders").filter(which).select(F.col("o_custkey").alias("k"), (k % 500).cast("int").alias("start"), F.when(k % 6 > 0, (k % 500 + 30).cast("int")).alias("end"))


@query("c20_overlapping", f"WITH {_IV} SELECT a.k, a.s AS a_start, a.e AS a_end, b.s AS b_start, b.e AS b_end FROM i a JOIN i b ON a.k = b.k AND a.st = 'F' AND b.st <> 'F' AND (b.e IS NULL OR a.s < b.e) AND (a.e IS NULL OR b.s < a.e)")
def _(v):
    return P.overlapping(_intervals(v, "o_orderstatus = 'F'"), _intervals(v, "o_orderstatus <> 'F'"), "k")


@query("c21_resolve_sources", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'BASE' WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN 'SUPPLEMENT' WHEN c_custkey % 5 < 2 THEN 'REGISTRY' ELSE 'NONE' END AS source, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 5 < 2 THEN 'r' || c_nationkey END AS value FROM customer")
def _(v):
    c, k = v("customer"), F.col("c_custkey")
    return P.resolve_sources(c.select(k.alias("id"), F.when(k % 3 == 0, F.col("c_mktsegment")).alias("value")), c.filter((k % 3 == 1) & (k % 2 == 0)).select(k.alias("id"), F.col("c_name").alias("value")), c.filter(k % 5 < 3).select(k.alias("id"), F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("value"), (k % 5 < 2).alias("stable")))


@query("c23_last_known", "WITH g AS (SELECT s.symbol, c.idx FROM (SELECT DISTINCT symbol FROM bar) s CROSS JOIN calendar c) SELECT g.symbol, g.idx, round(last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.idx), 8) AS close, coalesce(b.volume, 0) AS volume FROM g LEFT JOIN bar b ON b.symbol = g.symbol AND b.idx = g.idx")
def _(v):
    grid = v("bar").select("symbol").distinct().join(v("calendar").select("idx"))
    return rounded(P.last_known(v("bar"), grid), "close")


@query("d01_fold_replays", "SELECT symbol, report_period, min(event_id) AS event_id, count(*) AS records, count(DISTINCT metric) > 1 AS conflict, min_by(metric, event_id) AS metric FROM financial_version GROUP BY symbol, report_period")
def _(v):
    return P.fold_replays(v("financial_version"), ["symbol", "report_period"], ["metric"], "event_id")


@query("d34_weight_batches", "WITH w AS (SELECT b.idx * 50 + symbol % 50 AS batch, symbol % 100 AS code, b.idx - CASE WHEN symbol % 50 = 7 AND b.idx % 9 = 0 THEN symbol % 3 ELSE 0 END AS day, CAST(b.volume AS DOUBLE) AS weight FROM bar b), g AS (SELECT batch, count(DISTINCT code) AS codes, count(DISTINCT day) AS days, count(*) AS n, sum(weight) AS total FROM w GROUP BY batch) SELECT batch, n, total, concat_ws(',', CASE WHEN codes > 1 THEN 'MIXED_INDEX' END, CASE WHEN days > 1 THEN 'MIXED_DATE' END, CASE WHEN n >= 4 THEN 'ROW_CAP' END, CASE WHEN NOT total BETWEEN 95 AND 400 THEN 'WEIGHT_SUM' END) AS violations FROM g")
def _(v):
    rows = v("bar").selectExpr("idx * 50 + symbol % 50 as batch", "symbol % 100 as index_code", "idx - case when symbol % 50 = 7 and idx % 9 = 0 then symbol % 3 else 0 end as day", "cast(volume as double) as weight")
    return P.weight_batches(rows, 4, 95, 400)


@query("b23_factor_reasons", """WITH u AS (SELECT s.symbol, c.idx FROM (SELECT DISTINCT symbol FROM bar) s CROSS JOIN calendar c),
  x AS (SELECT b.symbol, b.idx, b.idx + 1 AS sessions, count(*) OVER (PARTITION BY b.symbol ORDER BY b.idx RANGE 6 PRECEDING) AS present, CASE WHEN b.idx - lag(b.idx, 6) OVER w = 6 THEN b.close * adj / lag(b.close * adj, 6) OVER w - 1 END AS mom_6, v.total_mv, v.pe, s.s_acctbal AS ratio, true AS bar
    FROM bar b JOIN valuation v ON v.symbol = b.symbol AND v.idx = b.idx JOIN supplier s ON s.s_suppkey = b.symbol WINDOW w AS (PARTITION BY b.symbol ORDER BY b.idx)),
  y AS (SELECT u.symbol, u.idx, x.* EXCLUDE (symbol, idx) FROM u LEFT JOIN x ON x.symbol = u.symbol AND x.idx = u.idx)
  SELECT symbol, idx, 'mom_6' AS feature_id, round(mom_6, 8) AS value, CASE WHEN bar IS NULL THEN 'MISSING_TRADING_SESSION' WHEN mom_6 IS NULL THEN CASE WHEN present < 7 THEN CASE WHEN sessions >= 7 THEN 'MISSING_TRADING_SESSION' ELSE 'INSUFFICIENT_HISTORY' END ELSE 'SOURCE_VALUE_INVALID' END END AS null_reason FROM y
  UNION ALL SELECT symbol, idx, 'log_total_mv', round(ln(total_mv), 8), CASE WHEN bar IS NULL THEN 'MISSING_TRADING_SESSION' WHEN total_mv IS NULL THEN 'SOURCE_VALUE_MISSING' END FROM y
  UNION ALL SELECT symbol, idx, 'earnings_yield', round(CASE WHEN ratio > 0 THEN 1 / ratio END, 8), CASE WHEN bar IS NULL THEN 'MISSING_TRADING_SESSION' WHEN ratio <= 0 THEN 'NON_POSITIVE_DENOMINATOR' END FROM y""")
def _(v):
    """Momentum, log of market value, and the inverse of a ratio that may be negative (the account balance)."""
    from tidemark.operators import windows as W

    bars = v("bar")
    rows = bars.select("symbol", "idx", (F.col("idx") + 1).alias("calendar_sessions"), *[F.count("*").over(W.own().rangeBetween(1 - n, 0)).alias(f"present_{n}") for n in (1, 7)])
    rows = rows.join(W.momentum(bars, 6).withColumnRenamed("value", "mom_6"), ["symbol", "idx"]).join(v("valuation"), ["symbol", "idx"]).join(v("supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_acctbal").alias("ratio")), "symbol")
    rows = rows.withColumns({"log_total_mv": F.when(F.col("total_mv") > 0, F.ln("total_mv")), "earnings_yield": F.when(F.col("ratio") > 0, 1 / F.col("ratio"))})
    reasons = {}
    for name, needed, source, rule in (("mom_6", 7, None, "other"), ("log_total_mv", 1, F.col("total_mv"), "denominator"), ("earnings_yield", 1, F.col("ratio"), "denominator")):
        reasons[name] = f"why_{name}"
        rows = rows.withColumn("present", F.col(f"present_{needed}"))
        rows = rows.withColumn(reasons[name], P.null_reasons(rows, needed, F.col(name), source, rule))
    universe = bars.select("symbol").distinct().join(v("calendar").select("idx"))
    return rounded(W.factor_rows(universe, rows, reasons), "value")
