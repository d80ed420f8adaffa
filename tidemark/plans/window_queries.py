"""Queries of the window and cross-section operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import windows as W

from .registry import query


def rounded(df, *names, n=8):
    """Columns rounded to n places; + 0.0 makes a negative zero a plain one."""
    return df.withColumns({c: F.round(c, n) + F.lit(0.0) for c in names})


_GAP = "CASE WHEN idx - lag(idx, {k}) OVER w = {k} THEN {x} END"
_ADJ = "a AS (SELECT *, close * adj AS p FROM bar)"


@query("e01_momentum", f"WITH {_ADJ} SELECT symbol, idx, round({_GAP.format(k=6, x='p / lag(p, 6) OVER w - 1')}, 8) AS value FROM a WINDOW w AS (PARTITION BY symbol ORDER BY idx)")
def _(v):
    return rounded(W.momentum(v("bar"), 6), "value")


@query("e01_reversal", f"WITH {_ADJ} SELECT symbol, idx, round({_GAP.format(k=3, x='1 - p / lag(p, 3) OVER w')}, 8) AS value FROM a WINDOW w AS (PARTITION BY symbol ORDER BY idx)")
def _(v):
    return rounded(W.reversal(v("bar"), 3), "value")


@query("e02_volatility", f"WITH {_ADJ}, r AS (SELECT *, CASE WHEN idx - lag(idx) OVER w = 1 THEN p / lag(p) OVER w - 1 END AS r FROM a WINDOW w AS (PARTITION BY symbol ORDER BY idx)) SELECT symbol, idx, round(CASE WHEN idx - lag(idx, 12) OVER w = 12 THEN stddev_samp(r) OVER (PARTITION BY symbol ORDER BY idx ROWS 11 PRECEDING) END, 8) AS value FROM r WINDOW w AS (PARTITION BY symbol ORDER BY idx)")
def _(v):
    return rounded(W.volatility(v("bar"), 12), "value")


@query("e03_rolling_drawdown", f"WITH {_ADJ}, x AS (SELECT a.symbol, a.idx, b.p / max(c.p) AS q FROM a JOIN a b ON b.symbol = a.symbol AND b.idx BETWEEN a.idx - 11 AND a.idx JOIN a c ON c.symbol = a.symbol AND c.idx BETWEEN a.idx - 11 AND b.idx GROUP BY a.symbol, a.idx, b.idx, b.p), n AS (SELECT symbol, idx, idx - lag(idx, 11) OVER (PARTITION BY symbol ORDER BY idx) = 11 AS whole FROM a) SELECT n.symbol, n.idx, round(CASE WHEN any_value(whole) THEN least(min(q) - 1, 0) END, 8) AS value FROM n JOIN x ON x.symbol = n.symbol AND x.idx = n.idx GROUP BY n.symbol, n.idx")
def _(v):
    return rounded(W.rolling_drawdown(v("bar"), 12), "value")


@query("e04_turnover_mean", "SELECT symbol, idx, round(CASE WHEN idx - lag(idx, 5) OVER w = 5 AND count(total_mv) OVER f = 6 THEN avg(total_mv) OVER f END, 4) AS value FROM valuation WINDOW w AS (PARTITION BY symbol ORDER BY idx), f AS (PARTITION BY symbol ORDER BY idx ROWS 5 PRECEDING)")
def _(v):
    return rounded(W.rolling_mean(v("valuation"), "total_mv", 6), "value", n=4)


@query("e05_amount_median", "SELECT symbol, idx, round(CASE WHEN idx - lag(idx, 5) OVER w = 5 THEN ln(1 + median(amount) OVER f) END, 8) AS value FROM bar WINDOW w AS (PARTITION BY symbol ORDER BY idx), f AS (PARTITION BY symbol ORDER BY idx ROWS 5 PRECEDING)")
def _(v):
    return rounded(W.log_rolling_median(v("bar"), "amount", 6), "value")


@query("e06_amihud", "WITH x AS (SELECT *, abs(close / previous_close - 1) / amount * 1e9 AS x FROM bar) SELECT symbol, idx, round(CASE WHEN idx - lag(idx, 5) OVER w = 5 AND count(x) OVER f = 6 THEN avg(x) OVER f END, 6) AS value FROM x WINDOW w AS (PARTITION BY symbol ORDER BY idx), f AS (PARTITION BY symbol ORDER BY idx ROWS 5 PRECEDING)")
def _(v):
    return W.amihud(v("bar"), 6).withColumn("value", F.round(F.col("value") * 1e9, 6))


@query("e07_window_gaps", "SELECT symbol, idx, CASE WHEN lag(idx, 11) OVER w IS NULL THEN 'INSUFFICIENT_HISTORY' WHEN idx - lag(idx, 11) OVER w > 11 THEN 'MISSING_TRADING_SESSION' ELSE 'COMPLETE' END AS state FROM bar WINDOW w AS (PARTITION BY symbol ORDER BY idx)")
def _(v):
    return W.window_gaps(v("bar"), 12)


_U = "u AS (SELECT s.symbol, c.idx FROM (SELECT DISTINCT symbol FROM bar) s CROSS JOIN calendar c)"


def _why(n):
    """Why a factor of n sessions is null: its window has a gap, its history is too short, or its value isn't valid."""
    return f"CASE WHEN sessions >= {n} AND p{n} < {n} THEN 'MISSING_TRADING_SESSION' WHEN p{n} < {n} THEN 'INSUFFICIENT_HISTORY' ELSE 'SOURCE_VALUE_INVALID' END"


@query("e08_factor_rows", f"WITH {_U}, x AS (SELECT symbol, idx, idx + 1 AS sessions, count(*) OVER (PARTITION BY symbol ORDER BY idx RANGE 3 PRECEDING) AS p4, count(*) OVER (PARTITION BY symbol ORDER BY idx RANGE 6 PRECEDING) AS p7, CASE WHEN idx - lag(idx, 6) OVER w = 6 THEN close * adj / lag(close * adj, 6) OVER w - 1 END AS mom_6, CASE WHEN idx - lag(idx, 3) OVER w = 3 THEN close * adj / lag(close * adj, 3) OVER w - 1 END AS mom_3, true AS bar FROM bar WINDOW w AS (PARTITION BY symbol ORDER BY idx)), l AS (SELECT u.symbol, u.idx, x.bar, 'mom_6' AS feature_id, mom_6 AS value, {_why(7)} AS why FROM u LEFT JOIN x USING (symbol, idx) UNION ALL SELECT u.symbol, u.idx, x.bar, 'mom_3', mom_3, {_why(4)} FROM u LEFT JOIN x USING (symbol, idx)) SELECT symbol, idx, feature_id, round(value, 8) AS value, CASE WHEN bar IS NULL THEN 'MISSING_TRADING_SESSION' WHEN value IS NULL THEN why END AS null_reason FROM l")
def _(v):
    from tidemark.operators.pit import null_reasons

    bars = v("bar")
    universe = bars.select("symbol").distinct().join(v("calendar").select("idx"))
    rows, reasons = W.adjusted(bars).withColumn("calendar_sessions", F.col("idx") + 1), {}
    for n in (6, 3):  # one window serves both
        name = f"mom_{n}"
        rows = rows.withColumn(name, F.when(W.complete(n + 1), F.col("p") / F.lag("p", n).over(W.own()) - 1)).withColumn("present", F.count("*").over(W.own().rangeBetween(-n, 0)))
        reasons[name] = f"why_{name}"
        rows = rows.withColumn(reasons[name], null_reasons(rows, n + 1, F.col(name)))
    return rounded(W.factor_rows(universe, rows.select("symbol", "idx", *reasons, *reasons.values()), reasons), "value")


@query("e09_incremental_window", f"WITH {_ADJ}, m AS (SELECT symbol, idx, {_GAP.format(k=6, x='p / lag(p, 6) OVER w - 1')} AS value FROM a WINDOW w AS (PARTITION BY symbol ORDER BY idx)) SELECT symbol, idx, round(value, 8) AS value FROM m WHERE idx >= 60")
def _(v):
    return rounded(W.incremental(v("bar"), 60, 6, lambda b: W.momentum(b, 6)), "value")


_RANK = "rank() OVER (PARTITION BY feature_id, idx ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, idx, value) - 1) / 2.0"


@query("e10_average_rank", f"SELECT symbol, idx, feature_id, CAST({_RANK} AS DOUBLE) AS rank FROM feature WHERE value IS NOT NULL")
def _(v):
    rows = v("feature").filter("value is not null")
    return W.average_rank(rows, "value", ["feature_id", "idx"]).select("symbol", "idx", "feature_id", F.col("rank").cast("double").alias("rank"))


@query("e12_percentile_target", f"WITH r AS (SELECT symbol, idx, feature_id, {_RANK} AS r, count(*) OVER (PARTITION BY feature_id, idx) AS n FROM feature WHERE value IS NOT NULL) SELECT symbol, idx, feature_id, round(CAST(CASE WHEN n > 1 THEN (r - 1) / (n - 1) ELSE 0.5 END AS DOUBLE), 8) AS target FROM r")
def _(v):
    rows = W.percentile_rank(v("feature").filter("value is not null"), "value", ["feature_id", "idx"])
    return rounded(rows.select("symbol", "idx", "feature_id", F.col("target").cast("double").alias("target")), "target")


_Q = f"q AS (SELECT symbol, idx, feature_id, CAST(least(5, greatest(1, floor(({_RANK} - 1) * 5 / count(*) OVER (PARTITION BY feature_id, idx)) + 1)) AS INTEGER) AS quintile FROM feature WHERE value IS NOT NULL)"


@query("e13_quintile", f"WITH {_Q} SELECT * FROM q")
def _(v):
    return W.quintile(v("feature").filter("value is not null"), "value", ["feature_id", "idx"]).select("symbol", "idx", "feature_id", "quintile")


@query("e14_bucket_turnover", f"WITH {_Q}, d AS (SELECT feature_id, idx, lag(idx) OVER (PARTITION BY feature_id ORDER BY idx) AS previous FROM (SELECT DISTINCT feature_id, idx FROM q)), t AS (SELECT * FROM q WHERE quintile = 5) SELECT t.feature_id, t.idx, round(1 - count(p.symbol) / count(*), 8) AS turnover FROM t JOIN d ON d.feature_id = t.feature_id AND d.idx = t.idx AND d.previous IS NOT NULL LEFT JOIN t p ON p.feature_id = t.feature_id AND p.idx = d.previous AND p.symbol = t.symbol GROUP BY t.feature_id, t.idx")
def _(v):
    return rounded(W.bucket_turnover(W.quintile(v("feature").filter("value is not null"), "value", ["feature_id", "idx"])), "turnover")


@query("e15_drawdown", "SELECT run, idx, round(max(equity) OVER w, 8) AS peak, round(equity / max(equity) OVER w - 1, 8) AS drawdown FROM equity WINDOW w AS (PARTITION BY run ORDER BY idx)")
def _(v):
    return rounded(W.drawdown(v("equity")).select("run", "idx", "peak", "drawdown"), "peak", "drawdown")


@query("e16_admission", "WITH l AS (SELECT symbol, min(idx) AS listed FROM bar GROUP BY symbol), x AS (SELECT b.symbol, b.idx, b.idx - l.listed AS age, count(*) OVER w AS active, count(*) OVER r AS last, median(amount) OVER r AS median FROM bar b JOIN l ON l.symbol = b.symbol WINDOW w AS (PARTITION BY b.symbol ORDER BY b.idx RANGE 5 PRECEDING), r AS (PARTITION BY b.symbol ORDER BY b.idx RANGE 2 PRECEDING)) SELECT symbol, idx, age, active, CAST(median AS DOUBLE) AS median, concat_ws(',', CASE WHEN age < 12 THEN 'TOO_NEW' END, CASE WHEN active < 5 THEN 'RARELY_TRADED' END, CASE WHEN last < 3 OR median < 20000000 THEN 'LOW_AMOUNT' END) AS reasons FROM x")
def _(v):
    bars = v("bar")
    return W.admission(bars, bars.groupBy("symbol").agg(F.min("idx").alias("listed")), amount=20_000_000)


@query("e17_weekly_decisions", "WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) SELECT CAST(isoyear(date) AS INTEGER) AS iso_year, CAST(weekofyear(date) AS INTEGER) AS iso_week, CAST(max(date) AS VARCHAR) AS date, CAST(max(date) AS VARCHAR) || ' 18:00:00' AS decision FROM d GROUP BY 1, 2")
def _(v):
    return W.weekly_decisions(v("lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()).withColumn("date", F.col("date").cast("string"))


@query("e18_walk_forward", "WITH c AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS k, count(*) OVER () AS n FROM calendar), f AS (SELECT idx, k, CAST(unnest(range(0, CAST(floor((n - 20 - 19) / 5) + 1 AS BIGINT))) AS INTEGER) AS fold FROM c) SELECT fold, idx, CASE WHEN k < 20 + fold * 5 THEN 'train' WHEN k BETWEEN 22 + fold * 5 AND 28 + fold * 5 THEN 'validation' ELSE 'test' END AS role FROM f WHERE k < 20 + fold * 5 OR k BETWEEN 22 + fold * 5 AND 28 + fold * 5 OR k BETWEEN 31 + fold * 5 AND 38 + fold * 5")
def _(v):
    return W.walk_forward(v("calendar").select("idx"), 20, 7, 8, 5, purge=2, embargo=2)


@query("e19_ordinal_ranks", "SELECT symbol, idx, CAST(row_number() OVER (PARTITION BY idx ORDER BY score DESC, symbol) AS INTEGER) AS top, CAST(row_number() OVER (PARTITION BY idx ORDER BY score, symbol) AS INTEGER) AS bottom FROM score")
def _(v):
    return W.ordinal_ranks(v("score")).drop("score")


_SMA = "s AS (SELECT symbol, idx, CASE WHEN count(*) OVER l = 6 AND avg(close) OVER s > avg(close) OVER l THEN 1 ELSE 0 END AS signal FROM bar WINDOW s AS (PARTITION BY symbol ORDER BY idx ROWS 1 PRECEDING), l AS (PARTITION BY symbol ORDER BY idx ROWS 5 PRECEDING))"


@query("e20_crossover", f"WITH {_SMA} SELECT * FROM s")
def _(v):
    return W.crossover(v("bar"), 2, 6)


@query("e21_breakers", "SELECT run, idx, CASE WHEN equity / max(equity) OVER w - 1 <= -0.2 THEN 'DRAWDOWN' WHEN equity / lag(equity) OVER w - 1 <= -0.08 THEN 'DAY_LOSS' WHEN -(notional - floor(notional / 100) * 100) / 300 <= -0.15 THEN 'POSITION_LOSS' END AS rule FROM equity WINDOW w AS (PARTITION BY run ORDER BY idx)")
def _(v):
    return W.breakers(v("equity").withColumn("position", -(F.col("notional") - F.floor(F.col("notional") / 100) * 100) / 300))


# units of 100 shares, matched one by one; what sells could take is followed order by order
_FIFO = """WITH RECURSIVE n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day, seq) AS k, coalesce(sum(CASE WHEN side = 'BUY' THEN shares ELSE 0 END) OVER (PARTITION BY symbol ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room, sum(CASE WHEN side = 'BUY' THEN shares ELSE 0 END) OVER (PARTITION BY symbol ORDER BY day, seq) AS b1 FROM order_row),
  f AS (SELECT symbol, CAST(0 AS BIGINT) AS k, CAST(0 AS HUGEINT) AS before, CAST(0 AS HUGEINT) AS taken FROM (SELECT DISTINCT symbol FROM n) UNION ALL SELECT n.symbol, n.k, f.taken, f.taken + CASE WHEN n.side = 'SELL' THEN least(n.shares, n.room - f.taken) ELSE 0 END FROM f JOIN n ON n.symbol = f.symbol AND n.k = f.k + 1),
  s AS (SELECT n.symbol, n.seq, unnest(range(CAST(before // 100 AS BIGINT), CAST(taken // 100 AS BIGINT))) AS u FROM f JOIN n ON n.symbol = f.symbol AND n.k = f.k WHERE side = 'SELL'),
  b AS (SELECT symbol, seq, price, unnest(range(CAST((b1 - shares) // 100 AS BIGINT), CAST(b1 // 100 AS BIGINT))) AS u FROM n WHERE side = 'BUY')
  SELECT s.symbol, s.seq AS sell_seq, b.seq AS buy_seq, count(*) * 100 AS matched, round(max(b.price), 8) AS buy_price FROM s JOIN b ON b.symbol = s.symbol AND b.u = s.u GROUP BY 1, 2, 3"""


@query("e22_fifo", _FIFO)
def _(v):
    return rounded(W.fifo(v("order_row")), "buy_price")


@query("e23_signal_changes", f"WITH {_SMA}, c AS (SELECT *, coalesce(lag(signal) OVER (PARTITION BY symbol ORDER BY idx), 0) AS before FROM s) SELECT * FROM c WHERE signal <> before")
def _(v):
    return W.signal_changes(W.crossover(v("bar"), 2, 6))
