"""Queries of the portfolio operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import portfolios as O

from .registry import query
from .window_queries import rounded


def _scores(v):
    return v("feature").filter("value is not null and feature_id <> 'range'").select("idx", "symbol", F.col("value").alias("score"))


@query("c12_composite_scores", "SELECT idx, symbol, round(avg(value), 8) AS score FROM feature WHERE value IS NOT NULL AND feature_id <> 'range' GROUP BY 1, 2 HAVING count(*) = 3")
def _(v):
    return rounded(O.composite_scores(_scores(v), 3)[0], "score")


@query("c12_incomplete_keys", "SELECT idx, symbol, count(*) AS n FROM feature WHERE value IS NOT NULL AND feature_id <> 'range' GROUP BY 1, 2 HAVING count(*) <> 3")
def _(v):
    return O.composite_scores(_scores(v), 3)[1]


_TOP = "t AS (SELECT idx, symbol, CAST(row_number() OVER (PARTITION BY idx ORDER BY score DESC, symbol) AS INTEGER) AS rank FROM score), n AS (SELECT * FROM t WHERE rank <= 30)"


@query("f01_top_n", f"WITH {_TOP} SELECT *, round(0.95e0 / count(*) OVER (PARTITION BY idx), 10) AS weight FROM n")
def _(v):
    return rounded(O.top_n(v("score"), 30), "weight", n=10)


@query("f02_model_top_n", "WITH t AS (SELECT idx, symbol, CAST(row_number() OVER (PARTITION BY idx ORDER BY value DESC, symbol) AS INTEGER) AS rank FROM feature WHERE feature_id = 'mom_3' AND value IS NOT NULL), n AS (SELECT * FROM t WHERE rank <= 20) SELECT *, round(0.9e0 / count(*) OVER (PARTITION BY idx), 10) AS weight FROM n")
def _(v):
    m = v("feature").filter("feature_id = 'mom_3' and value is not null").withColumnRenamed("value", "score")
    return rounded(O.top_n(m, 20, 0.9), "weight", n=10)


@query("f03_veto_then_top", "WITH j AS (SELECT s.idx, s.symbol, s.score, f.value AS model FROM score s JOIN feature f ON f.idx = s.idx AND f.symbol = s.symbol AND f.feature_id = 'mom_3' AND f.value IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY model, symbol) AS low, count(*) OVER (PARTITION BY idx) AS n FROM j), l AS (SELECT *, CAST(row_number() OVER (PARTITION BY idx ORDER BY score DESC, symbol) AS INTEGER) AS rank, count(*) OVER (PARTITION BY idx) >= 30 AS enough FROM k WHERE low > ceil(n * 0.2)) SELECT idx, symbol, rank, enough FROM l WHERE rank <= 30")
def _(v):
    m = v("feature").filter("feature_id = 'mom_3' and value is not null").withColumnRenamed("value", "score")
    return O.veto_then_top(v("score"), m, 30)


_STRATA = "s AS (SELECT concat(listing_year, '-', segment) AS stratum, count(*) AS n FROM candidate GROUP BY 1), x AS (SELECT *, count(*) OVER () AS k, CAST(sum(n) OVER () AS BIGINT) AS t FROM s), y AS (SELECT *, CAST(floor((300 - k) * n / t) AS BIGINT) AS base, ((300 - k) * n) % t AS rem FROM x), z AS (SELECT *, row_number() OVER (ORDER BY rem DESC, stratum) AS place, (300 - k) - sum(base) OVER () AS rest FROM y), q AS (SELECT stratum, n, CAST(1 + base + CASE WHEN place <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM z)"


def _candidates(v):
    return v("candidate").withColumn("stratum", F.concat(F.col("listing_year").cast("string"), F.lit("-"), "segment"))


@query("d43_quotas", f"WITH {_STRATA} SELECT * FROM q")
def _(v):
    return O.quotas(_candidates(v).groupBy("stratum").agg(F.count("*").alias("n")), 300)


@query("f04_stratified_sample", f"WITH {_STRATA}, c AS (SELECT symbol, concat(listing_year, '-', segment) AS stratum, CAST(row_number() OVER (PARTITION BY concat(listing_year, '-', segment) ORDER BY sha256('v1|' || symbol || '|' || listing_date), symbol) AS INTEGER) AS k FROM candidate) SELECT c.* FROM c JOIN q USING (stratum) WHERE k <= quota")
def _(v):
    c = _candidates(v)
    return O.stratified_sample(c, O.quotas(c.groupBy("stratum").agg(F.count("*").alias("n")), 300), "v1")


@query("f05_shard_plan", "WITH r AS (SELECT o_orderstatus AS status, o_orderkey AS k, CAST(floor((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) / 500) AS BIGINT) AS shard FROM orders) SELECT status, shard, count(*) AS n, min(k) AS first, max(k) AS last, sha256(string_agg(CAST(k AS VARCHAR), '|' ORDER BY k)) AS digest FROM r GROUP BY 1, 2")
def _(v):
    return O.shard_plan(v("orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("k")), "status", "k", 500)


_HOLD = "h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY idx ORDER BY score DESC, symbol) <= 30 THEN target_w ELSE 0 END AS w1 FROM target)"
_CHAIN = _HOLD + """, p AS (SELECT *, least(w1, 0.05e0) AS w2 FROM h),
  r AS (SELECT *, CASE WHEN w2 > current_w AND NOT eligible THEN current_w WHEN w2 > current_w THEN current_w + floor(least((w2 - current_w) * 1e7 / price, volume * 0.05e0) / 2) * 2 * price / 1e7 ELSE w2 END AS w3 FROM p),
  i AS (SELECT *, coalesce(bool_or(industry IS NULL AND w3 > 0) OVER (PARTITION BY idx), false) AS draft, sum(w3) OVER (PARTITION BY idx, industry) AS it FROM r),
  j AS (SELECT *, CASE WHEN NOT draft AND it > 0.2e0 THEN w3 * 0.2e0 / it ELSE w3 END AS w4 FROM i),
  g AS (SELECT *, sum(w4) OVER (PARTITION BY idx) AS gt FROM j), g2 AS (SELECT *, CASE WHEN gt > 0.95e0 THEN w4 * 0.95e0 / gt ELSE w4 END AS w5a FROM g),
  g3 AS (SELECT *, sum(w5a * w5a) OVER (PARTITION BY idx) AS hh FROM g2), g4 AS (SELECT *, CASE WHEN hh > 0.05e0 THEN w5a * sqrt(0.05e0 / hh) ELSE w5a END AS w5 FROM g3),
  t AS (SELECT *, sum(abs(w5 - current_w)) OVER (PARTITION BY idx) / 2 AS tt FROM g4), z AS (SELECT *, current_w + (w5 - current_w) * CASE WHEN tt > 0.25e0 THEN 0.25e0 / tt ELSE 1 END AS w6 FROM t)"""


def _chain(v):
    t = v("target").withColumn("after_start", F.col("target_w"))
    out = t
    for name, rule in (("holdings", lambda d: O.holding_cap(d, 30)), ("position", O.position_cap), ("new_risk", lambda d: O.new_risk(d, 1e7, lot=2)), ("industry", O.industry_cap), ("gross", O.gross_and_concentration), ("turnover", O.turnover_limit)):
        out = rule(out).withColumn(f"after_{name}", F.col("target_w"))
    return out


@query("f06_holding_cap", f"WITH {_HOLD} SELECT idx, symbol, round(w1, 10) AS target_w FROM h")
def _(v):
    return rounded(O.holding_cap(v("target"), 30).select("idx", "symbol", "target_w"), "target_w", n=10)


@query("h01_position_cap", "SELECT idx, symbol, round(least(target_w, 0.02e0), 10) AS target_w FROM target")
def _(v):
    return rounded(O.position_cap(v("target"), 0.02).select("idx", "symbol", "target_w"), "target_w", n=10)


for _name, _col, _rule, _n in (("h02_new_risk", "w3", "new_risk", 15), ("h03_industry_cap", "w4", "industry", 9), ("h04_gross_and_concentration", "w5", "gross", 9), ("h05_turnover_limit", "w6", "turnover", 9)):

    @query(_name, f"WITH {_CHAIN} SELECT idx, symbol, round({_col}, {_n}) AS target_w FROM z")
    def _(v, rule=_rule, n=_n):
        return rounded(_chain(v).select("idx", "symbol", F.col(f"after_{rule}").alias("target_w")), "target_w", n=n)


@query("h06_rule_chain", f"WITH {_CHAIN} SELECT idx, symbol, draft, round(w6, 10) AS target_w FROM z")
def _(v):
    return rounded(_chain(v).select("idx", "symbol", "draft", "target_w"), "target_w", n=10)


@query("h06_rule_events", f"WITH {_CHAIN}, e AS (SELECT 'holdings' AS rule, target_w AS a, w1 AS b FROM z UNION ALL SELECT 'position', w1, w2 FROM z UNION ALL SELECT 'new_risk', w2, w3 FROM z UNION ALL SELECT 'industry', w3, w4 FROM z UNION ALL SELECT 'gross', w4, w5 FROM z UNION ALL SELECT 'turnover', w5, w6 FROM z) SELECT rule, count(*) AS events FROM e WHERE abs(a - b) > 1e-10 GROUP BY 1")
def _(v):
    return O.rule_events(_chain(v), 1e-10).groupBy("rule").agg(F.count("*").alias("events"))


_EVENTS = _CHAIN + """, ev AS (
  SELECT idx, symbol, 'MAX_POSITION_WEIGHT' AS rule, 'RESIZE' AS action, w1 AS observed, 0.05e0 AS lim FROM z WHERE w1 > 0.05e0
  UNION ALL SELECT idx, symbol, 'NEW_RISK_INELIGIBLE', 'REJECT', w2 - current_w, 0e0 FROM z WHERE w2 > current_w AND NOT eligible
  UNION ALL SELECT idx, symbol, 'VOLUME_PARTICIPATION', CASE WHEN lots = 0 THEN 'REJECT' ELSE 'RESIZE' END, wanted, cap FROM (SELECT *, (w2 - current_w) * 1e7 / price AS wanted, volume * 0.05e0 AS cap, floor(least((w2 - current_w) * 1e7 / price, volume * 0.05e0) / 2) AS lots FROM z WHERE w2 > current_w AND eligible) WHERE lots = 0 OR lots * 2 * price / 1e7 < w2 - current_w
  UNION ALL SELECT idx, NULL, 'MAX_HOLDINGS', 'REJECT', count(*), 30e0 FROM z WHERE target_w > 0 GROUP BY idx HAVING count(*) > 30
  UNION ALL SELECT idx, NULL, 'INDUSTRY_EXPOSURE_UNAVAILABLE', 'BLOCK_VALIDATION', count(*), 0e0 FROM z WHERE industry IS NULL AND w3 > 0 GROUP BY idx
  UNION ALL SELECT idx, NULL, 'MAX_INDUSTRY_WEIGHT', 'RESIZE', sum(w3), 0.2e0 FROM z WHERE NOT draft AND industry IS NOT NULL AND w3 > 0 GROUP BY idx, industry HAVING sum(w3) > 0.2e0
  UNION ALL SELECT idx, NULL, 'MINIMUM_CASH_WEIGHT', 'RESIZE', 1 - max(gt), 1 - 0.95e0 FROM z GROUP BY idx HAVING max(gt) > 0.95e0
  UNION ALL SELECT idx, NULL, 'CONCENTRATION', 'RESIZE', max(hh), 0.05e0 FROM z GROUP BY idx HAVING max(hh) > 0.05e0
  UNION ALL SELECT idx, NULL, 'MAX_TURNOVER', 'RESIZE', max(tt), 0.25e0 FROM z GROUP BY idx HAVING max(tt) > 0.25e0)"""


@query("h06_risk_events", f"WITH {_EVENTS} SELECT idx, symbol, rule, action, round(observed, 6) AS observed, round(lim, 6) AS \"limit\" FROM ev")
def _(v):
    return rounded(O.risk_events(_chain(v), 1e7, lot=2), "observed", "limit", n=6)


@query("h07_rebalance_orders", "WITH h AS (SELECT idx, symbol, CAST(volume % 7 * 100 AS BIGINT) AS shares FROM bar WHERE symbol % 3 > 0), t AS (SELECT idx, symbol, target_w, price FROM target WHERE symbol % 4 > 0), x AS (SELECT coalesce(t.idx, h.idx) AS idx, coalesce(t.symbol, h.symbol) AS symbol, CAST(coalesce(floor(target_w * 1e8 / price / 100) * 100, 0) - coalesce(shares, 0) AS BIGINT) AS delta FROM t FULL JOIN h ON t.idx = h.idx AND t.symbol = h.symbol) SELECT *, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side FROM x WHERE delta <> 0")
def _(v):
    h = v("bar").filter("symbol % 3 > 0").select("idx", "symbol", (F.col("volume") % 7 * 100).alias("shares"))
    return O.rebalance_orders(v("target").filter("symbol % 4 > 0").select("idx", "symbol", "target_w", "price"), h, 1e8)


@query("h08_mark_to_market", "WITH x AS (SELECT idx, symbol, volume * close AS value FROM bar) SELECT idx, symbol, round(value, 6) AS value, round(value / sum(value) OVER (PARTITION BY idx), 10) AS weight FROM x")
def _(v):
    b = v("bar")
    m = O.mark_to_market(b.select("idx", "symbol", F.col("volume").alias("shares")), b.select("idx", "symbol", "close"))
    return m.select("idx", "symbol", F.round("value", 6).alias("value"), F.round("weight", 10).alias("weight"))


@query("b27_costs", "SELECT o_orderkey AS id, round_even(greatest(o_totalprice * 0.00031e0, 5e0), 2) AS commission, CASE WHEN o_orderstatus = 'F' THEN round_even(o_totalprice * 0.00053e0, 2) ELSE 0e0 END AS stamp_duty FROM orders")
def _(v):
    r = v("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("notional"), F.when(F.col("o_orderstatus") == "F", "SELL").otherwise("BUY").alias("side"))
    return O.costs(r, rate=0.00031, stamp=0.00053).select("id", "commission", "stamp_duty")


@query("b28_block_reasons", "SELECT symbol, idx, CASE WHEN suspended THEN 'SUSPENDED' WHEN (symbol + idx) % 2 = 0 AND open >= limit_up - 1e-8 THEN 'LIMIT_UP' WHEN (symbol + idx) % 2 = 1 AND open <= limit_down + 1e-8 THEN 'LIMIT_DOWN' END AS reason FROM bar")
def _(v):
    side = F.when((F.col("symbol") + F.col("idx")) % 2 == 0, "BUY").otherwise("SELL")
    return v("bar").select("symbol", "idx", O.block_reason(side, F.col("open"), F.col("suspended"), F.col("limit_up"), F.col("limit_down")).alias("reason"))


@query("b29_sized_orders", "WITH x AS (SELECT symbol, idx, CAST(volume % 97 * 40 AS BIGINT) AS requested, floor((2e7 + idx * 1e5) * 0.05e0 / open / 10) * 10 AS p, floor((2e7 + idx * 1e5) * (1 - 0.97e0) / open / 10) * 10 AS c, floor(volume * 10 * 0.1e0 / 10) * 10 AS q FROM bar), y AS (SELECT *, CAST(least(requested, p, c, q) AS BIGINT) AS shares FROM x) SELECT symbol, idx, shares, CASE WHEN shares < requested THEN CASE WHEN p <= c AND p <= q THEN 'MAX_POSITION_WEIGHT' WHEN c <= q THEN 'MINIMUM_CASH_WEIGHT' ELSE 'VOLUME_PARTICIPATION' END END AS rule, CASE WHEN shares < requested THEN CASE WHEN shares = 0 THEN 'REJECT' ELSE 'RESIZE' END END AS action, CASE WHEN shares < requested THEN CAST(requested AS DOUBLE) END AS observed, CASE WHEN shares < requested THEN CASE WHEN p <= c AND p <= q THEN 0.05e0 WHEN c <= q THEN 0.97e0 ELSE 0.1e0 END END AS \"limit\" FROM y")
def _(v):
    r = v("bar").select("symbol", "idx", (F.col("volume") % 97 * 40).alias("requested"), (F.lit(2e7) + F.col("idx") * 1e5).alias("equity"), F.col("open").alias("price"), (F.col("volume") * 10).alias("volume"))
    return O.sized(r, lot=10, cash=0.97).select("symbol", "idx", "shares", "rule", "action", "observed", "limit")


@query("b36_fills", "WITH x AS (SELECT symbol, seq, side, shares, CAST(floor(shares * 8 * 0.1e0 / 100) * 100 AS BIGINT) AS room, CASE WHEN side = 'BUY' THEN CAST(floor(cash / price / 100) * 100 AS BIGINT) ELSE sellable END AS afford FROM order_row), f AS (SELECT *, greatest(0, least(shares, room, afford)) AS filled FROM x) SELECT symbol, seq, filled, CASE WHEN filled = shares THEN 'FILLED' WHEN filled > 0 THEN 'PARTIAL' ELSE 'PENDING' END AS state, CASE WHEN filled = shares THEN NULL WHEN room <= afford THEN 'VOLUME_CAPACITY' WHEN side = 'BUY' THEN 'INSUFFICIENT_CASH' ELSE 'T_PLUS_ONE' END AS reason FROM f")
def _(v):
    r = v("order_row").withColumnRenamed("shares", "requested").withColumn("volume", F.col("requested") * 8)
    return O.fills(r).select("symbol", "seq", F.col("filled").cast("bigint").alias("filled"), "state", "reason")


_EQ = "x AS (SELECT *, equity / lag(equity) OVER w - 1 AS r, equity / max(equity) OVER w - 1 AS dd FROM equity WINDOW w AS (PARTITION BY run ORDER BY idx)), g0 AS (SELECT run, max_by(equity, idx) / min_by(equity, idx) AS growth, count(r) AS n, coalesce(stddev_samp(r), 0) AS sd, avg(r) AS m, min(dd) AS mdd, avg(equity) AS average FROM x GROUP BY run), st AS (SELECT run, count(*) AS trades, sum(fee) AS fees, coalesce(count(*) FILTER (side = 'SELL' AND realized > 0) / nullif(count(*) FILTER (side = 'SELL'), 0), 0) AS win, sum(notional) AS notional, max(participation) AS participation, count(*) FILTER (state <> 'FILLED') AS pending FROM run_trade GROUP BY run), g AS (SELECT g0.*, growth - 1 AS tot, sd * sqrt(252) AS vol, CASE WHEN sd > 0 THEN m / sd * sqrt(252) ELSE 0 END AS sharpe, coalesce(trades, 0) AS trades, coalesce(fees, 0) AS fees, coalesce(win, 0) AS win, coalesce(notional, 0) AS notional, coalesce(participation, 0) AS participation, coalesce(pending, 0) AS pending FROM g0 LEFT JOIN st ON st.run = g0.run)"


@query("d30_equity_metrics", f"WITH {_EQ} SELECT run, round(tot, 8) AS total_return, round(pow(growth, 252e0 / greatest(n, 1)) - 1, 6) AS annual_return, round(vol, 8) AS volatility, round(sharpe, 8) AS sharpe, round(mdd, 8) AS max_drawdown, round(win, 8) AS win_rate, trades AS trade_count, round(fees, 4) AS total_fees FROM g")
def _(v):
    m = O.equity_metrics(v("equity"), v("run_trade"))
    return rounded(rounded(rounded(m, "total_return", "volatility", "sharpe", "max_drawdown", "win_rate"), "annual_return", n=6), "total_fees", n=4)


# the benchmark of every thirtieth session is missing, and one value isn't positive
_BENCH = "bm AS (SELECT idx, CASE WHEN idx = 41 THEN -close ELSE close END AS close FROM benchmark_bar WHERE idx % 30 <> 29), sp AS (SELECT run, min(idx) AS lo, max(idx) AS hi FROM equity GROUP BY run), vi AS (SELECT e.run, e.idx, CASE WHEN b.idx IS NULL THEN 'MISSING_BENCHMARK' ELSE 'BAD_BENCHMARK' END AS violation FROM equity e LEFT JOIN bm b ON b.idx = e.idx WHERE b.idx IS NULL OR b.close <= 0 UNION ALL SELECT sp.run, b.idx, 'MISSING_SESSION' FROM sp JOIN bm b ON b.idx BETWEEN lo AND hi WHERE NOT EXISTS (SELECT 1 FROM equity e WHERE e.run = sp.run AND e.idx = b.idx))"


def _benchmark(v):
    return v("benchmark_bar").filter("idx % 30 <> 29").withColumn("close", F.when(F.col("idx") == 41, -F.col("close")).otherwise(F.col("close")))


@query("d31_benchmark_violations", f"WITH {_BENCH} SELECT run, idx, violation FROM vi")
def _(v):
    return O.benchmark_violations(v("equity"), _benchmark(v))


def _metrics(v):
    from tidemark.operators.windows import drawdown

    cash = v("bar0").groupBy(F.col("symbol").alias("run")).agg(F.min_by("open", "idx").alias("cash"))
    return O.portfolio_metrics(v("equity"), v("benchmark_bar"), v("run_trade"), drawdown(v("equity")).filter("drawdown <= -0.2"), cash)


@query("d31_portfolio_metrics", f"WITH {_EQ}, {_BENCH.replace(' WHERE idx % 30 <> 29', '').replace('CASE WHEN idx = 41 THEN -close ELSE close END AS close', 'close')}, vn AS (SELECT run, count(*) AS violations FROM vi GROUP BY run), be AS (SELECT run, max_by(b.close, e.idx) / min_by(b.close, e.idx) - 1 AS b FROM equity e JOIN bm b ON b.idx = e.idx GROUP BY run), ca AS (SELECT q.run, max_by(q.equity, q.idx) / min_by(o.open, o.idx) - 1 AS net FROM equity q JOIN bar0 o ON o.symbol = q.run AND o.idx = q.idx GROUP BY q.run), en AS (SELECT run, count(*) AS events FROM x WHERE dd <= -0.2 GROUP BY run) SELECT g.run, round(net, 8) AS total, round(CASE WHEN violations IS NULL THEN b END, 8) AS bench, round(CASE WHEN violations IS NULL THEN net - b END, 8) AS excess, round(vol, 8) AS volatility, round(sharpe, 8) AS sharpe, round(mdd, 8) AS max_drawdown, round(notional / average, 6) AS turnover, round(fees, 4) AS total_fees, round(participation, 8) AS participation, pending, coalesce(events, 0) AS events, coalesce(violations, 0) AS violations FROM g JOIN ca ON ca.run = g.run LEFT JOIN vn ON vn.run = g.run LEFT JOIN be ON be.run = g.run LEFT JOIN en ON en.run = g.run")
def _(v):
    """A run begins with the price of its first trade; one with a gap in its sessions has violations, so no excess; a
    session 20 % below the peak is an event."""
    return rounded(rounded(rounded(_metrics(v).drop("annual"), "total", "bench", "excess", "volatility", "sharpe", "max_drawdown", "participation"), "turnover", n=6), "total_fees", n=4)


@query("d31_annual_metrics", "WITH sp AS (SELECT run, min(idx) AS lo, max(idx) AS hi, count(*) AS n FROM equity GROUP BY run), ok AS (SELECT run, n = (SELECT count(*) FROM benchmark_bar b WHERE b.idx BETWEEN lo AND hi) AS whole FROM sp), y AS (SELECT e.run, CAST(year(date) AS INTEGER) AS year, max_by(equity, e.idx) / min_by(equity, e.idx) - 1 AS p, max_by(b.close, e.idx) / min_by(b.close, e.idx) - 1 AS m FROM equity e JOIN benchmark_bar b ON b.idx = e.idx GROUP BY 1, 2) SELECT y.run, year, round(p, 8) AS portfolio, round(CASE WHEN whole THEN m END, 8) AS benchmark, round(CASE WHEN whole THEN p - m END, 8) AS excess FROM y JOIN ok ON ok.run = y.run")
def _(v):
    rows = _metrics(v).select("run", F.explode("annual").alias("y")).select("run", "y.*")
    return rounded(rows, "portfolio", "benchmark", "excess")


@query("d32_annual_segments", "SELECT run, CAST(year(date) AS INTEGER) AS year, round(min_by(equity, idx), 8) AS first, round(max_by(equity, idx), 8) AS last, round(max_by(equity, idx) / min_by(equity, idx) - 1, 8) AS annual FROM equity GROUP BY 1, 2")
def _(v):
    return rounded(O.annual_segments(v("equity"), F.year("date")), "first", "last", "annual")


@query("d21_compare_runs", "WITH x AS (SELECT *, equity / max(equity) OVER (PARTITION BY run ORDER BY idx) - 1 AS dd FROM equity), g AS (SELECT run, max_by(equity, idx) / min_by(equity, idx) - 1 AS total, min(dd) AS worst, min(CASE WHEN dd < -0.2 THEN idx END) AS h FROM x GROUP BY run) SELECT a.run AS a, a.run + 1 AS b, round(a.total, 8) AS total_a, round(a.worst, 8) AS worst_a, a.h AS first_halt_a, round(b.total, 8) AS total_b, round(b.worst, 8) AS worst_b, b.h AS first_halt_b, round(a.total - b.total, 8) AS gap FROM g a LEFT JOIN g b ON b.run = a.run + 1")
def _(v):
    """Every run beside the one after it."""
    pairs = v("equity").select(F.col("run").alias("a"), (F.col("run") + 1).alias("b")).distinct()
    return rounded(O.compare_runs(v("equity"), pairs), "total_a", "worst_a", "total_b", "worst_b", "gap")


@query("d33_breadth", "WITH x AS (SELECT idx, close - lag(close) OVER w AS c, close / first_value(close) OVER w AS k FROM bar WINDOW w AS (PARTITION BY symbol ORDER BY idx)) SELECT idx, count(*) FILTER (c > 0) AS advancing, count(*) FILTER (c < 0) AS declining, count(*) FILTER (c = 0) AS unchanged, round(avg(k) * 100, 6) AS curve FROM x GROUP BY idx")
def _(v):
    return rounded(O.breadth(v("bar")), "curve", n=6)


@query("c26_overlap", f"WITH {_TOP}, m AS (SELECT idx, symbol, row_number() OVER (PARTITION BY idx ORDER BY close DESC, symbol) AS k FROM bar), b AS (SELECT * FROM m WHERE k <= 20) SELECT idx, round(count(CASE WHEN n.symbol IS NOT NULL AND b.symbol IS NOT NULL THEN 1 END) / greatest(count(n.symbol), count(b.symbol)), 8) AS overlap FROM n FULL JOIN b USING (idx, symbol) GROUP BY idx")
def _(v):
    other = O.top_n(v("bar").select("idx", "symbol", F.col("close").alias("score")), 20)
    return rounded(O.overlap(O.top_n(v("score"), 30), other), "overlap")


@query("c24_aligned", "WITH s AS (SELECT idx FROM calendar WHERE idx % 7 > 0), b AS (SELECT idx FROM benchmark_bar WHERE idx % 11 > 0) SELECT coalesce(s.idx, b.idx) AS idx, CASE WHEN b.idx IS NULL THEN 'MISSING_BENCHMARK' ELSE 'UNKNOWN_SESSION' END AS violation FROM s FULL JOIN b ON s.idx = b.idx WHERE s.idx IS NULL OR b.idx IS NULL")
def _(v):
    return O.aligned(v("benchmark_bar").filter("idx % 11 > 0"), v("calendar").filter("idx % 7 > 0"))


@query("c25_session_bars", "SELECT idx, count(*) AS bars, count(*) FILTER (suspended) AS suspended, count(*) - count(DISTINCT symbol) AS duplicates FROM bar WHERE symbol IN (SELECT symbol FROM target WHERE target_w > 0.02) GROUP BY idx")
def _(v):
    return O.session_bars(v("bar"), v("target").filter("target_w > 0.02"))


@query("b35_promotion", f"WITH {_EQ}, s AS (SELECT run, tot, mdd, win FROM g), l AS (SELECT run AS candidate, 'total_return' AS gate, tot AS observed, 0e0 AS requirement, tot >= 0 AS passed FROM s UNION ALL SELECT run, 'max_drawdown', mdd, -0.9e0, mdd >= -0.9 FROM s UNION ALL SELECT run, 'win_rate', win, 0.6e0, win <= 0.6 FROM s) SELECT candidate, gate, round(observed, 8) AS observed, requirement, passed, bool_and(passed) OVER (PARTITION BY candidate) AS decision FROM l")
def _(v):
    m = O.equity_metrics(v("equity"), v("run_trade")).withColumnRenamed("run", "candidate")
    return rounded(O.promotion(m, {"total_return": (">=", 0.0), "max_drawdown": (">=", -0.9), "win_rate": ("<=", 0.6)}), "observed")
