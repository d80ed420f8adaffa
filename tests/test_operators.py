"""Operators on cases worked by hand."""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evidence, factors, models, pit, portfolios, windows
from tidemark.sources import stores


def bars(spark, closes, symbol=1, start=0):
    return spark.createDataFrame([(symbol, start + i, float(c), float(c), 1.0, 100, 1000.0) for i, c in enumerate(closes)], "symbol int, idx int, open double, close double, adj double, volume int, amount double")


def values(df, column="value", order="idx"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_momentum_of_constant_growth(spark):
    got = values(windows.momentum(bars(spark, [10 * 1.01**i for i in range(30)]), 20))
    assert got[:20] == [None] * 20
    assert got[-1] == pytest.approx(1.01**20 - 1, rel=1e-12)


def test_volatility_of_constant_growth_is_zero(spark):
    assert values(windows.volatility(bars(spark, [10 * 1.01**i for i in range(10)]), 5))[-1] == pytest.approx(0, abs=1e-12)


def test_gap_gives_null(spark):
    b = bars(spark, range(1, 13)).filter("idx <> 6")
    got = dict(windows.momentum(b, 3).select("idx", "value").collect())
    assert got[7] is None and got[9] is None and got[10] == pytest.approx(11 / 8 - 1)


def test_rolling_drawdown_starts_anew(spark):
    assert values(windows.rolling_drawdown(bars(spark, [10, 5, 6, 6, 6]), 3))[2:] == pytest.approx([-0.5, 0.0, 0.0])


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, 3.0)], "d int, v double")
    assert sorted(values(windows.average_rank(df, "v", ["d"]), "rank", "v")) == [1.0, 2.5, 2.5, 4.0]


def test_percentile_of_one_row(spark):
    assert values(windows.percentile_rank(spark.createDataFrame([(1, 5.0)], "d int, v double"), "v", ["d"]), "target", "v") == [0.5]


def test_walk_forward_has_gaps(spark):
    folds = windows.walk_forward(spark.range(30).withColumnRenamed("id", "idx"), 10, 5, 5, 5, purge=2, embargo=2)
    got = {(r.fold, r.role): (r.lo, r.hi) for r in folds.groupBy("fold", "role").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).collect()}
    assert len({f for f, _ in got}) == 2
    assert got[0, "train"] == (0, 9) and got[0, "validation"] == (12, 16) and got[0, "test"] == (19, 23)


def test_false_discovery(spark):
    df = spark.createDataFrame([("a", 0.04), ("b", 0.01), ("c", 0.5)], "trial_id string, p_value double")
    assert values(factors.false_discovery(df), "q_value", "trial_id") == pytest.approx([0.06, 0.03, 0.5])


def test_two_sided_p(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5, 1.96), ("b", 0.0, 0.0, None), ("c", 0.1, 0.0, None)], "feature_id string, oriented_ic double, sd double, z double")
    assert values(factors.with_p(df), "p_value", "feature_id") == pytest.approx([math.erfc(1.96 / math.sqrt(2)), 1.0, 0.0])


def test_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(factors.guarded_corr("a", "b").alias("c")).first().c is None


def trials(spark, rejected=()):
    return spark.createDataFrame([(f, k, k, f in rejected) for k, f in enumerate("abc", 1)], "feature_id string, simplicity int, place int, rejected boolean")


def test_redundant_factor_goes_once(spark):
    pairs = spark.createDataFrame([("m", "a", "b", 0.9), ("m", "b", "c", 0.95), ("m", "a", "c", 0.5)], "family string, a string, b string, correlation double")
    assert [(r.dropped, r.kept) for r in factors.drop_redundant(pairs, trials(spark)).collect()] == [("b", "a")]


def test_a_rejected_factor_knocks_none_out(spark):
    pairs = spark.createDataFrame([("m", "a", "b", 0.95), ("m", "b", "c", 0.95)], "family string, a string, b string, correlation double")
    assert [(r.dropped, r.kept) for r in factors.drop_redundant(pairs, trials(spark, ["a"])).collect()] == [("c", "b")]


def panel(spark):
    """Four sessions of ten symbols; the label falls with the value, and one value is infinite."""
    rows = []
    for idx in range(4):
        for k in range(1, 11):
            value = float("inf") if (idx, k) == (3, 10) else float(k if idx % 2 == 0 else 11 - k)
            rows.append((k, idx, "f", value, -value / 100 + (0.001 if k % 2 else -0.001), math.log(k), "BANK" if k <= 5 else "TECH", "BULL" if idx < 2 else "BEAR"))
    return spark.createDataFrame(rows, "symbol int, idx int, feature_id string, value double, label double, size double, industry string, regime string")


def test_infinities_are_not_finite(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, -2.0, float("inf"), float("-inf"), float("nan"), None)], "x double")
    assert [r.f for r in df.select(factors.finite("x").alias("f")).collect()] == [True, True, False, False, False, False]
    r = factors.coverage(panel(spark).withColumn("label", F.abs("label"))).first()
    assert (r.total, r.valid, r.missing_feature) == (40, 39, 1)


def test_spread_pays_for_turnover_of_oriented_values(spark):
    p = factors.oriented(panel(spark).filter("value < 100"), {"f": -1.0})
    r = factors.quintile_report(p, 0.01).first()
    assert r.gross > 0 and r.monotone == 1.0 and r.turnover == 1.0  # the top changes at each session
    assert r.spread == pytest.approx(r.gross - 0.01)


def test_diagnostics_equal_each_operator_alone(spark):
    """Ties, nulls, NaN, infinities, missing sessions, industries of one symbol and of none."""
    rng = np.random.default_rng(5)

    def odd(x):
        return [None, float("nan"), float("inf")][int(rng.integers(3))] if rng.random() < 0.1 else float(x)

    rows = [
        (s, d, f, odd(rng.integers(0, 9)), odd(rng.integers(-4, 5) / 8), odd(rng.random()), None if s == 3 else s % 4, ["A", "B", None][d % 3])
        for f in ("f", "g", "h") for s in range(40) for d in range(9) if rng.random() < 0.8 and (f, d) != ("g", 4)
    ]
    p = spark.createDataFrame(rows, "symbol int, idx int, feature_id string, value double, label double, size double, industry int, regime string")
    got = {r.feature_id: r for r in factors.diagnostics(p, F.floor(F.col("idx") / 3), {"f": -1.0}, 3).collect()}
    turned = factors.oriented(p, {"f": -1.0})
    valid = turned.filter(factors.finite("value", "label"))
    daily = factors.daily_rank_ic(turned, least=3)
    prior = factors.prior_rank_correlation(valid).groupBy("feature_id").agg(F.avg("autocorrelation").alias("autocorrelation"))
    alone = [factors.ic_summary(daily).drop("mean_ic", "icir", "z"), factors.coverage(turned), factors.quintile_report(turned), prior, factors.size_exposure(valid)]
    for part in alone:
        for r in part.collect():
            for name, x in r.asDict().items():
                assert got[r.feature_id][name] == (pytest.approx(x, rel=1e-12, abs=1e-12) if isinstance(x, float) else x), name
    regimes = daily.join(valid.select("feature_id", "idx", "regime").distinct(), ["feature_id", "idx"])
    segments = {"years": factors.ic_segments(daily, F.floor(F.col("idx") / 3), "k"), "regimes": factors.ic_segments(regimes, F.col("regime"), "k"), "industrys": factors.industry_segments(turned.filter("industry is not null"), 3).withColumnRenamed("industry", "k")}
    for name, part in segments.items():
        want = {(r.feature_id, None if r.k is None else str(r.k)): (r.observations, pytest.approx(r.mean_ic, abs=1e-12)) for r in part.collect()}
        assert {(f, x.segment): (x.observations, x.mean_ic) for f, r in got.items() for x in r[name]} == want


def test_diagnostics_read_the_panel_once(spark):
    p = spark.range(40).selectExpr("id as symbol", "id % 3 as idx", "'f' as feature_id", "1d * id as value", "1d * id as label", "1d * id as size", "id % 2 as industry", "'A' as regime")
    plan = factors.session_statistics(factors.ranked_panel(p))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 40") == 1 and plan.count("Exchange") == 3


def test_diagnostics_and_decision(spark):
    t = spark.createDataFrame([("f", "m", 1, 1)], "feature_id string, family string, simplicity int, place int")
    r = factors.factor_report(panel(spark), t, F.floor(F.col("idx") / 2), {"f": -1.0}).first()
    assert (r.total, r.valid, r.missing_feature) == (40, 39, 1) and r.coverage == 39 / 40
    assert r.mean_ic == pytest.approx(-r.oriented_ic) and r.oriented_ic > 0.9 and r.positive == 1.0
    assert r.autocorrelation < -0.9 and [y.segment for y in r.years] == ["0", "1"] and r.worst_year in ("0", "1")
    assert [x.segment for x in r.regimes] == ["BEAR", "BULL"] and {x.segment for x in r.industrys} == {"BANK", "TECH"}
    assert (r.decision, r.reasons, r.selected) == ("CANDIDATE", "", True)
    assert factors.factor_report(panel(spark), t, F.floor(F.col("idx") / 2)).first().decision == "REJECTED"


def test_as_of_prefers_newer_period_then_revision(spark):
    v = spark.createDataFrame([(1, 10, 1, False, 1, 8.0), (1, 20, 1, True, 2, 9.0), (1, 15, 2, False, 3, 10.0)], "symbol int, available int, report_period int, update_flag boolean, event_id int, metric double")
    k = spark.createDataFrame([(1, 5), (1, 10), (1, 16), (1, 30)], "symbol int, day int")
    assert values(pit.as_of(v, k, ["report_period", "available", "update_flag", "event_id"], ["metric"]), "metric", "day") == [None, 8.0, 10.0, 10.0]


def test_relisting_starts_a_new_spell(spark):
    e = spark.createDataFrame([(1, "LISTED", 0, 0, None, 1), (1, "DELISTED", 10, 10, None, 2), (1, "LISTED", 20, 20, None, 3)], "symbol int, kind string, effective int, available int, is_st boolean, event_id int")
    d = spark.createDataFrame([(1, -1), (1, 5), (1, 15), (1, 25)], "symbol int, day int")
    rows = pit.replay_state(e, d).orderBy("day").collect()
    assert [(r.listed_at, r.delisted) for r in rows] == [(None, False), (0, False), (0, True), (20, False)]


def test_round14(spark):
    rng = np.random.default_rng(2)
    x = [1 / 3, -12345.678901234567, 0.0, 899.840459770115, -899.840459770115, 1.00000000000005, 5e-320, 1e300, 0.1, 100.0]
    x += [round(float(v), 14 - int(np.floor(np.log10(v))) - 1) + 5 * 10.0 ** (int(np.floor(np.log10(v))) - 14) for v in 10 ** rng.uniform(-7, 12, 400)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    assert [r.y for r in df.select(pit.round14("x").alias("y")).collect()] == [float(f"{v:.13e}") for v in x]


def test_intervals_meet_as_all_pairs_do(spark):
    rng = np.random.default_rng(3)

    def rows(n):
        out = [(int(rng.integers(3)), int(rng.integers(60)), int(rng.integers(12))) for _ in range(n)]
        return [(k, s, None if e == 0 else s + e - 2) for k, s, e in out]

    a, b = rows(60), rows(60)
    df = [spark.createDataFrame(x, "k int, start int, end int") for x in (a, b)]
    far = 10**9
    want = sorted((k, str(s), str(e), str(t), str(f)) for k, s, e in a for j, t, f in b if k == j and s < (far if f is None else f) and t < (far if e is None else e))
    got = sorted((r.k, str(r.a_start), str(r.a_end), str(r.b_start), str(r.b_end)) for r in pit.overlapping(*df, "k").collect())
    assert got == want
    assert pit.overlapping(df[0].limit(0), df[1].limit(0), "k").count() == 0


def test_open_and_very_long_intervals_are_few_nodes(spark):
    a = [(1, 0, None), (1, 10**9, None), (1, 5, 10**9 + 7), (2, 3, 4), (2, -(10**8), None)]
    b = [(1, 10**9 + 6, 10**9 + 7), (1, -(10**6), 1), (2, 3, 3), (1, 999, 1000)]
    df = [spark.createDataFrame(x, "k int, start bigint, end bigint") for x in (a, b)]
    out = pit.overlapping(*df, "k")
    far = 10**12
    want = sorted(repr((k, s, e, t, f)) for k, s, e in a for j, t, f in b if k == j and s < (far if f is None else f) and t < (far if e is None else e))
    assert sorted(repr((r.k, r.a_start, r.a_end, r.b_start, r.b_end)) for r in out.collect()) == want
    lo, hi = F.col("lo"), F.col("hi")
    cases = [(3, 4), (0, 2**40), (1, 2**40 - 1), (5, 5), (7, 3), (0, 0), (2**39 + 1, 2**40), (12345, 987654321)]
    for r in spark.createDataFrame(cases, "lo bigint, hi bigint").select("lo", "hi", pit._cover(lo, hi, F.lit(40)).alias("n")).collect():
        assert len(r.n) <= 80
        parts = sorted((int(x.node) << x.level, (int(x.node) + 1) << x.level) for x in r.n)
        assert sum(e - s for s, e in parts) == max(0, r.hi - r.lo)
        assert all(r.lo <= s and e <= r.hi for s, e in parts) and all(x[1] <= y[0] for x, y in zip(parts[:-1], parts[1:], strict=True))


def test_exact_quantiles_are_those_of_whole_groups(spark):
    from tidemark.operators.quantiles import between, exact_quantiles

    rng = np.random.default_rng(6)
    groups = {
        "normal": rng.normal(size=20_000), "ties": rng.integers(0, 5, 9000).astype(float), "same": np.full(5000, 3.5), "one": np.array([7.0]), "two": np.array([1.0, 2.0]),
        "skewed": np.exp(rng.normal(size=7000) * 4), "odd": rng.normal(size=101), None: np.arange(1000.0),
    }
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("none", None), ("none", None), ("normal", None)]
    shares = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    out = exact_quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x", shares, accuracy=100)
    got = {r.g: r for r in out.select("g", "n", *[between(F.col("q")[i]).alias(f"q{i}") for i in range(len(shares))]).collect()}
    assert got.pop("none").asDict() == {"g": "none", "n": 0, **{f"q{i}": None for i in range(6)}}
    assert set(got) == set(groups)
    for g, r in got.items():
        assert r.n == len(groups[g]) and [r[f"q{i}"] for i in range(6)] == pytest.approx(np.quantile(groups[g], shares).tolist(), rel=1e-12)
    assert exact_quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", shares).count() == 0


def test_rows_are_numbered_across_parts(spark):
    """A huge group, many small ones, nulls, ties; nothing is broadcast."""
    rows = [("big", i * 7919 % 5000) for i in range(5000)] + [(f"g{i}", -i) for i in range(3000)] + [("tied", 3)] * 9 + [(None, 5), (None, None), (None, 4)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = windows.numbered(spark.createDataFrame(rows, "g string, k bigint"), ["g"], ["k"])
        got = df.collect()
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == len(rows)
    own: dict = {}
    for r in got:
        own.setdefault(r.g, []).append((r.n, r.k))
    for g, places in own.items():
        places.sort()
        assert [n for n, _ in places] == list(range(len(places)))
        keys = [k for _, k in places]
        assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)), g


def test_fold_bounds(spark):
    f = spark.createDataFrame([(1, i, "a", v) for i, v in enumerate([0.0, 2.0, 2.0, 98.0])] + [(1, 9, "a", 1e9)], "symbol int, idx int, feature_id string, value double")
    folds = spark.createDataFrame([(0, i, "train") for i in range(4)] + [(0, 9, "test")], "fold int, idx int, role string")
    r = models.fit_bounds(f, folds).first()
    assert (r.low, r.high, r.median) == pytest.approx((np.quantile([0, 2, 2, 98], 0.01), np.quantile([0, 2, 2, 98], 0.99), 2.0))


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = 0.7 * x[:, 0] - 0.2 * x[:, 1] + 3
    df = spark.createDataFrame([(1, i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "symbol int, idx int, a double, b double, label double")
    folds = spark.createDataFrame([(0, i, "train") for i in range(60)], "fold int, idx int, role string")
    got = {r.feature_id: r.coefficient for r in models.ridge(df, folds, ["a", "b"], alphas=(10.0,)).collect()}
    c = x - x.mean(0)
    w = np.linalg.solve(c.T @ c + 10 * np.eye(2), c.T @ (y - y.mean()))
    assert (got["a"], got["b"], got["intercept"]) == pytest.approx((*w, y.mean() - x.mean(0) @ w))


ORDER = "symbol int, seq int, day int, side string, shares int, price double"


def test_fifo_takes_the_oldest_lot_of_an_earlier_day(spark):
    o = spark.createDataFrame([(1, 1, 1, "BUY", 100, 1.0), (1, 2, 2, "BUY", 100, 2.0), (1, 3, 3, "SELL", 150, 9.0)], ORDER)
    assert sorted((r.buy_seq, r.matched) for r in windows.fifo(o).collect()) == [(1, 100), (2, 50)]


def test_fifo_leaves_a_lot_of_the_same_day(spark):
    o = spark.createDataFrame([(1, 1, 1, "BUY", 100, 1.0), (1, 2, 1, "SELL", 100, 2.0), (1, 3, 2, "SELL", 100, 9.0)], ORDER)
    assert [(r.sell_seq, r.buy_seq, r.matched) for r in windows.fifo(o).collect()] == [(3, 1, 100)]


@pytest.mark.parametrize("seed", range(4))
def test_fifo_follows_the_ledger(spark, seed):
    rng = np.random.default_rng(seed)
    rows, day = [], 0
    for seq in range(120):
        day += int(rng.integers(2))
        rows.append((seq % 3, seq, day, "BUY" if rng.random() < 0.5 else "SELL", int(rng.integers(1, 9)) * 10, 1.0))
    want = []
    for symbol in range(3):
        lots = []
        for _, seq, day, side, n, _ in (r for r in rows if r[0] == symbol):
            if side == "BUY":
                lots.append([seq, day, n])
                continue
            for lot in lots:
                k = min(n, lot[2]) if lot[1] < day else 0
                if k:
                    want.append((symbol, seq, lot[0], k))
                    lot[2] -= k
                    n -= k
    got = windows.fifo(spark.createDataFrame(rows, ORDER)).collect()
    assert sorted((r.symbol, r.sell_seq, r.buy_seq, r.matched) for r in got) == sorted(want)


def test_sizes_name_the_rule_that_binds(spark):
    rows = spark.createDataFrame([(1, 1000, 1e6, 10.0, 1_000_000), (2, 9000, 1e6, 10.0, 1_000_000), (3, 9000, 1e6, 10.0, 900), (4, 900, 1e3, 10.0, 10_000)], "k int, requested int, equity double, price double, volume int")
    got = {r.k: (r.shares, r.rule, r.action, r.observed, r.limit) for r in portfolios.sized(rows).collect()}
    assert got == {1: (1000, None, None, None, None), 2: (5000, "MAX_POSITION_WEIGHT", "RESIZE", 9000.0, 0.05), 3: (0, "VOLUME_PARTICIPATION", "REJECT", 9000.0, 0.1), 4: (0, "MAX_POSITION_WEIGHT", "REJECT", 900.0, 0.05)}


def test_metrics_count_trades_and_missing_benchmarks(spark):
    equity = spark.createDataFrame([(1, i, e, date(2020 + i // 2, 1, 1 + i)) for i, e in enumerate([100.0, 110.0, 99.0, 120.0])] + [(2, 0, 5.0, date(2020, 1, 1))], "run int, idx int, equity double, date date")
    trades = spark.createDataFrame([(1, "BUY", None, 1.0), (1, "SELL", 5.0, 2.0), (1, "SELL", -1.0, 0.5)], "run int, side string, realized double, fee double")
    m = {r.run: r for r in portfolios.equity_metrics(equity, trades).collect()}
    r = np.diff([100, 110, 99, 120]) / np.array([100, 110, 99])
    assert (m[1].win_rate, m[1].trade_count, m[1].total_fees) == (0.5, 3, 3.5) and m[1].volatility == pytest.approx(r.std(ddof=1) * math.sqrt(252))
    assert m[1].max_drawdown == pytest.approx(-0.1) and (m[2].trade_count, m[2].total_return, m[2].sharpe) == (0, 0.0, 0.0)
    bench = spark.createDataFrame([(0, 10.0), (1, 11.0), (3, 12.0)], "idx int, close double")
    assert [tuple(x) for x in portfolios.benchmark_violations(equity, bench).collect()] == [(1, 2, "MISSING_BENCHMARK")]
    orders = spark.createDataFrame([(1, 50.0, 1.0, 0.2, "FILLED"), (1, 50.0, 1.0, 0.4, "PENDING")], "run int, notional double, fee double, participation double, state string")
    p = {x.run: x for x in portfolios.portfolio_metrics(equity, bench, orders, equity.filter("equity < 100"), spark.createDataFrame([(1, 125.0), (2, 5.0)], "run int, cash double")).collect()}
    assert (p[1].violations, p[1].excess, p[1].pending, p[1].participation, p[1].events) == (1, None, 1, 0.4, 1)
    assert p[1].turnover == pytest.approx(100 / np.mean([100, 110, 99, 120])) and (p[2].violations, p[2].excess) == (0, 0.0)
    assert p[1].total == pytest.approx(120 / 125 - 1)  # what the first session cost counts
    assert [(y.year, y.portfolio, y.benchmark) for y in p[1].annual] == [(2020, pytest.approx(0.1), None), (2021, pytest.approx(120 / 99 - 1), None)]
    whole = spark.createDataFrame([(i, 10.0 + i) for i in range(4)], "idx int, close double")
    q = {x.run: x for x in portfolios.portfolio_metrics(equity, whole, orders, equity.limit(0), spark.createDataFrame([(1, 125.0)], "run int, cash double")).collect()}
    assert q[1].excess == pytest.approx(120 / 125 - 13 / 10) and q[2].total is None
    assert [y.excess for y in q[1].annual] == pytest.approx([0.1 - 0.1, 120 / 99 - 13 / 12])


def test_unknown_industry_blocks_though_no_weight_changes(spark):
    t = spark.createDataFrame([(1, 1, 0.03, 0.0, 1.0, 10.0, 10_000_000, None, True), (1, 2, 0.08, 0.0, 2.0, 10.0, 10_000_000, "X", True), (1, 3, 0.03, 0.0, 0.5, 10.0, 10_000_000, "X", False)], "idx int, symbol int, target_w double, current_w double, score double, price double, volume int, industry string, eligible boolean")
    got = {(r.symbol, r.rule): (r.action, r.observed, r.limit) for r in portfolios.risk_events(portfolios.rule_chain(t, 1e6), 1e6).collect()}
    assert got[None, "INDUSTRY_EXPOSURE_UNAVAILABLE"] == ("BLOCK_VALIDATION", 1.0, 0.0)
    assert got[2, "MAX_POSITION_WEIGHT"] == ("RESIZE", 0.08, 0.05)
    assert got[3, "NEW_RISK_INELIGIBLE"] == ("REJECT", 0.03, 0.0)
    assert set(got) == {(None, "INDUSTRY_EXPOSURE_UNAVAILABLE"), (2, "MAX_POSITION_WEIGHT"), (3, "NEW_RISK_INELIGIBLE")}


def test_training_chooses_on_validation_and_scores_test_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 2))
    y = 0.7 * x[:, 0] - 0.2 * x[:, 1] + rng.normal(size=90) * 0.5
    df = spark.createDataFrame([(1, i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))] + [(1, 5, float("inf"), 0.0, 1.0)], "symbol int, idx int, a double, b double, label double")
    folds = spark.createDataFrame([(f, i, "train" if i < 30 + 20 * f else "validation" if i < 40 + 20 * f else "test") for f in (0, 1) for i in range(50 + 20 * f)], "fold int, idx int, role string")
    got = models.train(df, folds, ["a", "b"])

    def fit(n, alpha):
        c = x[:n] - x[:n].mean(0)
        w = np.linalg.solve(c.T @ c + alpha * np.eye(2), c.T @ (y[:n] - y[:n].mean()))
        return w, y[:n].mean() - x[:n].mean(0) @ w

    loss = {a: np.mean([np.mean((y[n : n + 10] - x[n : n + 10] @ fit(n, a)[0] - fit(n, a)[1]) ** 2) for n in (30, 50)]) for a in (0.1, 1.0, 10.0, 100.0)}
    best = min(loss, key=lambda a: (loss[a], a))
    assert got.alpha.first().alpha == best
    for r in got.predictions.collect():
        w, b = fit(30 + 20 * r.fold, best)
        assert r.prediction == pytest.approx(x[r.idx] @ w + b)
    assert got.predictions.count() == 20 and got.test.count() == 2
    n_fit = lambda f: 30 + 20 * f
    for r in got.validation.collect():
        w, b = fit(n_fit(r.fold), r.alpha)
        rows = slice(n_fit(r.fold), n_fit(r.fold) + 10)
        assert r.n == 10 and r.loss == pytest.approx(np.mean((y[rows] - x[rows] @ w - b) ** 2))
    for part in (got.validation, got.alpha, got.coefficients, got.test):  # all from the sums of one scan
        assert "Scan ExistingRDD[symbol" not in part._jdf.queryExecution().toString()
    frame, wrong = models.evaluation_frame(got.predictions.filter("idx <> 41"), got.predictions, ["fold", "symbol", "idx"])
    assert frame.columns == ["fold", "symbol", "idx", "prediction", "label"]
    assert [(r.idx, r.violation) for r in wrong.collect()] == [(41, "MISSING")]


def test_development_ends(spark):
    rows = spark.range(10).withColumnRenamed("id", "idx")
    assert models.development_rows(rows, 5).count() == 6 and models.development_rows(rows, 5, asked=2).count() == 3
    with pytest.raises(ValueError, match="sealed"):
        models.development_rows(rows, 5, asked=6)


def test_costs_have_a_least(spark):
    r = portfolios.costs(spark.createDataFrame([(1000.0, "SELL")], "notional double, side string")).first()
    assert (r.commission, r.stamp_duty) == (5.0, 0.5)


def test_quotas_fill_all_seats(spark):
    s = spark.createDataFrame([("a", 70), ("b", 20), ("c", 1)], "stratum string, n bigint")
    q = dict(portfolios.quotas(s, 30).select("stratum", "quota").collect())
    assert sum(q.values()) == 30 and min(q.values()) >= 1


def test_artifact_is_written_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    path = stores.publish(df, str(tmp_path))
    assert stores.publish(df.orderBy("b"), str(tmp_path)) == path and len(list((tmp_path / "data").iterdir())) == 1
    assert stores.publish(df.limit(1), str(tmp_path)) != path
    assert stores.read_verified(spark, path, df.schema, ["a"]).count() == 2
    with pytest.raises(ValueError, match="nulls"):
        stores.read_verified(spark, path, df.schema, ["b"])
    with pytest.raises(ValueError, match="schema"):
        stores.read_verified(spark, path, df.select("b", "a").schema, ["a"])
    spark.createDataFrame([(3, "y")], "a int, b string").write.mode("append").parquet(f"{tmp_path}/{json.loads(Path(path).read_text())['folder']}")
    with pytest.raises(ValueError, match="content"):
        stores.read_verified(spark, path, df.schema, ["a"])
    with pytest.raises(ValueError, match="content"):
        stores.publish(df, str(tmp_path))


def test_publishers_at_once_leave_one_table(spark, tmp_path):
    """Three threads publish one content, by partition; the rows are computed once for each, while they are written."""
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    df = spark.range(100).selectExpr("id", "id % 3 as g").mapInArrow(counted, "id long, g long")
    with ThreadPoolExecutor(3) as pool:
        paths = set(pool.map(lambda _: stores.publish(df, str(tmp_path), "g"), range(3)))
    assert len(paths) == 1 and len(list((tmp_path / "data").iterdir())) == 1 and runs.value == 300
    (path,) = paths
    back = stores.read_verified(spark, path, df.schema, ["id", "g"])
    assert back.columns == ["id", "g"] and back.count() == 100
    assert stores.publish(df.limit(0), str(tmp_path)) not in paths


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "w"), (None, "u")], "k int, v string")
    path = str(tmp_path / "t")
    table = stores.KeyedTable(spark, path, "k")
    assert table.read(df.schema).count() == 0
    assert stores.append_unseen(df, path, "k") == 3
    assert stores.append_unseen(df.unionAll(spark.createDataFrame([(3, "z")], "k int, v string")), path, "k") == 1
    assert stores.append_unseen(df, path, "k") == 0 and stores.append_unseen(df.limit(0), path, "k") == 0
    assert sorted(r.k or 0 for r in table.read(df.schema).collect()) == [0, 1, 2, 3] and table.read(df.schema).columns == ["k", "v"]


def test_new_keys_read_no_old_file(spark, tmp_path):
    """Keys outside all ranges and keys between stored ones; stored ones are found in every append."""
    table = stores.KeyedTable(spark, str(tmp_path / "t"), "k")
    for batch in range(3):
        assert table.append(spark.range(2000).selectExpr(f"id * 30 + {batch} as k", "'v' as v")) == 2000
    own = table.appends()
    assert table.may_hold(spark.range(500).selectExpr("id + 1000000 as k"), own) == []
    # one in 4,000 passes a filter, so of 30 keys between the stored ones hardly any file is read
    assert len(table.may_hold(spark.range(30).selectExpr("id * 30 + 17 as k"), own)) <= 1
    for batch in range(3):
        held = table.may_hold(spark.range(2000).selectExpr(f"id * 30 + {batch} as k"), own)
        assert {h for h in held if own[batch].name in h} == {f"data/_append={own[batch].name}/_bucket={b}" for b in range(stores.BUCKETS)}
    assert table.append(spark.range(60).selectExpr("id as k", "'v' as v")) == 54


def test_writers_at_once_leave_each_key_once(spark, tmp_path):
    path = str(tmp_path / "t")
    with ThreadPoolExecutor(3) as pool:
        added = list(pool.map(lambda i: stores.append_unseen(spark.range(40 * i, 40 * i + 100).selectExpr("id as k", f"{i} as writer"), path, "k"), range(3)))
    rows = stores.KeyedTable(spark, path, "k").read().collect()
    assert sum(added) == len(rows) == 180 == len({r.k for r in rows})


def test_stream_ingest_appends_once(spark, tmp_path):
    from tidemark.streaming.ingest import ingest

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1,), (1,), (2,)], "k int").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(source)
    stream = spark.readStream.schema("k int, ts timestamp").parquet(source)
    ingest(stream, target, "k", str(tmp_path / "c1")).awaitTermination(60)
    ingest(stream, target, "k", str(tmp_path / "c2")).awaitTermination(60)
    assert stores.KeyedTable(spark, target, "k").read().count() == 2


def test_stream_ingest_keeps_late_unseen_keys(spark, tmp_path):
    from tidemark.streaming.ingest import ingest

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, "2024-01-10"), (2, "2024-01-10")], [(2, "2024-01-10"), (3, "2024-01-12")], [(4, "2023-06-01"), (4, "2023-06-01")]):
        spark.createDataFrame(rows, "k int, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k int, ts timestamp").parquet(source)
        ingest(stream, target, "k", str(tmp_path / "c")).awaitTermination(60)
    assert sorted(r.k for r in stores.KeyedTable(spark, target, "k").read().collect()) == [1, 2, 3, 4]


def test_replay_check_names_what_is_wrong(spark):
    rows = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0)], "snapshot_id int, row_ordinal int")
    m = spark.createDataFrame([(1, 2, "ACCEPTED"), (2, 3, "ACCEPTED"), (3, 0, "REJECTED")], "snapshot_id int, expected int, status string")
    assert dict(evidence.replay_violations(rows, m).collect()) == {2: "ROW_COUNT,ORDINALS", 3: "NOT_ACCEPTED"}


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        ("denominator", [None, "MISSING_TRADING_SESSION", "INSUFFICIENT_HISTORY", "SOURCE_VALUE_MISSING", "NON_POSITIVE_DENOMINATOR"]),
        ("mean", [None, "MISSING_TRADING_SESSION", "INSUFFICIENT_HISTORY", "SOURCE_VALUE_MISSING", "SOURCE_VALUE_MISSING"]),
        ("amount", [None, "MISSING_TRADING_SESSION", "INSUFFICIENT_HISTORY", "NON_POSITIVE_AMOUNT", "NON_POSITIVE_AMOUNT"]),
        ("share", [None, "MISSING_TRADING_SESSION", "INSUFFICIENT_HISTORY", "SOURCE_VALUE_MISSING", "SOURCE_VALUE_INVALID"]),
        ("other", [None, "MISSING_TRADING_SESSION", "INSUFFICIENT_HISTORY", "SOURCE_VALUE_INVALID", "SOURCE_VALUE_INVALID"]),
    ],
)
def test_null_reasons_have_an_order(spark, rule, want):
    rows = [(1, 9, 2, 0.5, 2.0), (2, 9, 2, None, 2.0), (3, 2, 2, None, None), (4, 9, 3, None, None), (5, 9, 3, None, -2.0)]
    df = spark.createDataFrame([(1, *r) for r in rows], "symbol int, idx int, calendar_sessions int, present int, f double, source double")
    wide = df.withColumn("why", pit.null_reasons(df, 3, F.col("f"), F.col("source"), rule))
    got = windows.factor_rows(df.select("symbol", "idx"), wide, ["f"], {"f": "why"})
    assert values(got, "null_reason") == want


@pytest.mark.parametrize("n", [1, 2, 5, 12, 40])
def test_rolling_drawdown_and_median_of_every_window(spark, n, monkeypatch):
    monkeypatch.setattr(windows, "SLICE", 30)
    rng = np.random.default_rng(n)
    rows = []
    for symbol, size in ((1, 130), (2, n), (3, 3)):
        idx = np.cumsum(rng.choice([1, 1, 1, 1, 1, 1, 1, 1, 1, 2], size)) if symbol == 1 else np.arange(size)
        rows += [(symbol, int(i), float(p), 1.0, None if symbol == 1 and k % 50 == 49 else int(rng.integers(1, 9))) for k, (i, p) in enumerate(zip(idx, np.exp(rng.normal(size=size)), strict=True))]
    df = spark.createDataFrame(rows, "symbol int, idx int, close double, adj double, amount bigint")
    fall = {(r.symbol, r.idx): r.value for r in windows.rolling_drawdown(df, n).collect()}
    median = {(r.symbol, r.idx): r.value for r in windows.log_rolling_median(df, "amount", n).collect()}
    assert len(fall) == len(median) == len(rows)
    for symbol in (1, 2, 3):
        own = [r for r in rows if r[0] == symbol]
        for k, r in enumerate(own):
            part = own[k - n + 1 : k + 1] if k >= n - 1 else []
            if not part or part[-1][1] - part[0][1] != n - 1:
                assert fall[r[:2]] is None and median[r[:2]] is None
                continue
            p = np.array([x[2] for x in part])
            assert fall[r[:2]] == pytest.approx((p / np.maximum.accumulate(p) - 1).min())
            amounts = [x[4] for x in part]
            assert median[r[:2]] == (None if None in amounts else pytest.approx(np.log1p(np.median(amounts))))


def test_rank_correlation_of_ranks_whose_products_overflow_64_bits(spark):
    a, b = [1e9, 1e9 - 0.5, 5e8, 1.0, 9e8], [9e8, 1e9, 1.5, 2.0, 7e8]
    got = spark.createDataFrame(list(zip(a, b, strict=True)), "a double, b double").agg(factors.rank_corr("a", "b").alias("c"), factors.rank_corr("a", "a").alias("one")).first()
    assert got.c == pytest.approx(np.corrcoef(a, b)[0, 1], rel=1e-12) and got.one == pytest.approx(1, rel=1e-15)


def test_ranks_are_dealt_by_group(spark):
    """Groups of ranks stay apart: as many tasks as are asked for, none joined by adaptive execution."""
    p = spark.range(40).selectExpr("id as symbol", "id % 3 as idx", "'f' as feature_id", "1d * id as value", "1d * id as label", "1d * id as size", "id % 2 as industry", "'A' as regime")
    family = spark.createDataFrame([("f", "m"), ("g", "m")], "feature_id string, family string")
    for rows in (factors.ranked_panel(p), factors.pair_correlations(p, family)):
        found = [x for x in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "REPARTITION_BY_NUM" in x]
        assert len(found) == 1 and "hashpartitioning(group#" in found[0] and ", 16)" in found[0]


def test_crowded_buckets_ask_no_filter(spark, tmp_path, monkeypatch):
    """Many new keys would be tried bit by bit only for some of them to pass every filter: files are taken by their range."""
    monkeypatch.setattr(stores, "CROWDED", 5, raising=False)
    table = stores.KeyedTable(spark, str(tmp_path / "t"), "k")
    assert table.append(spark.range(2000).selectExpr("id * 30 as k", "'v' as v")) == 2000
    own = table.appends()
    assert len(table.may_hold(spark.range(1900).selectExpr("id * 30 + 17 as k"), own)) == stores.BUCKETS
    assert len(table.may_hold(spark.range(30).selectExpr("id * 30 + 17 as k"), own)) <= 1
    assert table.append(spark.range(3000).selectExpr("id * 20 as k", "'v' as v")) == 2000 and table.read().distinct().count() == 4000


def test_addresses_are_found_in_linear_time(spark):
    """A run of letters without an address was tried from each of its letters."""
    from time import monotonic

    from tidemark.plans.registry import PARTS

    texts = ["a" * 400_000 + ". Mail to:\nb@c. de!", "a@b.c" * 3, "x@y z@u.v", "1@b.c", "a@b.c9d@e.f", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    start = monotonic()
    got = {r.doc_id: (r.value, r.state) for r in PARTS["b30_disclosures"][0](lambda n: df).collect()}
    assert monotonic() - start < 15
    assert got == {0: ("b@c.de", "FOUND"), 1: (None, "CONFLICTING"), 2: ("yz@u.v", "FOUND"), 3: (None, "MISSING"), 4: (None, "CONFLICTING"), 5: (None, "MISSING")}
