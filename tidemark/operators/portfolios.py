"""Portfolios: composite scores, top-N targets, constraint rules on weights, orders, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import drawdown, numbered


def composite_scores(scores: DataFrame, candidates: int) -> tuple[DataFrame, DataFrame]:
    """Mean oriented score of each key over its candidates, and the keys that lack one."""
    g = scores.groupBy("idx", "symbol").agg(F.count("*").alias("n"), F.avg("score").alias("score"))
    return g.filter(F.col("n") == candidates).drop("n"), g.filter(F.col("n") != candidates).select("idx", "symbol", "n")


def top_n(scores: DataFrame, n: int, gross: float = 0.95) -> DataFrame:
    """the n best of each session, equally weighted to `gross`."""
    w = Window.partitionBy("idx")
    rows = scores.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "symbol"))).filter(F.col("rank") <= n)
    return rows.withColumn("weight", F.lit(gross) / F.count("*").over(w)).select("idx", "symbol", "rank", "weight")


def veto_then_top(factor: DataFrame, model: DataFrame, n: int, share: float = 0.2) -> DataFrame:
    """drop the worst share by model score, then the n best by factor; too few left is flagged."""
    w = Window.partitionBy("idx")
    rows = factor.join(model.select("idx", "symbol", F.col("score").alias("model")), ["idx", "symbol"])
    rows = rows.withColumn("low", F.row_number().over(w.orderBy("model", "symbol"))).withColumn("all", F.count("*").over(w)).filter(F.col("low") > F.ceil(F.col("all") * share))
    rows = rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "symbol"))).withColumn("enough", F.count("*").over(w) >= n)
    return rows.filter(F.col("rank") <= n).select("idx", "symbol", "rank", "enough")


def quotas(strata: DataFrame, total: int) -> DataFrame:
    """Seats of each stratum: one each, the rest by largest remainder of the stratum's rows. Strata are few."""
    every = Window.partitionBy()
    s = strata.withColumn("strata", F.count("*").over(every)).withColumn("all", F.sum("n").over(every))
    rest = F.lit(total) - F.col("strata")
    s = s.withColumn("base", F.floor(rest * F.col("n") / F.col("all")).cast("bigint")).withColumn("remainder", (rest * F.col("n")) % F.col("all"))
    s = s.withColumn("left", rest - F.sum("base").over(every)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("remainder"), "stratum")))
    return s.select("stratum", "n", (1 + F.col("base") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).cast("bigint").alias("quota"))


def stratified_sample(rows: DataFrame, seats: DataFrame, version: str) -> DataFrame:
    """of each stratum the first rows by a hash of version, symbol and date, up to its quota."""
    key = F.sha2(F.concat_ws("|", F.lit(version), F.col("symbol").cast("string"), F.col("listing_date").cast("string")), 256)
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("stratum").orderBy(key, "symbol")))
    return ranked.join(F.broadcast(seats.select("stratum", "quota")), "stratum").filter("k <= quota").select("symbol", "stratum", "k")


def shard_plan(rows: DataFrame, by: str, key: str, size: int) -> DataFrame:
    """the sorted rows of each group cut in shards of a fixed size, with the first and last key and a digest."""
    g = numbered(rows.select(by, key), [by], [key]).withColumn("shard", F.floor(F.col("n") / size)).groupBy(by, "shard")
    return g.agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"), F.sha2(F.array_join(F.sort_array(F.collect_list(key)).cast("array<string>"), "|"), 256).alias("digest"))


def holding_cap(rows: DataFrame, most: int) -> DataFrame:
    """the best `most` positions of a session keep their weight, the others get none."""
    rank = F.row_number().over(Window.partitionBy("idx").orderBy(F.desc("score"), "symbol"))
    return rows.withColumn("target_w", F.when(rank <= most, F.col("target_w")).otherwise(0.0))


def position_cap(rows: DataFrame, cap: float = 0.05) -> DataFrame:
    """H01."""
    return rows.withColumn("target_w", F.least("target_w", F.lit(cap)))


def new_risk(rows: DataFrame, equity: float, lot: int = 100, share: float = 0.05) -> DataFrame:
    """No increase of an ineligible position; else whole lots within a share of the volume."""
    more = F.col("target_w") > F.col("current_w")
    wanted = (F.col("target_w") - F.col("current_w")) * equity / F.col("price")
    lots = F.floor(F.least(wanted, F.col("volume") * share) / lot) * lot
    return rows.withColumn("target_w", F.when(more & ~F.col("eligible"), F.col("current_w")).when(more, F.col("current_w") + lots * F.col("price") / equity).otherwise(F.col("target_w")))


def industry_cap(rows: DataFrame, cap: float = 0.2) -> DataFrame:
    """Scales each industry to the cap; a session with an unknown industry held is a draft, unscaled."""
    total = F.sum("target_w").over(Window.partitionBy("idx", "industry"))
    draft = F.coalesce(F.bool_or(F.col("industry").isNull() & (F.col("target_w") > 0)).over(Window.partitionBy("idx")), F.lit(False))
    rows = rows.withColumn("draft", draft).withColumn("_t", total)
    return rows.withColumn("target_w", F.when(~F.col("draft") & (F.col("_t") > cap), F.col("target_w") * F.try_divide(F.lit(cap), F.col("_t"))).otherwise(F.col("target_w"))).drop("_t")


def gross_and_concentration(rows: DataFrame, gross: float = 0.95, concentration: float = 0.05) -> DataFrame:
    """Scale to the gross limit, then by the root of limit over the sum of squares."""
    w = Window.partitionBy("idx")
    rows = rows.withColumn("_g", F.sum("target_w").over(w))
    rows = rows.withColumn("target_w", F.when(F.col("_g") > gross, F.col("target_w") * F.try_divide(F.lit(gross), F.col("_g"))).otherwise(F.col("target_w")))
    rows = rows.withColumn("_h", F.sum(F.col("target_w") * F.col("target_w")).over(w))
    return rows.withColumn("target_w", F.when(F.col("_h") > concentration, F.col("target_w") * F.sqrt(F.try_divide(F.lit(concentration), F.col("_h")))).otherwise(F.col("target_w"))).drop("_g", "_h")


def turnover_limit(rows: DataFrame, limit: float = 0.25) -> DataFrame:
    """Move from current to target weights only as far as half the sum of changes allows."""
    t = F.sum(F.abs(F.col("target_w") - F.col("current_w"))).over(Window.partitionBy("idx")) / 2
    rows = rows.withColumn("_t", t)
    step = F.when(F.col("_t") > limit, F.try_divide(F.lit(limit), F.col("_t"))).otherwise(1.0)
    return rows.withColumn("target_w", F.col("current_w") + (F.col("target_w") - F.col("current_w")) * step).drop("_t")


def rule_chain(rows: DataFrame, equity: float, most: int = 30) -> DataFrame:
    """All rules in order; each keeps the weight after it, so that events are changes between columns."""
    def note(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(f"after_{name}", F.col("target_w"))

    out = note(rows, "start")
    for name, rule in (("holdings", lambda d: holding_cap(d, most)), ("position", position_cap), ("new_risk", lambda d: new_risk(d, equity)), ("industry", industry_cap), ("gross", gross_and_concentration), ("turnover", turnover_limit)):
        out = note(rule(out), name)
    return out


def rule_events(chained: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Changes of a rule chain: one row where a rule changed a weight."""
    names = [c for c in chained.columns if c.startswith("after_")]
    e = [F.when(F.abs(F.col(a) - F.col(b)) > tolerance, F.struct(F.lit(b.removeprefix("after_")).alias("rule"), F.col(a).alias("before"), F.col(b).alias("after"))) for a, b in zip(names, names[1:], strict=False)]
    return chained.select("idx", "symbol", F.explode(F.array_compact(F.array(*e))).alias("e")).select("idx", "symbol", "e.*")


def risk_events(chained: DataFrame, equity: float, most: int = 30, position: float = 0.05, lot: int = 100, share: float = 0.05, industry: float = 0.2, gross: float = 0.95, concentration: float = 0.05, turnover: float = 0.25) -> DataFrame:
    """What each rule of a chain did: idx, symbol (null for a whole session), rule, action, observed, limit.

    The limits are those that the chain was run with. A session that holds a name of unknown industry gets an
    event that blocks validation, though no weight changes.
    """

    def event(when: Column, rule: str, action: str, observed: Column, limit: Column) -> Column:
        return F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"), observed.cast("double").alias("observed"), limit.cast("double").alias("limit")))

    def exploded(df: DataFrame, *events: Column) -> DataFrame:
        return df.select("idx", "symbol", F.explode(F.array_compact(F.array(*events))).alias("e")).select("idx", "symbol", "e.*")

    more = F.col("after_position") - F.col("current_w")
    wanted, capacity = more * equity / F.col("price"), F.col("volume") * share
    lots = F.floor(F.least(wanted, capacity) / lot)
    open_, allowed = (more > 0) & F.col("eligible"), lots * lot * F.col("price") / equity
    own = exploded(
        chained,
        event(F.col("after_holdings") > position, "MAX_POSITION_WEIGHT", "RESIZE", F.col("after_holdings"), F.lit(position)),
        event((more > 0) & ~F.col("eligible"), "NEW_RISK_INELIGIBLE", "REJECT", more, F.lit(0.0)),
        event(open_ & (lots == 0), "VOLUME_PARTICIPATION", "REJECT", wanted, capacity),
        event(open_ & (lots > 0) & (allowed < more), "VOLUME_PARTICIPATION", "RESIZE", wanted, capacity),
    )
    w = F.col("after_industry")
    session = chained.groupBy("idx").agg(
        F.count_if(F.col("after_start") > 0).alias("held"), F.count_if(F.col("industry").isNull() & (F.col("after_new_risk") > 0)).alias("unknown"),
        F.sum(w).alias("gross"), F.sum(w * w).alias("squares"), (F.sum(F.abs(F.col("after_gross") - F.col("current_w"))) / 2).alias("moved"),
    ).withColumn("symbol", F.lit(None).cast(chained.schema["symbol"].dataType))
    scale = F.when(F.col("gross") > gross, F.try_divide(F.lit(gross), F.col("gross"))).otherwise(1.0)
    squares = F.col("squares") * scale * scale
    whole = exploded(
        session,
        event(F.col("held") > most, "MAX_HOLDINGS", "REJECT", F.col("held"), F.lit(most)),
        event(F.col("unknown") > 0, "INDUSTRY_EXPOSURE_UNAVAILABLE", "BLOCK_VALIDATION", F.col("unknown"), F.lit(0.0)),
        event(F.col("gross") > gross, "MINIMUM_CASH_WEIGHT", "RESIZE", 1 - F.col("gross"), F.lit(1 - gross)),
        event(squares > concentration, "CONCENTRATION", "RESIZE", squares, F.lit(concentration)),
        event(F.col("moved") > turnover, "MAX_TURNOVER", "RESIZE", F.col("moved"), F.lit(turnover)),
    )
    groups = chained.filter("not draft and industry is not null and after_new_risk > 0").groupBy("idx", "industry").agg(F.sum("after_new_risk").alias("exposure"))
    groups = groups.withColumn("symbol", F.lit(None).cast(chained.schema["symbol"].dataType))
    groups = exploded(groups, event(F.col("exposure") > industry, "MAX_INDUSTRY_WEIGHT", "RESIZE", F.col("exposure"), F.lit(industry)))
    return own.unionByName(whole).unionByName(groups)


def rebalance_orders(targets: DataFrame, holdings: DataFrame, equity: float, lot: int = 100) -> DataFrame:
    """Deltas from held to desired whole lots; what is held and no longer wanted is sold."""
    rows = targets.join(holdings, ["idx", "symbol"], "full_outer")
    want = F.coalesce(F.floor(F.col("target_w") * equity / F.col("price") / lot) * lot, F.lit(0))
    rows = rows.withColumn("delta", want - F.coalesce("shares", F.lit(0)))
    return rows.filter("delta <> 0").select("idx", "symbol", "delta", F.when(F.col("delta") > 0, "BUY").otherwise("SELL").alias("side"))


def mark_to_market(shares: DataFrame, prices: DataFrame) -> DataFrame:
    """Value of each holding at its last known price and its weight in the session's sum."""
    rows = shares.join(prices, ["idx", "symbol"]).withColumn("value", F.col("shares") * F.col("close"))
    return rows.withColumn("weight", F.try_divide(F.col("value"), F.sum("value").over(Window.partitionBy("idx")))).select("idx", "symbol", "value", "weight")


def costs(rows: DataFrame, rate: float = 0.0003, least: float = 5.0, stamp: float = 0.0005) -> DataFrame:
    """Commission of at least 5, rounded half-even to cents; stamp duty on sells."""
    n = F.col("notional")
    return rows.withColumn("commission", F.bround(F.greatest(n * rate, F.lit(least)), 2)).withColumn("stamp_duty", F.when(F.col("side") == "SELL", F.bround(n * stamp, 2)).otherwise(0.0))


def block_reason(side: Column, open_: Column, suspended: Column, up: Column, down: Column, eps: float = 1e-8) -> Column:
    """Why an order can't trade: suspended, no bar, a buy at the upper or a sell at the lower limit."""
    return F.when(suspended, "SUSPENDED").when(open_.isNull(), "MISSING_BAR").when((side == "BUY") & (open_ >= up - eps), "LIMIT_UP").when((side == "SELL") & (open_ <= down + eps), "LIMIT_DOWN")


def sized(rows: DataFrame, lot: int = 100, position: float = 0.05, cash: float = 0.05, participation: float = 0.1) -> DataFrame:
    """Of each requested buy the shares in whole lots under the position, cash and volume caps, and the event.

    rows: requested, equity, price, volume. Cash is what equity leaves above its floor. Where the least cap is
    below the request, rule names it (the first of equals), action is RESIZE, or REJECT if nothing is left,
    observed is the request and limit the rule's limit; else these are null.
    """

    def lots(x: Column) -> Column:
        return (F.floor(x / lot) * lot).cast("bigint")

    rules = (("MAX_POSITION_WEIGHT", F.col("equity") * position / F.col("price"), position), ("MINIMUM_CASH_WEIGHT", F.col("equity") * (1 - cash) / F.col("price"), cash), ("VOLUME_PARTICIPATION", F.col("volume") * participation, participation))
    caps = F.array(*[F.struct(lots(c).alias("cap"), F.lit(i).alias("order"), F.lit(n).alias("rule"), F.lit(x).alias("limit")) for i, (n, c, x) in enumerate(rules)])
    rows = rows.withColumn("_m", F.array_min(caps)).withColumn("shares", F.least(F.col("requested").cast("bigint"), "_m.cap"))
    less = F.col("shares") < F.col("requested")
    action = F.when(less, F.when(F.col("shares") == 0, "REJECT").otherwise("RESIZE"))
    return rows.withColumns({"rule": F.when(less, F.col("_m.rule")), "action": action, "observed": F.when(less, F.col("requested").cast("double")), "limit": F.when(less, F.col("_m.limit"))}).drop("_m")


def fills(rows: DataFrame, participation: float = 0.1, lot: int = 100) -> DataFrame:
    """Filled quantity of each order and its class, with the reason if it isn't filled."""
    room = (F.floor(F.col("volume") * participation / lot) * lot).cast("bigint")
    afford = F.when(F.col("side") == "BUY", (F.floor(F.col("cash") / F.col("price") / lot) * lot).cast("bigint")).otherwise(F.col("sellable"))
    rows = rows.withColumn("_room", room).withColumn("_afford", afford).withColumn("filled", F.greatest(F.lit(0), F.least("requested", "_room", "_afford")))
    why = F.when(F.col("filled") == F.col("requested"), F.lit(None).cast("string")).when(F.col("_room") <= F.col("_afford"), "VOLUME_CAPACITY").when(F.col("side") == "BUY", "INSUFFICIENT_CASH").otherwise("T_PLUS_ONE")
    return rows.withColumn("state", F.when(F.col("filled") == F.col("requested"), "FILLED").when(F.col("filled") > 0, "PARTIAL").otherwise("PENDING")).withColumn("reason", why).drop("_room", "_afford")


def _curve(equity: DataFrame, sessions: int) -> DataFrame:
    """First and last equity, annual volatility, Sharpe ratio, worst drawdown and mean equity, by run."""
    w = Window.partitionBy("run").orderBy("idx")
    rows = drawdown(equity).withColumn("r", F.col("equity") / F.lag("equity").over(w) - 1)
    year = F.sqrt(F.lit(float(sessions)))
    g = rows.groupBy("run").agg(F.max_by("equity", "idx").alias("last"), F.min_by("equity", "idx").alias("first"), F.count("r").alias("n"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("sd"), F.avg("r").alias("mean"), F.min("drawdown").alias("max_drawdown"), F.avg("equity").alias("average"))
    return g.withColumn("volatility", F.col("sd") * year).withColumn("sharpe", F.when(F.col("sd") > 0, F.try_divide(F.col("mean"), F.col("sd")) * year).otherwise(0.0))


def equity_metrics(equity: DataFrame, trades: DataFrame, sessions: int = 252) -> DataFrame:
    """Total and annual return, volatility, Sharpe ratio, worst drawdown, win rate, trades and fees, by run.

    trades: run, side, realized (profit of a sell), fee. The win rate is the share of sells with a realized
    profit, 0 without sells. A run without trades has 0 trades and fees.
    """
    sells = F.count_if(F.col("side") == "SELL")
    t = trades.groupBy("run").agg(F.count("*").alias("trade_count"), F.sum("fee").alias("total_fees"), F.coalesce(F.try_divide(F.count_if((F.col("side") == "SELL") & (F.col("realized") > 0)), sells), F.lit(0.0)).alias("win_rate"))
    g = _curve(equity, sessions).join(t, "run", "left").fillna(0, ["trade_count", "total_fees", "win_rate"])
    growth = F.col("last") / F.col("first")
    return g.select("run", (growth - 1).alias("total_return"), (F.pow(growth, F.lit(float(sessions)) / F.greatest("n", F.lit(1))) - 1).alias("annual_return"), "volatility", "sharpe", "max_drawdown", "win_rate", "trade_count", "total_fees")


def benchmark_violations(equity: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Of each run the sessions that the benchmark lacks, those between its first and last that only the
    benchmark has, and benchmark values that aren't finite and positive."""
    spans = equity.groupBy("run").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    b = benchmark.select("idx", F.col("close").alias("bench"))
    asked = spans.select("run", F.explode(F.sequence("lo", "hi")).alias("idx")).join(b, "idx")
    rows = equity.select("run", "idx", F.lit(True).alias("held")).join(asked, ["run", "idx"], "full_outer")
    fine = (F.col("bench") > 0) & (F.col("bench") < float("inf"))
    why = F.when(F.col("held").isNull(), "MISSING_SESSION").when(F.col("bench").isNull(), "MISSING_BENCHMARK").when(~fine, "BAD_BENCHMARK")
    return rows.select("run", "idx", why.alias("violation")).filter("violation is not null")


def portfolio_metrics(equity: DataFrame, benchmark: DataFrame, orders: DataFrame, events: DataFrame, cash: DataFrame, sessions: int = 252) -> DataFrame:
    """Net return, benchmark return and excess, volatility, Sharpe ratio, worst drawdown, turnover, fees,
    largest share of a volume, orders that aren't filled, risk events, benchmark violations and years, by run.

    equity: run, idx, date, equity. orders: run, notional, fee, participation, state. events: run. cash: run and the
    cash it began with, which the net return is measured by, so costs of the first session count. annual has (year,
    portfolio, benchmark, excess) in order of years. A run with violations has no benchmark return and no excess, in no
    year, as its sessions don't match.
    """
    o = orders.groupBy("run").agg(F.sum("notional").alias("notional"), F.sum("fee").alias("total_fees"), F.max("participation").alias("participation"), F.count_if(F.col("state") != "FILLED").alias("pending"))
    e = events.groupBy("run").agg(F.count("*").alias("events"))
    bad = benchmark_violations(equity, benchmark).groupBy("run").agg(F.count("*").alias("violations"))
    both = equity.select("run", "idx", F.year("date").alias("year"), "equity").join(benchmark.select("idx", "close"), "idx", "left")
    ends = [F.struct("idx", c).alias(f"_{c}") for c in ("equity", "close")]
    years = both.select("run", "year", *ends).groupBy("run", "year").agg(*[f(c)[c[1:]].alias(n) for c, n in (("_equity", "e"), ("_close", "b")) for f, n in ((F.min, f"{n}0"), (F.max, f"{n}1"))])
    year = F.struct("year", (F.col("e1") / F.col("e0") - 1).alias("portfolio"), (F.col("b1") / F.col("b0") - 1).alias("benchmark"))
    spans = years.groupBy("run").agg(F.sort_array(F.collect_list(year)).alias("annual"), (F.max(F.struct("year", "b1"))["b1"] / F.min(F.struct("year", "b0"))["b0"] - 1).alias("b"))  # an entry a year
    g = _curve(equity, sessions).join(o, "run", "left").join(e, "run", "left").join(bad, "run", "left").join(spans, "run", "left").join(cash.select("run", "cash"), "run", "left")
    g = g.fillna(0, ["notional", "total_fees", "participation", "pending", "events", "violations"])
    fine = F.col("violations") == 0
    bench, total = F.when(fine, F.col("b")), F.col("last") / F.col("cash") - 1
    annual = F.transform("annual", lambda y: F.struct(y["year"], y["portfolio"], F.when(fine, y["benchmark"]).alias("benchmark"), F.when(fine, y["portfolio"] - y["benchmark"]).alias("excess")))
    return g.select("run", total.alias("total"), bench.alias("bench"), (total - bench).alias("excess"), "volatility", "sharpe", "max_drawdown", (F.col("notional") / F.col("average")).alias("turnover"), "total_fees", "participation", "pending", "events", "violations", annual.alias("annual"))


def annual_segments(equity: DataFrame, year: Column) -> DataFrame:
    """First and last equity and the return of each year, by run."""
    g = equity.groupBy("run", year.alias("year")).agg(F.min_by("equity", "idx").alias("first"), F.max_by("equity", "idx").alias("last"))
    return g.withColumn("annual", F.col("last") / F.col("first") - 1)


def compare_runs(equity: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two runs' returns and drawdowns side by side, for each pair (a, b); a run that isn't there has nulls."""
    g = drawdown(equity).groupBy("run").agg((F.max_by("equity", "idx") / F.min_by("equity", "idx") - 1).alias("total"), F.min("drawdown").alias("worst"), F.min(F.when(F.col("drawdown") < -0.2, F.col("idx"))).alias("first_halt"))
    x, y = (g.toDF(s, f"total_{s}", f"worst_{s}", f"first_halt_{s}") for s in ("a", "b"))
    return pairs.join(x, "a", "left").join(y, "b", "left").withColumn("gap", F.col("total_a") - F.col("total_b"))


def breadth(bars: DataFrame) -> DataFrame:
    """Advancing, declining and unchanged symbols and the equal-weight curve, by session."""
    w = Window.partitionBy("symbol").orderBy("idx")
    rows = bars.withColumn("change", F.col("close") - F.lag("close").over(w)).withColumn("start", F.first("close").over(w))
    return rows.groupBy("idx").agg(F.count_if(F.col("change") > 0).alias("advancing"), F.count_if(F.col("change") < 0).alias("declining"), F.count_if(F.col("change") == 0).alias("unchanged"), (F.avg(F.col("close") / F.col("start")) * 100).alias("curve"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Symbols that two target sets share, over the larger set, by session."""
    rows = a.select("idx", "symbol", F.lit(True).alias("a")).join(b.select("idx", "symbol", F.lit(True).alias("b")), ["idx", "symbol"], "full_outer")
    both, na, nb = F.count_if(F.col("a") & F.col("b")), F.count("a"), F.count("b")
    return rows.groupBy("idx").agg((both / F.greatest(na, nb)).alias("overlap"))


def aligned(benchmark: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions that a benchmark lacks and benchmark dates that are no sessions."""
    rows = sessions.select("idx", F.lit(True).alias("s")).join(benchmark.select("idx", F.lit(True).alias("b")), "idx", "full_outer")
    return rows.filter("s is null or b is null").select("idx", F.when(F.col("b").isNull(), "MISSING_BENCHMARK").otherwise("UNKNOWN_SESSION").alias("violation"))


def session_bars(bars: DataFrame, targets: DataFrame) -> DataFrame:
    """Of each session the bars of symbols that are ever a target: how many, how many suspended, duplicates."""
    rows = bars.join(targets.select("symbol").distinct(), "symbol", "left_semi")
    return rows.groupBy("idx").agg(F.count("*").alias("bars"), F.count_if("suspended").alias("suspended"), (F.count("*") - F.count_distinct("symbol")).alias("duplicates"))


def promotion(summary: DataFrame, gates: dict[str, tuple[str, float]]) -> DataFrame:
    """A row for each gate of each candidate: what was observed, what is asked, whether it passed, and the decision."""
    rows = F.array(*[F.struct(F.lit(c).alias("gate"), F.col(c).cast("double").alias("observed"), F.lit(r).alias("requirement"), (F.col(c) >= r if op == ">=" else F.col(c) <= r).alias("passed")) for c, (op, r) in gates.items()])
    out = summary.select("candidate", F.explode(rows).alias("g")).select("candidate", "g.*")
    return out.withColumn("decision", F.bool_and(F.coalesce("passed", F.lit(False))).over(Window.partitionBy("candidate")))
