"""Evaluation of factors: rank correlations, quantiles, segments, false-discovery control, choice."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.scratch import discard, written

from .windows import average_rank, bucket_turnover, fifth, quintile


def guarded_corr(a: str, b: str) -> Column:
    """Pearson correlation; null where a side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def rank_corr(a: str, b: str) -> Column:
    """Correlation of average ranks; null where a side is constant.

    Twice a rank is a whole number, so the sums are exact in any order of rows and no correlation of 0 turns
    into a tiny positive one. Products are summed in two halves of 32 bits, so groups of up to a billion rows
    fit into whole numbers of 64 bits.
    """
    x, y = ((2 * F.col(c)).cast("bigint") for c in (a, b))
    n = F.count(x * y).cast("decimal(18,0)")

    def whole(u: Column) -> Column:
        return F.sum(u).cast("decimal(19,0)")

    def spread(u: Column, v: Column) -> Column:
        products = whole(F.shiftright(u * v, 32)) * F.lit(1 << 32).cast("decimal(10,0)") + whole((u * v).bitwiseAND(F.lit((1 << 32) - 1)))
        return (n * products - whole(u) * whole(v)).cast("double")

    return F.when((spread(x, x) > 0) & (spread(y, y) > 0), F.try_divide(spread(x, y), F.sqrt(spread(x, x)) * F.sqrt(spread(y, y))))


def dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows by their group, the columns `by` as one struct: a few groups a task.

    Ranks of one shuffle keep a sort for each rank in the memory of a task. Adaptive execution would join groups up to
    its advised bytes, so the number is set, at four times the session's partitions.
    """
    grouped = rows.select(F.struct(*by).alias("group"), *[c for c in rows.columns if c not in by])
    return grouped.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group")


def finite(*columns: str) -> Column:
    """Neither null, NaN nor infinite (NaN counts as the largest number)."""
    c = F.lit(True)
    for x in columns:
        c = c & F.col(x).isNotNull() & (F.abs(F.col(x)) < float("inf"))
    return c


def daily_rank_ic(panel: DataFrame, by: list[str] | None = None, least: int = 5) -> DataFrame:
    """Spearman correlation of value and label, by feature, session and further keys."""
    keys = ["feature_id", "idx", *(by or [])]
    rows = panel.filter(finite("value", "label"))
    rows = average_rank(average_rank(rows, "value", keys, "rv"), "label", keys, "rl")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), rank_corr("rv", "rl").alias("ic")).filter((F.col("n") >= least) & F.col("ic").isNotNull())


def two_sided_p(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2)))


def ic_summary(daily: DataFrame, direction: float = 1.0) -> DataFrame:
    """Mean, ratio to deviation, share above 0 and z of daily correlations, by feature."""
    ic = F.col("ic") * direction
    rows = daily.groupBy("feature_id").agg(F.avg("ic").alias("mean_ic"), F.avg(ic).alias("oriented_ic"), F.stddev_pop(ic).alias("sd"), F.avg((ic > 0).cast("double")).alias("positive"), F.count("*").alias("dates"))
    return rows.withColumn("icir", F.try_divide("oriented_ic", "sd")).withColumn("z", F.try_divide(F.col("oriented_ic") * F.sqrt("dates"), F.col("sd")))


def with_p(summary: DataFrame) -> DataFrame:
    """p of a zero mean; with no deviation 0, or 1 where the mean is 0. One row a factor reaches the UDF."""
    return summary.withColumn("p_value", F.when(F.col("sd") == 0, F.when(F.col("oriented_ic") != 0, 0.0).otherwise(1.0)).otherwise(F.pandas_udf(two_sided_p, "double")("z")))


def coverage(panel: DataFrame) -> DataFrame:
    """Rows, valid pairs and missing values by feature."""
    v, y = finite("value"), finite("label")
    return panel.groupBy("feature_id").agg(F.count("*").alias("total"), F.count_if(v & y).alias("valid"), F.count_if(~v).alias("missing_feature"), F.count_if(~y).alias("missing_label"))


def oriented(panel: DataFrame, directions: dict[str, float] | None = None) -> DataFrame:
    """Values times the direction expected of their factor, 1 where none is given."""
    if not directions:
        return panel
    known = F.create_map(*[F.lit(x) for kv in directions.items() for x in kv])
    return panel.withColumn("value", F.col("value") * F.coalesce(known[F.col("feature_id")], F.lit(1.0)))


def quintile_report(panel: DataFrame, cost: float = 0.0015) -> DataFrame:
    """Mean label of each quintile of oriented values, share of steps that don't fall, spread,
    turnover of the top quintile, and the spread less turnover times cost, by feature."""
    rows = quintile(panel.filter(finite("value", "label")), "value", ["feature_id", "idx"])
    means = [F.avg(F.when(F.col("quintile") == k, F.col("label"))).alias(f"q{k}") for k in range(1, 6)]
    q = rows.groupBy("feature_id").agg(*means)
    steps = sum((F.col(f"q{k + 1}") >= F.col(f"q{k}")).cast("int") for k in range(1, 5))
    changes = bucket_turnover(rows).groupBy("feature_id").agg(F.avg("turnover").alias("turnover"))
    q = q.join(changes, "feature_id", "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))
    q = q.withColumn("monotone", steps / 4).withColumn("gross", F.col("q5") - F.col("q1"))
    return q.withColumn("spread", F.col("gross") - F.col("turnover") * cost)


def ic_segments(daily: DataFrame, segment: Column, name: str) -> DataFrame:
    """Sessions and mean correlation by feature and a segment of the sessions."""
    return daily.groupBy("feature_id", segment.alias(name)).agg(F.sum("n").alias("observations"), F.avg("ic").alias("mean_ic"))


def industry_segments(panel: DataFrame, least: int = 3) -> DataFrame:
    """Correlations within (session, industry), then their mean by industry."""
    return daily_rank_ic(panel, ["industry"], least).groupBy("feature_id", "industry").agg(F.sum("n").alias("observations"), F.avg("ic").alias("mean_ic"))


def size_exposure(panel: DataFrame, direction: float = 1.0) -> DataFrame:
    """Mean daily correlation of the factor with size, in [-1, 1]."""
    rows = panel.filter(finite("value", "size")).withColumn("v", F.col("value") * direction)
    daily = rows.groupBy("feature_id", "idx").agg(guarded_corr("v", "size").alias("c"))
    return daily.groupBy("feature_id").agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.avg("c"))).alias("exposure"))


def pair_correlations(features: DataFrame, family: DataFrame) -> DataFrame:
    """Mean daily rank correlation of each two factors of a family, ranked on common rows."""
    rows = features.filter(finite("value")).select("symbol", "idx", "feature_id", "value")
    x, y = family.select("family", F.col("feature_id").alias("a")), family.select("family", F.col("feature_id").alias("b"))
    asked = x.join(y, "family").filter("a < b")  # a row for each two factors of a family
    a = rows.withColumnsRenamed({"feature_id": "a", "value": "va"}).join(F.broadcast(asked), "a")
    b = rows.withColumnsRenamed({"feature_id": "b", "value": "vb"})
    both = dealt(a.join(b, ["symbol", "idx", "b"]), ["a", "b", "idx"])
    ranked = average_rank(average_rank(both, "va", ["group"], "ra"), "vb", ["group"], "rb")
    daily = ranked.groupBy("family", "group").agg(rank_corr("ra", "rb").alias("c")).filter("c is not null")
    return daily.groupBy("family", "group.a", "group.b").agg(F.avg("c").alias("correlation"), F.count("*").alias("dates"))


def false_discovery(trials: DataFrame) -> DataFrame:
    """Benjamini-Hochberg q of p_value by trial_id. A row a trial: one window over all is small."""
    order = Window.orderBy("p_value", "trial_id")
    n = F.count("*").over(Window.partitionBy())
    rows = trials.withColumn("rank", F.row_number().over(order)).withColumn("raw", F.col("p_value") * n / F.col("rank"))
    down = Window.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("q_value", F.least(F.lit(1.0), F.min("raw").over(down))).drop("raw")


def select_factors(summary: DataFrame, cover: float = 0.6, q: float = 0.05, consistent: float = 0.5) -> DataFrame:
    """Reasons against each factor: coverage, significance, direction or consistency."""
    r = F.array_compact(F.array(F.when(F.col("coverage") < cover, "LOW_COVERAGE"), F.when(F.col("q_value") > q, "NOT_SIGNIFICANT"), F.when((F.col("oriented_ic") <= 0) | (F.col("positive") < consistent), "INCONSISTENT")))
    return summary.withColumn("reasons", F.array_join(r, ",")).withColumn("selected", F.size(r) == 0)


def drop_redundant(pairs: DataFrame, trials: DataFrame, limit: float = 0.8) -> DataFrame:
    """Walk a family's pairs in the order of their trials; of a pair at or above the limit with both
    still in, drop the less simple.

    pairs: family, a, b, correlation. trials: feature_id, simplicity, place, and rejected, true where another
    gate already rejects it; such a factor rejects none. A family is a handful of factors.
    """
    t = trials.select("feature_id", "simplicity", "place", "rejected")
    rows = pairs.filter(F.abs("correlation") >= limit).join(t.toDF("a", "sa", "pa", "ra"), "a").join(t.toDF("b", "sb", "pb", "rb"), "b")
    rows = rows.filter("not ra and not rb").select("family", "a", "b", "sa", "sb", F.least("pa", "pb").alias("first"), F.greatest("pa", "pb").alias("second"))

    def walk(p: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[str, str, str]] = []
        gone: set[str] = set()
        for x in p.sort_values(["first", "second"]).itertuples():
            if x.a in gone or x.b in gone:
                continue
            loser, winner = (x.a, x.b) if (x.sa, x.a) > (x.sb, x.b) else (x.b, x.a)
            gone.add(loser)
            out.append((x.family, loser, winner))
        return pd.DataFrame(out, columns=["family", "dropped", "kept"])

    return rows.groupBy("family").applyInPandas(walk, "family string, dropped string, kept string")


def _worst(segments: DataFrame, name: str) -> DataFrame:
    """Of each feature the segments as an array, and the one with the least mean correlation."""
    one = F.struct(F.col(name).cast("string").alias("segment"), "observations", "mean_ic")
    g = segments.groupBy("feature_id").agg(F.array_sort(F.collect_list(one)).alias(f"{name}s"), F.min_by(one, F.struct("mean_ic", F.col(name).cast("string"))).alias("w"))
    return g.select("feature_id", f"{name}s", F.col("w.segment").alias(f"worst_{name}"), F.col("w.mean_ic").alias(f"worst_{name}_ic"))


DATE, INDUSTRY, REGIME, LAST = 7, 3, 5, 6
"""grouping_id() of the levels of session_statistics: by session, and further by industry, regime and last session."""


def ranked_panel(panel: DataFrame, directions: dict[str, float] | None = None) -> DataFrame:
    """The panel with all ranks that its diagnostics need, from one scan and two shuffles of the rows.

    ok marks rows with a finite value and label; ranks, quintile, and the symbol's session, rank and quintile
    before (last, rp, before) are among them only. The panel has one row for each factor, symbol and session.
    """
    rows = oriented(panel, directions).select("feature_id", "symbol", "idx", "value", "label", "size", "industry", "regime").withColumn("ok", finite("value", "label"))
    rows = dealt(rows, ["feature_id", "idx", "ok"])
    for by, suffix in ((["group"], ""), (["group", "industry"], "_in")):  # the second lies in the partitions of the first
        rows = average_rank(average_rank(rows, "value", by, f"rv{suffix}"), "label", by, f"rl{suffix}")
    rows = rows.withColumn("quintile", fifth(F.col("rv"), F.count("*").over(Window.partitionBy("group"))))
    rows = rows.select("group.*", *[c for c in rows.columns if c != "group"])
    own = Window.partitionBy("feature_id", "symbol", "ok").orderBy("idx")
    return rows.withColumns({"last": F.lag("idx").over(own), "rp": F.lag("rv").over(own), "before": F.lag("quintile").over(own)})


def session_statistics(ranked: DataFrame, least: int = 5) -> DataFrame:
    """Every statistic of a factor's sessions, by session, industry, regime and the symbols' last session.

    One pass of grouping sets; gid tells the level. ic is null below `least` valid rows.
    """
    ok, sized, top = F.col("ok"), F.col("ok") & finite("size"), F.col("ok") & (F.col("quintile") == 5)
    ranks = {c: F.when(ok, F.col(c)).alias(c) for c in ("rv", "rl", "rv_in", "rl_in", "rp")}
    rows = ranked.select(
        "feature_id", "idx", "industry", "regime", "last", "value", "label", "ok", "quintile", "before", *ranks.values(),
        F.when(sized, F.col("value")).alias("exposed"), F.when(sized, F.col("size")).alias("size"), (top & (F.col("before") == 5)).alias("stayed"),
    )
    by = ["feature_id", "idx"]
    n, ic = F.count_if(ok), F.when(F.grouping("industry") == 0, rank_corr("rv_in", "rl_in")).otherwise(rank_corr("rv", "rl"))
    labels = [F.when(ok & (F.col("quintile") == k), F.col("label")) for k in range(1, 6)]
    return rows.groupingSets([by, [*by, "industry"], [*by, "regime"], [*by, "last"]], *by, "industry", "regime", "last").agg(
        F.grouping_id().alias("gid"), F.count("*").alias("total"), n.alias("n"),
        F.count_if(~finite("value")).alias("missing_feature"), F.count_if(~finite("label")).alias("missing_label"),
        F.when(n >= least, ic).alias("ic"), rank_corr("rv", "rp").alias("autocorrelation"), guarded_corr("exposed", "size").alias("exposure"),
        F.count_if(top).alias("top"), F.count_if("stayed").alias("stayed"),
        *[F.sum(x).alias(f"s{k}") for k, x in enumerate(labels, 1)], *[F.count(x).alias(f"n{k}") for k, x in enumerate(labels, 1)],
    )


def diagnostics(panel: DataFrame, year: Column, directions: dict[str, float] | None = None, least: int = 5) -> DataFrame:
    """D14, first part: one row for each factor with every diagnostic, all factors in one long table.

    Counts and coverage, raw and oriented mean correlation, its ratio, consistency and p, quintiles and
    spreads, turnover, rank autocorrelation, size exposure, and year, regime and industry segments
    (arrays) with the worst year and industry. The panel is read once; its statistics by session, a small
    table, are written to the scratch folder.
    """
    return summarized(written(session_statistics(ranked_panel(panel, directions), least), "session-statistics"), year, directions)


def summarized(statistics: DataFrame, year: Column, directions: dict[str, float] | None = None, cost: float = 0.0015) -> DataFrame:
    """The diagnostics of each factor from the statistics of its sessions."""
    dates = statistics.filter(F.col("gid") == DATE)
    daily = dates.filter("ic is not null").select("feature_id", "idx", "n", "ic")
    sign = F.create_map(*[F.lit(x) for kv in (directions or {"": 1.0}).items() for x in kv])[F.col("feature_id")]
    out = with_p(ic_summary(daily)).withColumns({"mean_ic": F.col("oriented_ic") * F.coalesce(sign, F.lit(1.0)), "icir": F.coalesce("icir", F.lit(0.0))})
    means = [F.try_divide(F.sum(f"s{k}"), F.sum(f"n{k}")).alias(f"q{k}") for k in range(1, 6)]
    whole = dates.groupBy("feature_id").agg(
        F.sum("total").alias("total"), F.sum("n").alias("valid"), F.sum("missing_feature").alias("missing_feature"), F.sum("missing_label").alias("missing_label"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.avg("exposure"))).alias("exposure"), *means,
    )
    w = Window.partitionBy("feature_id").orderBy("idx")  # a row a session
    previous = dates.filter("n > 0").select("feature_id", "idx", "top", F.lag("idx").over(w).alias("last")).filter("last is not null")
    kept = statistics.filter(F.col("gid") == LAST).select("feature_id", "idx", "last", "stayed", "autocorrelation")
    pace = previous.join(kept, ["feature_id", "idx", "last"], "left").groupBy("feature_id").agg(
        F.avg(F.when(F.col("top") > 0, 1 - F.coalesce("stayed", F.lit(0)) / F.col("top"))).alias("turnover"), F.avg("autocorrelation").alias("autocorrelation")
    )
    out = out.join(whole, "feature_id").join(pace, "feature_id", "left").withColumn("coverage", F.col("valid") / F.col("total"))
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("autocorrelation", "exposure", "turnover")})
    steps = sum((F.col(f"q{k + 1}") >= F.col(f"q{k}")).cast("int") for k in range(1, 5))
    out = out.withColumns({"monotone": steps / 4, "gross": F.col("q5") - F.col("q1")}).withColumn("spread", F.col("gross") - F.col("turnover") * cost)
    years = ic_segments(daily.withColumn("year", year), F.col("year"), "year")
    regimes = statistics.filter((F.col("gid") == REGIME) & (F.col("n") > 0)).select("feature_id", "idx", "regime")
    by_regime = ic_segments(daily.join(regimes, ["feature_id", "idx"]), F.col("regime"), "regime")
    industries = ic_segments(statistics.filter((F.col("gid") == INDUSTRY) & F.col("industry").isNotNull() & F.col("ic").isNotNull()), F.col("industry"), "industry")
    for segments, name in ((years, "year"), (by_regime, "regime"), (industries, "industry")):
        out = out.join(_worst(segments, name), "feature_id", "left")
    return out.drop("worst_regime", "worst_regime_ic")


def factor_report(panel: DataFrame, trials: DataFrame, year: Column, directions: dict[str, float] | None = None, q: float = 0.1, limit: float = 0.8, least: int = 5, **gates: float) -> DataFrame:
    """Every trial with its diagnostics, q value, pair correlations and one decision.

    trials: feature_id, family, simplicity, place. A trial is REJECTED for its coverage, significance,
    direction or as redundant beside a simpler one of its family, else CANDIDATE; none is left out.
    The panel is read once, its ranked rows are written once and deleted when statistics and pairs are written.
    """
    ranked = written(ranked_panel(panel, directions), "ranked-panel")
    statistics = written(session_statistics(ranked, least), "session-statistics")
    pairs = written(pair_correlations(ranked, trials.select("feature_id", "family")), "pair-correlations")
    discard(ranked)
    rows = summarized(statistics, year, directions).withColumn("trial_id", F.col("feature_id"))
    rows = select_factors(false_discovery(rows), q=q, **gates).join(trials, "feature_id")
    dropped = drop_redundant(pairs, rows.withColumn("rejected", ~F.col("selected")), limit)
    each = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("feature_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("feature_id"), F.col("a").alias("other")))).alias("e"), "correlation")
    near = each.groupBy("e.feature_id").agg(F.array_sort(F.collect_list(F.struct("e.other", "correlation"))).alias("pairs"))
    rows = rows.join(near, "feature_id", "left").join(dropped.select(F.col("dropped").alias("feature_id"), F.col("kept").alias("redundant_to")), "feature_id", "left")
    reasons = F.when(F.col("redundant_to").isNotNull(), "REDUNDANT").otherwise(F.col("reasons"))
    return rows.withColumn("reasons", reasons).withColumn("selected", F.col("reasons") == "").withColumn("decision", F.when(F.col("selected"), "CANDIDATE").otherwise("REJECTED"))


def grouped_ic(daily: DataFrame, by: list[str]) -> DataFrame:
    """Sessions and mean correlation overall and by each of `by`, in one pass of grouping sets."""
    sets = [(F.lit("overall"), F.lit("all")), *[(F.lit(b), F.col(b).cast("string")) for b in by]]
    rows = daily.withColumn("s", F.explode(F.array(*[F.struct(k.alias("segment"), v.alias("key")) for k, v in sets])))
    return rows.groupBy("s.segment", "s.key").agg(F.count("*").alias("dates"), F.avg("ic").alias("mean_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"))


def coefficient_stability(coefficients: DataFrame) -> DataFrame:
    """Mean, deviation and share of the dominant sign of each feature's coefficients over folds."""
    c = F.col("coefficient")
    best = F.greatest(F.count_if(c > 0), F.count_if(c < 0), F.count_if(c == 0)) / F.count("*")
    return coefficients.groupBy("feature_id").agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd"), best.alias("sign_share"))


def verify_losses(predictions: DataFrame, stated: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Mean squared error by fold against the stated one; missing folds on either side are wrong."""
    own = predictions.groupBy("fold").agg(F.avg(F.pow(F.col("label") - F.col("prediction"), 2)).alias("loss"))
    both = own.join(stated, "fold", "full_outer")
    fine = F.coalesce(F.abs(F.col("loss") - F.col("stated")) <= tolerance * F.abs("stated"), F.lit(False))
    return both.withColumn("agrees", fine)


def tail_attribution(scores: DataFrame, k: int) -> DataFrame:
    """By session: mean label of all, of the k best and the k worst scores, excess and spread."""
    from .windows import ordinal_ranks

    rows = ordinal_ranks(scores.filter(finite("score", "label")))
    x = rows.groupBy("idx").agg(F.avg("label").alias("universe"), F.avg(F.when(F.col("top") <= k, F.col("label"))).alias("best"), F.avg(F.when(F.col("bottom") <= k, F.col("label"))).alias("worst"))
    return x.withColumn("excess", F.col("best") - F.col("universe")).withColumn("spread", F.col("best") - F.col("worst"))


def event_summary(events: DataFrame) -> DataFrame:
    """Events and symbols by rule and action."""
    return events.groupBy("rule", "action").agg(F.count("*").alias("events"), F.count_distinct("symbol").alias("symbols"))


def annual_gap(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Difference of two portfolios' annual returns; a year that one lacks is flagged, not dropped.

    by: keys of the pair, where many pairs are compared at once.
    """
    key = [*(by or []), "year"]
    both = a.select(*key, F.col("annual").alias("a")).join(b.select(*key, F.col("annual").alias("b")), key, "full_outer")
    return both.withColumn("gap", F.col("a") - F.col("b")).withColumn("complete", F.col("a").isNotNull() & F.col("b").isNotNull())


def prior_rank_correlation(features: DataFrame) -> DataFrame:
    """Correlation of ranks with those of the same symbols at the session before, by feature."""
    rows = average_rank(features.filter(finite("value")), "value", ["feature_id", "idx"], "r")
    w = Window.partitionBy("feature_id").orderBy("idx")
    dates = rows.select("feature_id", "idx").distinct().withColumn("previous", F.lag("idx").over(w)).filter("previous is not null")
    before = rows.select("feature_id", F.col("idx").alias("previous"), "symbol", F.col("r").alias("rp"))
    both = rows.join(dates, ["feature_id", "idx"]).join(before, ["feature_id", "previous", "symbol"])
    return both.groupBy("feature_id", "idx").agg(rank_corr("r", "rp").alias("autocorrelation"), F.count("*").alias("n"))
