"""Window and cross-section transforms over long tables keyed by (symbol, idx).

idx is the number of a session; lookbacks count sessions. A window with a gap gives null.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.sources.scratch import written


def own(*by: str):
    """A symbol's sessions in order."""
    return Window.partitionBy(*(by or ("symbol",))).orderBy("idx")


def frame(n: int):
    """The last n rows of a symbol."""
    return own().rowsBetween(1 - n, 0)


def complete(n: int) -> Column:
    """True where the last n sessions, this one included, are all there."""
    return F.col("idx") - F.lag("idx", n - 1).over(own()) == n - 1


def adjusted(bars: DataFrame) -> DataFrame:
    return bars.withColumn("p", F.col("close") * F.col("adj"))


def momentum(bars: DataFrame, n: int) -> DataFrame:
    """Adjusted close over that n sessions earlier, less 1."""
    return adjusted(bars).select("symbol", "idx", F.when(complete(n + 1), F.col("p") / F.lag("p", n).over(own()) - 1).alias("value"))


def reversal(bars: DataFrame, n: int) -> DataFrame:
    return momentum(bars, n).withColumn("value", -F.col("value"))


def returns(bars: DataFrame) -> DataFrame:
    return adjusted(bars).withColumn("r", F.when(complete(2), F.col("p") / F.lag("p").over(own()) - 1))


def volatility(bars: DataFrame, n: int) -> DataFrame:
    """Sample deviation of the last n returns."""
    return returns(bars).select("symbol", "idx", F.when(complete(n + 1), F.stddev_samp("r").over(frame(n))).alias("value"))


def rolling_drawdown(bars: DataFrame, n: int) -> DataFrame:
    """Worst fall below the peak, the peak starting anew in every window.

    Rows of a symbol are cut in blocks of n, so a window is the end of one block and the start of the next. Falls
    compose: the worst of both parts, or from the peak of the first to the lowest of the second. Starts and ends of
    blocks are running aggregates, so a row costs the same whatever n is.
    """
    rows = adjusted(bars).withColumn("_n", F.row_number().over(own()) - 1).withColumn("_block", F.floor(F.col("_n") / n))
    start, end = (Window.partitionBy("symbol", "_block").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col("_n"), F.desc("_n")))
    rows = rows.withColumn("_fall", F.col("p") / F.max("p").over(start) - 1).withColumn("_rise", F.min("p").over(end) / F.col("p") - 1)
    rows = rows.withColumns({"_first_worst": F.min("_fall").over(start), "_first_low": F.min("p").over(start)})
    rows = rows.withColumns({"_last_worst": F.min("_rise").over(end), "_last_peak": F.max("p").over(end)})
    before = [F.lag(c, n - 1).over(own()) for c in ("_last_worst", "_last_peak")] if n > 1 else [F.lit(0.0), F.lit(None)]
    across = F.when(F.col("_n") % n < n - 1, F.least(before[0], F.col("_first_low") / before[1] - 1))
    return rows.select("symbol", "idx", F.when(complete(n), F.least(F.lit(0.0), "_first_worst", across)).alias("value"))


def rolling_mean(rows: DataFrame, column: str, n: int) -> DataFrame:
    """Mean of n sessions; null if any is null or missing."""
    return rows.select("symbol", "idx", F.when(complete(n) & (F.count(column).over(frame(n)) == n), F.avg(column).over(frame(n))).alias("value"))


SLICE = 4096
"""Rows of a symbol that one call for its medians takes, besides those before that its windows reach."""


def log_rolling_median(rows: DataFrame, column: str, n: int) -> DataFrame:
    """log1p of the median of n sessions; null if any is null or missing.

    A symbol's rows are cut in slices, each with the n - 1 rows before it, so a long history is spread over tasks.
    Inside a slice the window is a sorted list that one row enters and one leaves.
    """
    size = max(SLICE, 4 * n)
    placed = rows.select("symbol", "idx", F.col(column).cast("double").alias("x"), complete(n).alias("whole"), (F.row_number().over(own()) - 1).alias("n"))
    k = F.floor(F.col("n") / size)
    near = F.array_compact(F.array(k, F.when(F.col("n") % size > size - n, k + 1)))
    kinds = rows.select("symbol", "idx").schema
    out = T.StructType([*kinds.fields, T.StructField("value", T.DoubleType())])

    def medians(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n")
        part["value"] = part["x"].rolling(n, min_periods=n).median().where(part["whole"].fillna(False).astype(bool))
        return part.loc[part["n"] // size == key[1], out.names]

    found = placed.withColumn("slice", F.explode(near)).groupBy("symbol", "slice").applyInPandas(medians, out)
    return found.select("symbol", "idx", F.log1p("value").alias("value"))


def amihud(bars: DataFrame, n: int) -> DataFrame:
    """Mean of the absolute raw return over the amount; null if an amount isn't positive."""
    each = F.abs(F.col("close") / F.col("previous_close") - 1) / F.col("amount")
    rows = bars.withColumn("x", F.when(F.col("amount") > 0, each))
    return rows.select("symbol", "idx", F.when(complete(n) & (F.count("x").over(frame(n)) == n), F.avg("x").over(frame(n))).alias("value"))


def window_gaps(bars: DataFrame, n: int) -> DataFrame:
    """Whether a window of n sessions is complete, gapped or too short."""
    first = F.lag("idx", n - 1).over(own())
    return bars.select("symbol", "idx", F.when(first.isNull(), "INSUFFICIENT_HISTORY").when(F.col("idx") - first > n - 1, "MISSING_TRADING_SESSION").otherwise("COMPLETE").alias("state"))


def factor_rows(universe: DataFrame, wide: DataFrame, reasons: dict[str, str]) -> DataFrame:
    """One row for each universe key and factor; a key without a bar has nulls and MISSING_TRADING_SESSION.

    reasons: the factors, each with the column of `wide` that tells why it is null (B23): a gap in its window first,
    then too short a history, then its source.
    """
    joined = universe.join(wide.withColumn("_bar", F.lit(True)), ["symbol", "idx"], "left")
    long = joined.unpivot(["symbol", "idx", "_bar", *reasons.values()], list(reasons), "feature_id", "value")
    why = F.coalesce(*[F.when(F.col("feature_id") == n, F.col(c)) for n, c in reasons.items()])
    reason = F.when(F.col("_bar").isNull(), "MISSING_TRADING_SESSION").when(F.col("value").isNull(), why)
    return long.select("symbol", "idx", "feature_id", "value", reason.alias("null_reason"))


def incremental(rows: DataFrame, since: int, lookback: int, transform) -> DataFrame:
    """A windowed transform for sessions from `since` on, reading only `lookback` sessions before."""
    return transform(rows.filter(F.col("idx") >= since - lookback)).filter(F.col("idx") >= since)


def average_rank(rows: DataFrame, value: str, by: list[str], name: str = "rank") -> DataFrame:
    """Rank in a group, ties sharing their mean rank."""
    w = Window.partitionBy(*by).orderBy(value)
    ties = F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow))  # one sort serves both
    return rows.withColumn(name, F.rank().over(w) + (ties - 1) / 2)


def percentile_rank(rows: DataFrame, value: str, by: list[str], name: str = "target") -> DataFrame:
    """(average rank - 1) / (n - 1), 0.5 for a single row."""
    n = F.count("*").over(Window.partitionBy(*by))
    ranked = average_rank(rows, value, by, "_r")
    return ranked.withColumn(name, F.when(n > 1, F.try_divide(F.col("_r") - 1, n - 1)).otherwise(0.5)).drop("_r")


def fifth(rank: Column, n: Column) -> Column:
    """Bucket 1 to 5 of an average rank among n."""
    return F.least(F.lit(5), F.greatest(F.lit(1), (F.floor((rank - 1) * 5 / n) + 1).cast("int")))


def quintile(rows: DataFrame, value: str, by: list[str], name: str = "quintile") -> DataFrame:
    """Bucket 1 to 5 from the average rank."""
    n = F.count("*").over(Window.partitionBy(*by))
    ranked = average_rank(rows, value, by, "_r")
    return ranked.withColumn(name, fifth(F.col("_r"), n)).drop("_r")


def bucket_turnover(rows: DataFrame, bucket: str = "quintile", top: int = 5) -> DataFrame:
    """Share of a date's top bucket that wasn't there on the date before, by feature.

    A member was there if its own last date in the bucket is the feature's date before: one window, no self join.
    """
    dates = rows.groupBy("feature_id", "idx").agg(F.count("*").alias("_all")).withColumn("previous", F.lag("idx").over(Window.partitionBy("feature_id").orderBy("idx")))  # a row a date
    own_last = F.lag("idx").over(Window.partitionBy("feature_id", "symbol").orderBy("idx"))
    held = rows.filter(F.col(bucket) == top).select("feature_id", "idx", "symbol").withColumn("_last", own_last)
    counted = held.groupBy("feature_id", "idx", "_last").agg(F.count("*").alias("_n"))  # few last dates a date
    met = counted.join(dates.filter("previous is not null").select("feature_id", "idx", "previous"), ["feature_id", "idx"])
    stay = F.coalesce(F.sum(F.when(F.col("_last") == F.col("previous"), F.col("_n"))), F.lit(0))
    return met.groupBy("feature_id", "idx").agg((1 - stay / F.sum("_n")).alias("turnover"))


def drawdown(equity: DataFrame, run: str = "run", order: str = "idx") -> DataFrame:
    """Running peak and the fall below it."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return equity.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def admission(bars: DataFrame, listed: DataFrame, sessions: int = 12, window: int = 6, least: int = 5, recent: int = 3, amount: float = 0) -> DataFrame:
    """Reasons why a symbol isn't admitted at a session: too new, traded too rarely, too small.

    listed: symbol and the session of its listing. The window counts sessions of the calendar.
    """
    w = own().rangeBetween(1 - window, 0)
    r = own().rangeBetween(1 - recent, 0)
    s = F.sort_array(F.collect_list("amount").over(r))
    rows = bars.join(listed, "symbol").withColumn("age", F.col("idx") - F.col("listed")).withColumn("active", F.count("*").over(w)).withColumn("last", F.count("*").over(r)).withColumn("median", (s[F.floor((F.size(s) - 1) / 2).cast("int")] + s[F.floor(F.size(s) / 2).cast("int")]) / 2)
    reasons = F.array_compact(F.array(F.when(F.col("age") < sessions, "TOO_NEW"), F.when(F.col("active") < least, "RARELY_TRADED"), F.when((F.col("last") < recent) | (F.col("median") < amount), "LOW_AMOUNT")))
    return rows.select("symbol", "idx", "age", "active", "median", F.array_join(reasons, ",").alias("reasons"))


def weekly_decisions(calendar: DataFrame) -> DataFrame:
    """The last open date of each ISO week, at 18:00."""
    week = (F.extract(F.lit("YEAROFWEEK"), "date").alias("iso_year"), F.extract(F.lit("WEEK"), "date").alias("iso_week"))
    return calendar.groupBy(*week).agg(F.max("date").alias("date")).withColumn("decision", F.concat(F.col("date").cast("string"), F.lit(" 18:00:00")))


def walk_forward(dates: DataFrame, train: int, validation: int, test: int, step: int, purge: int = 0, embargo: int = 0) -> DataFrame:
    """(fold, idx, role): expanding training dates, a purge gap, validation, an embargo gap, test.

    The number of a date comes from one small calendar table.
    """
    n = dates.withColumn("k", F.row_number().over(Window.orderBy("idx")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    rest = purge + validation + embargo + test
    folds = F.when(F.col("n") >= train + rest, F.sequence(F.lit(0), F.floor((F.col("n") - train - rest) / step).cast("int")))
    rows = n.select("idx", "k", F.explode(folds).alias("fold"))
    end = F.lit(train) + F.col("fold") * step
    v, t = end + purge, end + purge + validation + embargo
    k = F.col("k")
    role = F.when(k < end, "train").when((k >= v) & (k < v + validation), "validation").when((k >= t) & (k < t + test), "test")
    return rows.select("fold", "idx", role.alias("role")).filter("role is not null")


def ordinal_ranks(rows: DataFrame, score: str = "score") -> DataFrame:
    """Unique ranks from the top and from the bottom, ties by symbol."""
    w = Window.partitionBy("idx")
    return rows.withColumn("top", F.row_number().over(w.orderBy(F.desc(score), "symbol"))).withColumn("bottom", F.row_number().over(w.orderBy(score, "symbol")))


def crossover(bars: DataFrame, short: int, long: int) -> DataFrame:
    """1 where the short mean is above the long mean, 0 before the long window fills."""
    signal = F.when((F.count("close").over(frame(long)) == long) & (F.avg("close").over(frame(short)) > F.avg("close").over(frame(long))), 1).otherwise(0)
    return bars.select("symbol", "idx", signal.alias("signal"))


def breakers(equity: DataFrame, worst_position: str = "position", total: float = -0.2, day: float = -0.08, position: float = -0.15) -> DataFrame:
    """The first limit that a session breaks: drawdown, day loss, position loss."""
    w = Window.partitionBy("run").orderBy("idx")
    rows = drawdown(equity).withColumn("change", F.col("equity") / F.lag("equity").over(w) - 1)
    rule = F.when(F.col("drawdown") <= total, "DRAWDOWN").when(F.col("change") <= day, "DAY_LOSS").when(F.col(worst_position) <= position, "POSITION_LOSS")
    return rows.select("run", "idx", rule.alias("rule"))


def fifo(orders: DataFrame) -> DataFrame:
    """Which bought lots each sell consumes, oldest first; a lot bought that day stays untouched.

    orders: symbol, seq, day, side, shares, price; seq rises with the day. A sell takes at most what was
    bought on earlier days and isn't sold yet; the rest of it finds no lot.

    With Q the running sum of sells and B what was bought before a sell's day, the sum of what sells
    could take is Q + min(0, least B - Q so far). So lots and sells are both ranges of one running
    quantity; their ends, sorted, cut it into pieces of one lot and one sell. No pairs are made.
    """
    w = Window.partitionBy("symbol").orderBy("day", "seq")
    far = w.rowsBetween(Window.unboundedPreceding, 0)
    bought, sold = (F.when(F.col("side") == x, F.col("shares")).otherwise(0) for x in ("BUY", "SELL"))
    rows = orders.withColumn("_b", F.sum(bought).over(far)).withColumn("_q", F.sum(sold).over(far))
    earlier = Window.partitionBy("symbol").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_room", F.when(F.col("side") == "SELL", F.coalesce(F.sum(bought).over(earlier), F.lit(0)) - F.col("_q")))
    taken = F.col("_q") + F.least(F.lit(0), F.min("_room").over(far))
    lot, sell = F.struct(F.col("seq").alias("buy_seq"), F.col("price").alias("buy_price")), F.struct(F.col("seq").alias("sell_seq"))
    is_lot = F.col("side") == "BUY"
    ends = rows.select("symbol", F.when(is_lot, F.col("_b")).otherwise(taken).alias("end"), "side", "seq", F.when(is_lot, lot).alias("lot"), F.when(~is_lot, sell).alias("sell"))
    # from the last end down, as a frame that only grows costs one step a row
    down = Window.partitionBy("symbol").orderBy(F.desc("end"), F.desc("side"), F.desc("seq"))
    beyond = down.rowsBetween(Window.unboundedPreceding, 0)
    # a piece ends at each end; its lot and sell are the next that reach so far
    pieces = ends.withColumn("matched", F.col("end") - F.coalesce(F.lead("end").over(down), F.lit(0)))
    pieces = pieces.withColumn("lot", F.last("lot", ignorenulls=True).over(beyond)).withColumn("sell", F.last("sell", ignorenulls=True).over(beyond))
    hit = pieces.filter((F.col("matched") > 0) & F.col("lot").isNotNull() & F.col("sell").isNotNull())
    return hit.select("symbol", "sell.sell_seq", "lot.buy_seq", "matched", "lot.buy_price")


def numbered(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """rows with n, their place from 0 among the rows of their group in a given order; ties are in any order.

    Rows are dealt by ranges of (group, order), so a huge group lies in many parts and many small ones share one.
    A row's place is its place within its part and group, and the counts of that group's earlier parts. No task
    sorts a whole group and nothing is broadcast: a group has one count a part, and rows meet them by a shuffle.
    Parts are fixed by a written table, for ranges that a second run samples may differ.
    """
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", 33))
    counts = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a part
    starts = counts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_p"), (before - F.col("_first")).alias("_start"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    joined = dealt.join(starts, [F.col("_part") == F.col("_p"), *same])
    return joined.select(*rows.columns, (F.col("_at") + F.col("_start")).alias("n"))


def signal_changes(signals: DataFrame) -> DataFrame:
    """Sessions whose signal differs from that before; the first counts if it isn't 0."""
    before = F.coalesce(F.lag("signal").over(own()), F.lit(0))
    return signals.withColumn("before", before).filter(F.col("signal") != F.col("before"))
