"""Point-in-time tables: clocks, visibility, canonical projections, as-of joins, state replay.

Clocks are day numbers or timestamps; a fact is visible at a decision if its available clock
isn't later. Checks return violations; the caller decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import numbered

# The named availability policies.
OBSERVED = ("observed_master_snapshot", "observed_membership_snapshot")
MIDNIGHT_OBSERVED = ("observed_calendar_snapshot", "source_snapshot_observed_at")


def content_id(prefix: str, *columns: str) -> Column:
    """Prefix and SHA-256 of the columns joined by a bar; nulls are empty."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256))


def _at(date: Column, clock: str) -> Column:
    return F.to_timestamp(F.concat(date.cast("string"), F.lit(f" {clock}")))


def availability(policy: Column, event: Column, observed: Column, announced: Column, actually: Column) -> Column:
    """(event_time, available_at) by policy. event, announced and actually are dates, observed a timestamp."""
    first = F.coalesce(actually, announced)

    def by_notice(day: Column) -> Column:
        return F.when(day.isNull(), observed).otherwise(F.least(_at(day, "18:00:00"), observed))

    when = F.when(policy.isin(*OBSERVED), observed).when(policy == "trade_date_close_plus_provider_delay", _at(event, "15:00:00")).otherwise(_at(event, "00:00:00"))
    seen = (
        F.when(policy.isin(*OBSERVED) | policy.isin(*MIDNIGHT_OBSERVED), observed)
        .when(policy == "trade_date_close_plus_provider_delay", _at(event, "16:00:00"))
        .when(policy == "known_before_trade_date_open", _at(event, "09:25:00"))
        .when(policy == "announcement_date_or_observed", by_notice(announced))
        .when(policy == "financial_actual_announcement_or_observed", by_notice(first))
    )
    return F.struct(when.alias("event_time"), seen.alias("available_at"))


def canonical(raw: DataFrame, business: list[str], schema_id: str, quarantined: list[str]) -> DataFrame:
    """Adds a record id, the schema and a quality status; some endpoints are quarantined."""
    status = F.when(F.col("endpoint").isin(*quarantined), "QUARANTINED").otherwise("ACCEPTED")
    return raw.withColumn("schema_id", F.lit(schema_id)).withColumn("record_id", content_id("record_", "schema_id", "endpoint", *business)).withColumn("quality_status", status)


def visible(facts: DataFrame, decision: Column, effective: str | None = None) -> DataFrame:
    """Accepted facts that a decision can know."""
    out = facts.filter((F.col("quality_status") == "ACCEPTED") & (F.col("available_at") <= decision))
    return out.filter(F.col(effective) <= decision) if effective else out


def normalized_units(rows: DataFrame) -> DataFrame:
    """Volume from hands of 100 (truncated), amount from thousands, a missing previous close as 0."""
    return rows.withColumn("volume", (F.col("volume_hands") * 100).cast("bigint")).withColumn("amount", F.col("amount_thousand") * 1000).withColumn("previous_close", F.coalesce("previous_close", F.lit(0.0)))


def lifecycle_events(master: DataFrame) -> DataFrame:
    """LISTED, DELISTED where known, and NAME_STATUS from a row of the security master."""
    none = F.lit(None).cast("boolean")
    events = F.array(
        F.struct(F.lit("LISTED").alias("kind"), F.col("list_day").alias("effective"), none.alias("is_st")),
        F.struct(F.lit("DELISTED").alias("kind"), F.col("delist_day").alias("effective"), none.alias("is_st")),
        F.struct(F.lit("NAME_STATUS").alias("kind"), F.col("observed_day").alias("effective"), F.contains(F.upper("name"), F.lit("ST")).alias("is_st")),
    )
    rows = master.select("symbol", "observed_day", F.explode(F.filter(events, lambda e: e["effective"].isNotNull())).alias("e"))
    return rows.select("symbol", "e.kind", "e.effective", F.least("e.effective", "observed_day").alias("available"), "e.is_st")


def first_trades(bars: DataFrame) -> DataFrame:
    """The first bar of each symbol as an event."""
    return bars.groupBy("symbol").agg(F.min("idx").alias("effective")).withColumn("kind", F.lit("FIRST_TRADED"))


def dividend_events(rows: DataFrame) -> DataFrame:
    """The announcement of a plan, and of its carrying out where dated; the plan has no dates of that."""
    plan = F.struct(F.lit("PLAN_ANNOUNCED").alias("kind"), F.col("plan_day").alias("available"), F.lit(None).cast("int").alias("ex_day"))
    done = F.struct(F.lit("IMPLEMENTATION_ANNOUNCED").alias("kind"), F.col("implemented_day").alias("available"), F.col("ex_day").cast("int").alias("ex_day"))
    return rows.select("symbol", "cash", F.explode(F.filter(F.array(plan, done), lambda e: e["available"].isNotNull())).alias("e")).select("symbol", "cash", "e.*")


def typed_versions(rows: DataFrame, keys: dict[str, str], metrics: list[str]) -> DataFrame:
    """A statement's rows as typed versions: keys by name and type, metrics as doubles.

    A value that doesn't convert is null here and a violation in typing_violations.
    """
    return rows.select(*[F.col(k).try_cast(t).alias(k) for k, t in keys.items()], *[F.col(m).try_cast("double").alias(m) for m in metrics])


def typing_violations(rows: DataFrame, types: dict[str, str], required: list[str]) -> DataFrame:
    """One row for each field of a row that is missing or has the wrong type."""
    bad = [F.when(F.col(c).isNull(), F.lit(f"{c}:MISSING")) if c in required else F.lit(None) for c in types]
    bad += [F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(f"{c}:WRONG_TYPE")) for c, t in types.items()]
    return rows.select("row_id", F.explode(F.array_compact(F.array(*bad))).alias("violation"))


def weight_violations(rows: DataFrame) -> DataFrame:
    """Index weights that aren't finite and positive."""
    w = F.col("weight")
    return rows.filter(w.isNull() | F.isnan(w) | (w <= 0) | (F.abs(w) == float("inf")))


def weight_batches(rows: DataFrame, most: int = 1000, low: float = 95, high: float = 105) -> DataFrame:
    """A batch is one index and date, with less than `most` rows and weights that sum to about 100."""
    g = rows.groupBy("batch").agg(F.count_distinct("index_code").alias("codes"), F.count_distinct("day").alias("days"), F.count("*").alias("n"), F.sum("weight").alias("total"))
    why = F.array_compact(F.array(F.when(F.col("codes") > 1, "MIXED_INDEX"), F.when(F.col("days") > 1, "MIXED_DATE"), F.when(F.col("n") >= most, "ROW_CAP"), F.when(~F.col("total").between(low, high), "WEIGHT_SUM")))
    return g.select("batch", "n", "total", F.array_join(why, ",").alias("violations"))


def interval_violations(rows: DataFrame) -> DataFrame:
    """Intervals that end before they start; an open end is fine."""
    return rows.filter(F.col("effective_to").isNotNull() & (F.col("effective_to") < F.col("effective_from")))


def date_precision(millis: Column, zone: str = "Asia/Shanghai") -> Column:
    """DATE_ONLY for a timestamp at local midnight."""
    local = F.from_utc_timestamp(F.timestamp_millis(millis), zone)
    return F.when(F.date_trunc("day", local) == local, "DATE_ONLY").otherwise("EXACT_MILLISECOND")


def id_chunks(ids: DataFrame, column: str, by: str, size: int = 1000) -> DataFrame:
    """Sorted distinct numeric ids of each `by` in chunks of `size`, with a digest of each chunk."""
    rows = numbered(ids.select(by, column).distinct(), [by], [column]).withColumn("chunk", F.floor(F.col("n") / size))
    joined = F.array_join(F.sort_array(F.collect_list(F.col(column).cast("bigint"))).cast("array<string>"), "|")
    return rows.groupBy(by, "chunk").agg(F.count("*").alias("n"), F.sha2(joined, 256).alias("digest"))


def field_lineage(frame: DataFrame, sources: dict[str, tuple[str, str]]) -> DataFrame:
    """One row for each output field that has a source: the upstream field, how it is derived, and how many
    rows and values it has; a field that the frame lacks is an error."""
    absent = [c for c in sources if c not in frame.columns]
    if absent:
        raise ValueError(f"no such fields: {absent}")
    counts = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(u).alias("upstream"), F.lit(t).alias("transformation"), F.count("*").alias("rows"), F.count(c).alias("valued")) for c, (u, t) in sources.items()])
    return frame.agg(counts.alias("f")).select(F.explode("f").alias("f")).select("f.*")


def round14(c: str) -> Column:
    """A double with 14 significant digits, by its exact binary value.

    Formatting rounds the shortest decimal text of a double, which is wrong where that text has 15 digits and
    ends in 5: the double lies a little beside it. There the error of x * 10^p is computed exactly (Dekker's
    product), for magnitudes of 1e-8 to 1e13.
    """
    x = F.abs(F.col(c))
    p = F.lit(14.0) - F.floor(F.log10(x))
    y = F.pow(F.lit(10.0), p)
    near = F.round(x * y)  # 15 digits
    tie = p.between(1, 22) & (near % 10 == 5) & (F.try_divide(near, y) == x)

    def halves(v: Column) -> tuple[Column, Column]:
        big = v * 134217729.0
        return big - (big - v), v - (big - (big - v))

    (xh, xl), (yh, yl) = halves(x), halves(y)
    rest = ((xh * yh - x * y) + xh * yl + xl * yh) + xl * yl
    beside = (near - x * y) - rest  # positive where x is below the text
    even = F.when((near - 5) % 20 == 0, near - 5).otherwise(near + 5)
    tens = F.when(beside > 0, near - 5).when(beside < 0, near + 5).otherwise(even)
    exact = F.signum(c) * F.try_divide(tens / 10, F.pow(F.lit(10.0), p - 1))
    return F.when(tie, exact).otherwise(F.format_string("%.13e", F.col(c)).cast("double"))


def safe_scalars(rows: DataFrame) -> DataFrame:
    """Inverse of a positive ratio, percent as a share, log of a positive value."""
    return rows.withColumn("inverse", F.when(F.col("ratio") > 0, F.try_divide(F.lit(1.0), F.col("ratio")))).withColumn("share", F.col("percent") / 100).withColumn("log_value", F.when(F.col("value") > 0, F.ln(F.col("value") * 10000)))


# Reasons why a factor is null, here and in factor_rows.
def null_reasons(rows: DataFrame, needed: int, value: Column | None = None, source: Column | None = None, rule: str = "other") -> Column:
    """Why a factor is null: a missing session, too short a history, then source or denominator.

    Without a value only the reasons of the window. rule: denominator (null or not positive), mean (a
    source value is missing), amount (not positive), share (null or not valid), other (not valid).
    """
    window = F.when((F.col("calendar_sessions") >= needed) & (F.col("present") < needed), "MISSING_TRADING_SESSION").when(F.col("present") < needed, "INSUFFICIENT_HISTORY")
    if value is None:
        return window.alias("window_reason")
    if rule in ("denominator", "share"):
        other = F.when(source.isNull(), "SOURCE_VALUE_MISSING").otherwise({"denominator": "NON_POSITIVE_DENOMINATOR", "share": "SOURCE_VALUE_INVALID"}[rule])
    else:
        other = F.lit({"mean": "SOURCE_VALUE_MISSING", "amount": "NON_POSITIVE_AMOUNT", "other": "SOURCE_VALUE_INVALID"}[rule])
    return F.when(value.isNull(), F.coalesce(window, other)).alias("null_reason")


def fold_replays(rows: DataFrame, key: list[str], material: list[str], record: str) -> DataFrame:
    """One row for each key: the smallest record id, how many records, and whether their material differs."""
    differ = F.count_distinct(F.struct(*material)) > 1
    kept = F.min_by(F.struct(*material), record)
    g = rows.groupBy(*key).agg(F.min(record).alias(record), F.count("*").alias("records"), differ.alias("conflict"), kept.alias("m"))
    return g.select(*key, record, "records", "conflict", "m.*")


def as_of(versions: DataFrame, keys: DataFrame, order: list[str], payload: list[str], clock: str = "available", at: str = "day", by: str = "symbol") -> DataFrame:
    """For each key (by, at) the greatest visible version by `order`, a newer one beating an older.

    Versions and keys become one table, sorted by time within `by`, and a running maximum carries
    the best version so far: one shuffle, and no pairs of versions and keys.
    """
    best = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"p{i}") for i, c in enumerate(payload)])
    v = versions.select(by, F.col(clock).alias("_t"), F.lit(0).alias("_key"), best.alias("_v"))
    k = keys.select(by, F.col(at).alias("_t"), F.lit(1).alias("_key"), F.lit(None).cast(v.schema["_v"].dataType).alias("_v"))
    w = Window.partitionBy(by).orderBy("_t", "_key").rowsBetween(Window.unboundedPreceding, 0)
    rows = v.unionByName(k).withColumn("_best", F.max("_v").over(w)).filter("_key = 1")
    names = {**{f"o{i}": c for i, c in enumerate(order)}, **{f"p{i}": c for i, c in enumerate(payload) if c not in order}}
    return rows.select(by, F.col("_t").alias(at), *[F.col(f"_best.{k}").alias(n) for k, n in names.items()])


# Order of events of one time.
PRIORITY = {"LISTED": 0, "NAME_STATUS": 1, "DELISTED": 2}


def _state_at(events: DataFrame, points: DataFrame) -> DataFrame:
    """State of each symbol at each of a few points in time, from its events that are effective and known by then."""
    priority = F.coalesce(*[F.when(F.col("kind") == k, p) for k, p in PRIORITY.items()])
    seen = points.join(events, "symbol").filter("effective <= point and available <= point").withColumn("priority", priority)
    order = F.struct("effective", "priority", "available", "event_id")
    listing = F.col("kind") != "NAME_STATUS"
    own = Window.partitionBy("symbol", "point")
    rows = seen.withColumn("order", order).withColumn("last_listed", F.max(F.when(F.col("kind") == "LISTED", F.col("order"))).over(own))
    rows = rows.withColumn("last_end", F.max(F.when((F.col("kind") == "DELISTED") & (F.col("order") < F.col("last_listed")), F.col("order"))).over(own))
    in_spell = (F.col("kind") == "LISTED") & (F.col("last_end").isNull() | (F.col("order") > F.col("last_end")))
    g = rows.groupBy("symbol", "point").agg(
        F.min(F.when(in_spell, F.col("effective"))).alias("listed_at"),
        F.max_by("kind", F.when(listing, F.col("order"))).alias("last"),
        F.max_by("is_st", F.when(F.col("kind") == "NAME_STATUS", F.col("order"))).alias("is_st"),
    )
    return g.select("symbol", "point", "listed_at", F.coalesce(F.col("last") == "DELISTED", F.lit(False)).alias("delisted"), "is_st")


def state_intervals(events: DataFrame) -> DataFrame:
    """The states of each symbol over time: (symbol, day_from, day_to, listed_at, delisted, is_st), day_to null for the last.

    A state changes only when an event becomes visible, so states are made for those few points of a symbol, and
    points that change nothing are left out; before its first point a symbol has no state. A listing after a delisting
    starts a new spell, whose first listing is listed_at.
    """
    points = events.select("symbol", F.greatest("effective", "available").alias("point")).distinct()
    own = Window.partitionBy("symbol").orderBy("point")
    state = F.struct("listed_at", "delisted", "is_st")
    rows = _state_at(events, points).withColumn("new", F.lag("point").over(own).isNull() | ~state.eqNullSafe(F.lag(state).over(own))).filter("new")
    return rows.select("symbol", F.col("point").alias("day_from"), F.lead("point").over(own).alias("day_to"), "listed_at", "delisted", "is_st")


def replay_state(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """State of each symbol at each decision, from events that are effective and known by then.

    (symbol, day, listed_at, delisted, is_st). Each decision takes the last change of state before it, by an as-of
    merge: no pairs of decisions and events.
    """
    rows = as_of(state_intervals(events), decisions, ["day_from"], ["listed_at", "delisted", "is_st"], clock="day_from")
    return rows.select("symbol", "day", "listed_at", F.coalesce("delisted", F.lit(False)).alias("delisted"), "is_st")


def universe_panel(state: DataFrame, admission: DataFrame) -> DataFrame:
    """Every ever-listed symbol at each decision with the reasons against it; delisted ones stay."""
    rows = state.join(admission, ["symbol", "day"], "left")
    r = F.array_compact(F.array(F.when(F.col("listed_at").isNull(), "NOT_LISTED"), F.when(F.col("delisted"), "DELISTED"), F.when(F.col("is_st").isNull(), "UNKNOWN_STATUS"), F.when(F.col("is_st"), "SPECIAL_TREATMENT"), F.when(F.coalesce("active", F.lit(0)) < 5, "RARELY_TRADED")))
    return rows.select("symbol", "day", F.array_join(r, ",").alias("reasons"), (F.size(r) == 0).alias("eligible"))


def market_bundle(daily: DataFrame, factor: DataFrame, limits: DataFrame, valuation: DataFrame, key: list[str]) -> DataFrame:
    """Daily rows with factor, limits and valuation; the first required table that lacks a key is the rejection."""
    rows = daily.join(factor.withColumn("_f", F.lit(1)), key, "left").join(limits.withColumn("_l", F.lit(1)), key, "left").join(valuation, key, "left")
    return rows.withColumn("rejection", F.when(F.col("_f").isNull(), "MISSING_FACTOR").when(F.col("_l").isNull(), "MISSING_LIMIT")).drop("_f", "_l")


def suspension_overlay(bars: DataFrame, notices: DataFrame, key: list[str]) -> DataFrame:
    """Bars with a suspension notice (type S) of that key are suspended; resumptions don't count."""
    s = notices.filter("type = 'S'").select(*key).distinct().withColumn("_s", F.lit(True))
    return bars.join(s, key, "left").withColumn("is_suspended", F.coalesce("_s", F.lit(False))).drop("_s")


def label_evidence(daily: DataFrame, limits: DataFrame, suspensions: DataFrame, key: list[str]) -> DataFrame:
    """Union of the keys of three tables, the latest clock, and which table constrains the key."""
    rows = daily.join(limits, key, "full_outer").join(suspensions, key, "full_outer")
    source = F.when(F.col("suspended_at").isNotNull(), "SUSPENSION").when(F.col("limit_at").isNotNull(), "LIMIT").otherwise("DAILY")
    return rows.select(*key, F.greatest("daily_at", "limit_at", "suspended_at").alias("available"), source.alias("source"))


def offset_sessions(calendar: DataFrame, entry: int = 1, exit_: int = 21) -> DataFrame:
    """For each session those entry and exit steps later in the calendar; null past its end."""
    n = calendar.select("idx", F.row_number().over(Window.orderBy("idx")).alias("k"))  # the calendar is small
    e, x = (n.select((F.col("k") - d).alias("k"), F.col("idx").alias(name)) for d, name in ((entry, "entry"), (exit_, "exit")))
    return n.join(e, "k", "left").join(x, "k", "left").select("idx", "entry", "exit")


# Reasons why there is no label.
def forward_labels(bars: DataFrame, benchmark: DataFrame, sessions: DataFrame) -> DataFrame:
    """Excess open-to-open return from entry to exit, or the first reason that there is none."""
    b = bars.select("symbol", F.col("idx"), "open", "suspended", "limit_up", "limit_down")
    en = b.toDF("symbol", "entry", "entry_open", "entry_suspended", "entry_up", "_ed")
    ex = b.toDF("symbol", "exit", "exit_open", "exit_suspended", "_xu", "exit_down")
    m = benchmark.select("idx", "open")
    rows = bars.select("symbol", "idx").join(F.broadcast(sessions), "idx").join(en, ["symbol", "entry"], "left").join(ex, ["symbol", "exit"], "left")
    rows = rows.join(m.toDF("entry", "bench_entry"), "entry", "left").join(m.toDF("exit", "bench_exit"), "exit", "left")
    reason = (
        F.when(F.col("entry").isNull(), "NO_ENTRY_SESSION").when(F.col("exit").isNull(), "NO_EXIT_SESSION")
        .when(F.col("entry_open").isNull(), "MISSING_ENTRY_BAR").when(F.col("entry_suspended"), "ENTRY_SUSPENDED")
        .when(F.col("entry_up").isNull(), "MISSING_ENTRY_LIMIT").when(F.col("entry_open") >= F.col("entry_up"), "ENTRY_LIMIT_UP")
        .when(F.col("exit_open").isNull(), "MISSING_EXIT_BAR").when(F.col("exit_suspended"), "EXIT_SUSPENDED")
        .when(F.col("exit_down").isNull(), "MISSING_EXIT_LIMIT").when(F.col("exit_open") <= F.col("exit_down"), "EXIT_LIMIT_DOWN")
        .when(F.col("bench_entry").isNull() | F.col("bench_exit").isNull(), "BENCHMARK_MISSING")
    )
    value = F.col("exit_open") / F.col("entry_open") - F.col("bench_exit") / F.col("bench_entry")
    return rows.withColumn("reason", reason).select("symbol", "idx", "entry", "exit", F.when(F.col("reason").isNull(), value).alias("label"), "reason")


def label_clocks(labels: DataFrame, clocks: list[str]) -> DataFrame:
    """Entry and exit at 09:30; available at the latest of the exit day's 18:00 and the source clocks."""
    at = F.greatest(_at(F.col("exit_date"), "18:00:00"), *[F.col(c) for c in clocks])
    return labels.withColumn("entry_at", _at(F.col("entry_date"), "09:30:00")).withColumn("exit_at", _at(F.col("exit_date"), "09:30:00")).withColumn("available_at", F.when(F.col("exit_date").isNotNull(), at))


def last_known(bars: DataFrame, grid: DataFrame, value: str = "close") -> DataFrame:
    """On each (symbol, idx) of a grid the last known value; volume 0 where there is no bar."""
    w = Window.partitionBy("symbol").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.join(bars.select("symbol", "idx", value, "volume"), ["symbol", "idx"], "left")
    return rows.select("symbol", "idx", F.last(value, ignorenulls=True).over(w).alias(value), F.coalesce("volume", F.lit(0)).cast("bigint").alias("volume"))


def next_open(calendar: DataFrame, published: DataFrame) -> DataFrame:
    """The first open session after each publication day."""
    c = calendar.select(F.col("day").alias("open_day")).distinct()
    rows = published.select(F.col("day").alias("t"), F.lit(1).alias("is_key"), F.lit(None).cast("int").alias("o")).distinct().unionByName(c.select(F.col("open_day").alias("t"), F.lit(0).alias("is_key"), F.col("open_day").cast("int").alias("o")))
    w = Window.orderBy(F.desc("t"), F.desc("is_key")).rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    return published.join(rows.withColumn("next_open", F.min("o").over(w)).filter("is_key = 1").select(F.col("t").alias("day"), "next_open"), "day")


def admission_clock(rows: DataFrame, opens: DataFrame) -> DataFrame:
    """Usable from the later of the source clock and the listing; a date-only source from the next open."""
    r = rows.join(opens.select("day", "next_open").distinct(), "day", "left")
    source = F.when(F.col("precision") == "DATE_ONLY", F.col("next_open")).otherwise(F.col("day"))
    return r.withColumn("usable_from", F.greatest(source, F.col("listed_day")))


def range_overlap(snapshots: DataFrame, start: int, end: int) -> DataFrame:
    """Rows whose closed range [start, end] meets the asked one; both bounds reach the scan."""
    return snapshots.filter((F.col("start") <= end) & (F.col("end") >= start))


def _cover(lo: Column, hi: Column, levels: Column) -> Column:
    """The fewest dyadic nodes (level, place) that make up [lo, hi) of 0 to 2^levels: at most two a level."""

    def at(j: Column) -> Column:
        step = F.pow(F.lit(2.0), j)
        left, right = F.ceil(lo / step), F.floor(hi / step)
        some = left < right
        return F.array(F.when(some & (left % 2 == 1), F.struct(j.alias("level"), left.alias("node"))), F.when(some & (right % 2 == 1), F.struct(j.alias("level"), (right - 1).alias("node"))))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), levels), at)))


def overlapping(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """C20: pairs of half-open intervals [start, end) of one key that intersect; a null end never ends.

    Of two that intersect the later start lies in the other. So starts meet intervals, once each way: an interval
    is cut in dyadic nodes, at most 2 log n, an open end included, and a start lies in one node of each of log n
    levels. A start and an interval share one node at most, so pairs come once, and a key with many intervals is
    spread over its nodes. Starts and ends are whole numbers; n is the span of all starts.
    """
    starts = a.select("start").unionByName(b.select("start"))
    span = starts.agg(F.min("start").alias("_least"), F.max("start").alias("_most"))
    span = F.broadcast(span.select("_least", "_most", F.ceil(F.log2(F.col("_most") - F.col("_least") + 2)).cast("int").alias("_levels")))  # one row

    def sides(points: DataFrame, p: str, intervals: DataFrame, q: str, after: int) -> DataFrame:
        x = points.select(by, F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end")).join(span)
        at = F.col(f"{p}_start") - F.col("_least")
        x = x.select(by, f"{p}_start", f"{p}_end", F.explode(F.transform(F.sequence(F.lit(0), F.col("_levels")), lambda j: F.struct(j.alias("level"), F.floor(at / F.pow(F.lit(2.0), j)).alias("node")))).alias("_n"))
        y = intervals.select(by, F.col("start").alias(f"{q}_start"), F.col("end").alias(f"{q}_end")).join(span)
        last = F.col("_most") + 1
        lo, hi = F.col(f"{q}_start") + after - F.col("_least"), F.coalesce(F.least(F.col(f"{q}_end"), last), last) - F.col("_least")
        y = y.select(by, f"{q}_start", f"{q}_end", F.explode(_cover(lo, hi, F.col("_levels"))).alias("_n"))
        met = x.select(by, "_n.level", "_n.node", f"{p}_start", f"{p}_end").join(y.select(by, "_n.level", "_n.node", f"{q}_start", f"{q}_end"), [by, "level", "node"])
        return met.select(by, "a_start", "a_end", "b_start", "b_end")

    pairs = sides(a, "a", b, "b", 0).unionByName(sides(b, "b", a, "a", 1))
    return pairs.filter((F.col("b_end").isNull() | (F.col("a_start") < F.col("b_end"))) & (F.col("a_end").isNull() | (F.col("b_start") < F.col("a_end"))))


def resolve_sources(base: DataFrame, supplement: DataFrame, registry: DataFrame) -> DataFrame:
    """The base's value if it has one, else the supplement's, else a stable registry's; with its source."""
    rows = base.join(supplement.withColumnRenamed("value", "v2"), "id", "left").join(registry.withColumnRenamed("value", "v3"), "id", "left")
    def of(source: str, value: str) -> Column:
        return F.struct(F.lit(source).alias("source"), F.col(value).alias("value"))

    pick = F.when(F.col("value").isNotNull(), of("BASE", "value")).when(F.col("v2").isNotNull(), of("SUPPLEMENT", "v2")).when(F.col("v3").isNotNull() & F.col("stable"), of("REGISTRY", "v3"))
    return rows.select("id", F.coalesce(pick["source"], F.lit("NONE")).alias("source"), pick["value"].alias("value"))


def first_trade_fallback(bars: DataFrame, listed: DataFrame) -> DataFrame:
    """C17: symbols that trade and were never listed, with their earliest bar."""
    return bars.join(listed.select("symbol").distinct(), "symbol", "left_anti").groupBy("symbol").agg(F.min("idx").alias("first_idx"), F.min_by("open", "idx").alias("open"))
