"""Queries of the factor evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import factors as O

from .registry import query
from .window_queries import rounded

_RANKED = """r AS (SELECT *, rank() OVER (PARTITION BY feature_id, idx ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, idx, value) - 1) / 2.0 AS rv,
  rank() OVER (PARTITION BY feature_id, idx ORDER BY label) + (count(*) OVER (PARTITION BY feature_id, idx, label) - 1) / 2.0 AS rl FROM panel WHERE value IS NOT NULL AND label IS NOT NULL)"""
_DAILY = _RANKED + """, d0 AS (SELECT feature_id, idx, count(*) AS n, $rank_corr(rv rl) AS ic, any_value(regime) AS regime FROM r GROUP BY feature_id, idx),
  d AS (SELECT * FROM d0 WHERE n >= 5 AND ic IS NOT NULL)"""
_SUMMARY = _DAILY + ", s AS (SELECT feature_id, avg(ic) AS mean_ic, avg(ic) AS oriented_ic, stddev_pop(ic) AS sd, avg(CAST(ic > 0 AS DOUBLE)) AS positive, count(*) AS dates FROM d GROUP BY feature_id)"
_QUINT = _RANKED + ", q AS (SELECT symbol, feature_id, idx, label, least(5, greatest(1, floor((rv - 1) * 5 / count(*) OVER (PARTITION BY feature_id, idx)) + 1)) AS k FROM r), qm AS (SELECT feature_id, " + ", ".join(f"avg(CASE WHEN k = {k} THEN label END) AS q{k}" for k in range(1, 6)) + " FROM q GROUP BY feature_id)"


@query("d02_daily_rank_ic", f"WITH {_DAILY} SELECT feature_id, idx, n, round(ic, 8) + 0e0 AS ic FROM d")
def _(v):
    return rounded(O.daily_rank_ic(v("panel")), "ic")


@query("d03_ic_summary", f"WITH {_SUMMARY} SELECT feature_id, round(mean_ic, 8) AS mean_ic, round(oriented_ic, 8) AS oriented_ic, round(sd, 8) AS sd, round(positive, 8) AS positive, dates, round(oriented_ic / sd, 6) AS icir, round(oriented_ic * sqrt(dates) / sd, 6) AS z FROM s")
def _(v):
    s = O.ic_summary(O.daily_rank_ic(v("panel")))
    return rounded(rounded(s, "mean_ic", "oriented_ic", "sd", "positive"), "icir", "z", n=6)


# erfc(x) by the series x^(2n+1) / gamma(n + 3/2), all of whose terms are positive
_P = "CASE WHEN sd = 0 THEN CASE WHEN oriented_ic <> 0 THEN 0e0 ELSE 1e0 END WHEN oriented_ic = 0 THEN 1e0 WHEN abs({z}) > 9 THEN 0e0 ELSE 1 - list_sum(list_transform(range(0, 200), lambda n: exp(-pow({z}, 2) / 2 + (2 * n + 1) * ln(abs({z}) / sqrt(2)) - lgamma(n + 1.5)))) END".format(z="(oriented_ic * sqrt(dates) / sd)")


@query("d03_p_values", f"WITH {_SUMMARY} SELECT feature_id, round(oriented_ic * sqrt(dates) / sd, 6) AS z, round({_P}, 8) AS p_value FROM s")
def _(v):
    s = O.with_p(O.ic_summary(O.daily_rank_ic(v("panel")))).select("feature_id", "z", "p_value")
    return rounded(rounded(s, "p_value"), "z", n=6)


@query("d04_coverage", "SELECT feature_id, count(*) AS total, count(*) FILTER (value IS NOT NULL AND label IS NOT NULL) AS valid, count(*) FILTER (value IS NULL) AS missing_feature, count(*) FILTER (label IS NULL) AS missing_label FROM panel GROUP BY feature_id")
def _(v):
    return O.coverage(v("panel"))


_Q5 = ", ".join(f"round(q{k}, 8) AS q{k}" for k in range(1, 6))
_MONO = "(CAST(q2 >= q1 AS INT) + CAST(q3 >= q2 AS INT) + CAST(q4 >= q3 AS INT) + CAST(q5 >= q4 AS INT)) / 4"


_TURN = """dd AS (SELECT feature_id, idx, lag(idx) OVER (PARTITION BY feature_id ORDER BY idx) AS previous FROM (SELECT DISTINCT feature_id, idx FROM q)),
  tn AS (SELECT t.feature_id, t.idx, 1 - count(p.symbol) / count(*) AS turnover FROM q t JOIN dd ON dd.feature_id = t.feature_id AND dd.idx = t.idx AND dd.previous IS NOT NULL LEFT JOIN q p ON p.feature_id = t.feature_id AND p.idx = dd.previous AND p.symbol = t.symbol AND p.k = 5 WHERE t.k = 5 GROUP BY 1, 2),
  tm AS (SELECT feature_id, avg(turnover) AS turnover FROM tn GROUP BY 1)"""


@query("d05_quintile_report", f"WITH {_QUINT}, {_TURN} SELECT feature_id, {_Q5}, {_MONO} AS monotone, round(q5 - q1, 8) AS gross, round(coalesce(turnover, 0), 8) AS turnover, round(q5 - q1 - coalesce(turnover, 0) * 0.0015, 8) AS spread FROM qm LEFT JOIN tm USING (feature_id)")
def _(v):
    return rounded(O.quintile_report(v("panel")), "q1", "q2", "q3", "q4", "q5", "gross", "turnover", "spread")


@query("d06_year_segments", f"WITH {_DAILY} SELECT feature_id, CAST(floor(idx / 13) AS BIGINT) AS year, CAST(sum(n) AS BIGINT) AS observations, round(avg(ic), 8) AS mean_ic FROM d GROUP BY 1, 2")
def _(v):
    return rounded(O.ic_segments(O.daily_rank_ic(v("panel")), F.floor(F.col("idx") / 13), "year"), "mean_ic")


@query("d07_regime_segments", f"WITH {_DAILY} SELECT feature_id, regime, CAST(sum(n) AS BIGINT) AS observations, round(avg(ic), 8) AS mean_ic FROM d GROUP BY 1, 2")
def _(v):
    daily = O.daily_rank_ic(v("panel")).join(v("panel").select("idx", "regime").distinct(), "idx")
    return rounded(O.ic_segments(daily, F.col("regime"), "regime"), "mean_ic")


@query("d08_industry_segments", """WITH r AS (SELECT *, rank() OVER (PARTITION BY feature_id, idx, industry ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, idx, industry, value) - 1) / 2.0 AS rv,
  rank() OVER (PARTITION BY feature_id, idx, industry ORDER BY label) + (count(*) OVER (PARTITION BY feature_id, idx, industry, label) - 1) / 2.0 AS rl FROM panel WHERE value IS NOT NULL AND label IS NOT NULL),
  d AS (SELECT feature_id, idx, industry, count(*) AS n, $rank_corr(rv rl) AS ic FROM r GROUP BY 1, 2, 3)
  SELECT feature_id, industry, CAST(sum(n) AS BIGINT) AS observations, round(avg(ic), 8) AS mean_ic FROM d WHERE n >= 3 AND ic IS NOT NULL GROUP BY 1, 2""")
def _(v):
    return rounded(O.industry_segments(v("panel")), "mean_ic")


@query("d09_size_exposure", "WITH d AS (SELECT feature_id, idx, CASE WHEN stddev_pop(value) > 0 AND stddev_pop(size) > 0 THEN covar_pop(value, size) / (stddev_pop(value) * stddev_pop(size)) END AS c FROM panel WHERE value IS NOT NULL AND size IS NOT NULL GROUP BY 1, 2) SELECT feature_id, round(greatest(-1, least(1, avg(c))), 8) AS exposure FROM d GROUP BY 1")
def _(v):
    return rounded(O.size_exposure(v("panel")), "exposure")


def _family(features):
    return features.select("feature_id").distinct().withColumn("family", F.when(F.col("feature_id").startswith("mom"), "momentum").otherwise("size"))


_PAIRS = """f AS (SELECT *, CASE WHEN feature_id LIKE 'mom%' THEN 'momentum' ELSE 'size' END AS family FROM feature WHERE value IS NOT NULL),
  b AS (SELECT x.family, x.feature_id AS a, y.feature_id AS b, x.idx, x.value AS va, y.value AS vb FROM f x JOIN f y ON x.family = y.family AND x.symbol = y.symbol AND x.idx = y.idx AND x.feature_id < y.feature_id),
  k AS (SELECT *, rank() OVER (PARTITION BY a, b, idx ORDER BY va) + (count(*) OVER (PARTITION BY a, b, idx, va) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY a, b, idx ORDER BY vb) + (count(*) OVER (PARTITION BY a, b, idx, vb) - 1) / 2.0 AS rb FROM b),
  c AS (SELECT family, a, b, idx, $rank_corr(ra rb) AS c FROM k GROUP BY 1, 2, 3, 4)"""


@query("d10_pair_correlations", f"WITH {_PAIRS} SELECT family, a, b, round(avg(c), 8) AS correlation, count(*) AS dates FROM c WHERE c IS NOT NULL GROUP BY 1, 2, 3")
def _(v):
    f = v("feature")
    return rounded(O.pair_correlations(f, _family(f)), "correlation")


_TRIALS = "t AS (SELECT symbol AS trial_id, 1e0 / (1 + (symbol * 7919) % 1009) AS p_value FROM (SELECT DISTINCT symbol FROM bar))"


def _trials(v):
    return v("bar").select(F.col("symbol").alias("trial_id")).distinct().withColumn("p_value", 1 / (1 + (F.col("trial_id") * 7919) % 1009))


_BH = _TRIALS + ", k AS (SELECT *, row_number() OVER (ORDER BY p_value, trial_id) AS rank, count(*) OVER () AS n FROM t), h AS (SELECT trial_id, p_value, CAST(rank AS INTEGER) AS rank, least(1, min(p_value * n / rank) OVER (ORDER BY rank DESC)) AS q_value FROM k)"


@query("d11_false_discovery", f"WITH {_BH} SELECT trial_id, round(p_value, 12) AS p_value, rank, round(q_value, 10) AS q_value FROM h")
def _(v):
    return rounded(O.false_discovery(_trials(v)), "q_value", n=10).withColumn("p_value", F.round("p_value", 12))


@query("d12_select_factors", f"WITH {_SUMMARY}, c AS (SELECT feature_id, count(*) FILTER (value IS NOT NULL AND label IS NOT NULL) / count(*) AS coverage FROM panel GROUP BY 1), x AS (SELECT s.*, c.coverage, abs(oriented_ic) * 2 AS q_value FROM s JOIN c USING (feature_id)) SELECT feature_id, concat_ws(',', CASE WHEN coverage < 0.6 THEN 'LOW_COVERAGE' END, CASE WHEN q_value > 0.05 THEN 'NOT_SIGNIFICANT' END, CASE WHEN oriented_ic <= 0 OR positive < 0.5 THEN 'INCONSISTENT' END) AS reasons, NOT (coverage < 0.6 OR q_value > 0.05 OR oriented_ic <= 0 OR positive < 0.5) AS selected FROM x")
def _(v):
    p = v("panel")
    s = O.ic_summary(O.daily_rank_ic(p)).join(O.coverage(p), "feature_id").withColumn("coverage", F.col("valid") / F.col("total")).withColumn("q_value", F.abs("oriented_ic") * 2)
    return O.select_factors(s).select("feature_id", "reasons", "selected")


_TRIAL = "tr AS (SELECT feature_id, family, CAST(length(feature_id) AS INTEGER) AS simplicity, row_number() OVER (ORDER BY feature_id) AS place FROM (SELECT DISTINCT feature_id, CASE WHEN feature_id LIKE 'mom%' THEN 'momentum' ELSE 'size' END AS family FROM feature))"
_WALK = """cc AS (SELECT family, a, b, avg(c) AS correlation FROM c WHERE c IS NOT NULL GROUP BY 1, 2, 3),
  o AS (SELECT cc.family, a, b, CASE WHEN row(x.simplicity, a) > row(y.simplicity, b) THEN a ELSE b END AS loser, CASE WHEN row(x.simplicity, a) > row(y.simplicity, b) THEN b ELSE a END AS winner, row_number() OVER (PARTITION BY cc.family ORDER BY least(x.place, y.place), greatest(x.place, y.place)) AS k FROM cc JOIN tr x ON x.feature_id = a JOIN tr y ON y.feature_id = b WHERE abs(correlation) >= 0.1 AND NOT EXISTS (SELECT 1 FROM rj WHERE rejected AND rj.feature_id IN (a, b))),
  w AS (SELECT DISTINCT family, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS gone, CAST(NULL AS VARCHAR) AS dropped, CAST(NULL AS VARCHAR) AS kept FROM o UNION ALL
    SELECT w.family, o.k, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone ELSE list_append(gone, loser) END, CASE WHEN NOT list_contains(gone, a) AND NOT list_contains(gone, b) THEN loser END, CASE WHEN NOT list_contains(gone, a) AND NOT list_contains(gone, b) THEN winner END FROM w JOIN o ON o.family = w.family AND o.k = w.k + 1)"""


def _trial(v):
    """Family, simplicity and place of each factor."""
    t = v("feature").select("feature_id").distinct().withColumn("family", F.when(F.col("feature_id").startswith("mom"), "momentum").otherwise("size"))
    return t.withColumn("simplicity", F.length("feature_id")).withColumn("place", F.row_number().over(Window.orderBy("feature_id")))  # a row a factor


@query("d13_drop_redundant", f"WITH RECURSIVE {_PAIRS}, {_TRIAL}, rj AS (SELECT feature_id, count(value) / count(*) < 0.5 AS rejected FROM feature GROUP BY 1), {_WALK} SELECT family, dropped, kept FROM w WHERE dropped IS NOT NULL")
def _(v):
    f = v("feature")
    rejected = f.groupBy("feature_id").agg((F.count("value") / F.count("*") < 0.5).alias("rejected"))
    return O.drop_redundant(O.pair_correlations(f, _family(f)), _trial(v).join(rejected, "feature_id"), 0.1)


_DIAGNOSTICS = f"""{_SUMMARY.replace("n >= 5", "n >= 3")}, {_QUINT.removeprefix(_RANKED + ", ")}, {_TURN},
  cv AS (SELECT feature_id, count(*) AS total, count(*) FILTER (value IS NOT NULL AND label IS NOT NULL) AS valid, count(*) FILTER (value IS NULL) AS missing_feature, count(*) FILTER (label IS NULL) AS missing_label FROM panel GROUP BY 1),
  ad AS (SELECT feature_id, idx, lag(idx) OVER (PARTITION BY feature_id ORDER BY idx) AS previous FROM (SELECT DISTINCT feature_id, idx FROM r)),
  ae AS (SELECT x.feature_id, x.idx, $rank_corr(x.rv p.rv) AS c FROM r x JOIN ad ON ad.feature_id = x.feature_id AND ad.idx = x.idx JOIN r p ON p.feature_id = x.feature_id AND p.idx = ad.previous AND p.symbol = x.symbol GROUP BY 1, 2),
  ac AS (SELECT feature_id, avg(c) AS autocorrelation FROM ae GROUP BY 1),
  se AS (SELECT feature_id, idx, CASE WHEN stddev_pop(value) > 0 AND stddev_pop(size) > 0 THEN covar_pop(value, size) / (stddev_pop(value) * stddev_pop(size)) END AS c FROM r WHERE size IS NOT NULL GROUP BY 1, 2),
  sx AS (SELECT feature_id, greatest(-1, least(1, avg(c))) AS exposure FROM se GROUP BY 1),
  yy AS (SELECT feature_id, CAST(floor(idx / 13) AS BIGINT) AS year, sum(n) AS observations, avg(ic) AS m FROM d GROUP BY 1, 2), yw AS (SELECT feature_id, count(*) AS years, arg_min(CAST(year AS VARCHAR), row(m, CAST(year AS VARCHAR))) AS worst_year, min(m) AS worst_year_ic FROM yy GROUP BY 1),
  gg AS (SELECT feature_id, count(DISTINCT regime) AS regimes FROM d GROUP BY 1),
  ir AS (SELECT *, rank() OVER (PARTITION BY feature_id, idx, industry ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, idx, industry, value) - 1) / 2.0 AS iv, rank() OVER (PARTITION BY feature_id, idx, industry ORDER BY label) + (count(*) OVER (PARTITION BY feature_id, idx, industry, label) - 1) / 2.0 AS il FROM panel WHERE value IS NOT NULL AND label IS NOT NULL AND industry IS NOT NULL),
  id AS (SELECT feature_id, idx, industry, count(*) AS n, $rank_corr(iv il) AS ic FROM ir GROUP BY 1, 2, 3),
  ii AS (SELECT feature_id, industry, round(avg(ic), 10) AS m FROM id WHERE n >= 3 AND ic IS NOT NULL GROUP BY 1, 2), iw AS (SELECT feature_id, count(*) AS industries, arg_min(CAST(industry AS VARCHAR), row(m, CAST(industry AS VARCHAR))) AS worst_industry, min(m) AS worst_industry_ic FROM ii GROUP BY 1),
  dg AS (SELECT s.feature_id, total, valid, missing_feature, missing_label, valid / total AS coverage, mean_ic, oriented_ic, sd, dates, CASE WHEN sd = 0 THEN 0 ELSE oriented_ic / sd END AS icir, positive, {_P} AS p_value, q1, q2, q3, q4, q5, {_MONO} AS monotone, q5 - q1 AS gross, coalesce(turnover, 0) AS turnover, q5 - q1 - coalesce(turnover, 0) * 0.0015 AS spread, coalesce(autocorrelation, 0) AS autocorrelation, coalesce(exposure, 0) AS exposure, years, regimes, coalesce(industries, 0) AS industries, worst_year, worst_year_ic, worst_industry, worst_industry_ic
    FROM s JOIN cv USING (feature_id) JOIN qm USING (feature_id) LEFT JOIN tm USING (feature_id) LEFT JOIN ac USING (feature_id) LEFT JOIN sx USING (feature_id) LEFT JOIN yw USING (feature_id) LEFT JOIN gg USING (feature_id) LEFT JOIN iw USING (feature_id))"""
_COUNTS = ["total", "valid", "missing_feature", "missing_label", "dates", "years", "regimes", "industries"]
_ROUNDED = ["coverage", "mean_ic", "oriented_ic", "positive", "p_value", "q1", "q2", "q3", "q4", "q5", "monotone", "gross", "turnover", "spread", "autocorrelation", "exposure", "worst_year_ic", "worst_industry_ic"]
def _year():
    return F.floor(F.col("idx") / 13)


def _sized(rows):
    return rows.withColumns({c: F.coalesce(F.size(c), F.lit(0)).cast("bigint") for c in ("years", "regimes", "industrys")}).withColumnRenamed("industrys", "industries")


@query("d14_factor_diagnostics", f"WITH {_DIAGNOSTICS} SELECT feature_id, {', '.join(_COUNTS)}, {', '.join(f'round({c}, 8) AS {c}' for c in _ROUNDED)}, round(icir, 6) AS icir, worst_year, worst_industry FROM dg")
def _(v):
    rows = _sized(O.diagnostics(v("panel"), _year(), least=3))
    return rounded(rounded(rows, *_ROUNDED), "icir", n=6).select("feature_id", *_COUNTS, *_ROUNDED, "icir", "worst_year", "worst_industry")


_DECIDED = """bh AS (SELECT *, row_number() OVER (ORDER BY p_value, feature_id) AS rank, count(*) OVER () AS m FROM dg), fd AS (SELECT *, least(1, min(p_value * m / rank) OVER (ORDER BY rank DESC)) AS q_value FROM bh),
  de AS (SELECT *, concat_ws(',', CASE WHEN coverage < 0.6 THEN 'LOW_COVERAGE' END, CASE WHEN q_value > 0.9 THEN 'NOT_SIGNIFICANT' END, CASE WHEN oriented_ic <= -1 OR positive < 0.2 THEN 'INCONSISTENT' END) AS reasons FROM fd), rj AS (SELECT feature_id, reasons <> '' AS rejected FROM de)"""
_DECIDED = _DECIDED.replace("oriented_ic <= -1 OR positive < 0.2", "oriented_ic <= 0 OR positive < 0.2")


@query("d14_factor_report", f"WITH RECURSIVE {_DIAGNOSTICS}, {_PAIRS}, {_TRIAL}, {_DECIDED}, {_WALK} SELECT de.feature_id, round(p_value, 8) AS p_value, round(q_value, 8) AS q_value, CASE WHEN w.kept IS NOT NULL THEN 'REDUNDANT' ELSE reasons END AS reasons, w.kept AS redundant_to, CASE WHEN w.kept IS NULL AND reasons = '' THEN 'CANDIDATE' ELSE 'REJECTED' END AS decision FROM de LEFT JOIN w ON w.dropped = de.feature_id")
def _(v):
    rows = O.factor_report(v("panel"), _trial(v), _year(), q=0.9, limit=0.1, least=3, consistent=0.2)
    return rounded(rows.select("feature_id", "p_value", "q_value", "reasons", "redundant_to", "decision"), "p_value", "q_value")


@query("d15_grouped_ic", f"WITH {_DAILY}, f AS (SELECT *, CAST(idx % 3 AS VARCHAR) AS fold, CAST(floor(idx / 13) AS BIGINT) AS year FROM d WHERE feature_id = 'log_amount') SELECT CASE WHEN GROUPING(fold) = 0 THEN 'fold' WHEN GROUPING(year) = 0 THEN 'year' ELSE 'overall' END AS segment, coalesce(fold, CAST(year AS VARCHAR), 'all') AS key, count(*) AS dates, round(avg(ic), 8) AS mean_ic, round(avg(CAST(ic > 0 AS DOUBLE)), 8) AS positive FROM f GROUP BY GROUPING SETS ((), (fold), (year))")
def _(v):
    d = O.daily_rank_ic(v("panel").filter("feature_id = 'log_amount'")).withColumn("fold", F.col("idx") % 3).withColumn("year", F.floor(F.col("idx") / 13))
    return rounded(O.grouped_ic(d, ["fold", "year"]), "mean_ic", "positive")


@query("d16_coefficient_stability", f"WITH {_DAILY}, c AS (SELECT feature_id, round(ic, 10) AS ic FROM d) SELECT feature_id, round(avg(ic), 8) AS mean, round(stddev_pop(ic), 8) AS sd, round(greatest(count(*) FILTER (ic > 0), count(*) FILTER (ic < 0), count(*) FILTER (ic = 0)) / count(*), 8) AS sign_share FROM c GROUP BY 1")
def _(v):
    return rounded(O.coefficient_stability(O.daily_rank_ic(v("panel")).select("feature_id", F.round("ic", 10).alias("coefficient"))), "mean", "sd", "sign_share")


@query("d17_verify_losses", "WITH p AS (SELECT idx % 4 AS fold, label, value AS prediction FROM panel WHERE feature_id = 'mom_3' AND value IS NOT NULL AND label IS NOT NULL), o AS (SELECT fold, avg(pow(label - prediction, 2)) AS loss FROM p GROUP BY 1), s AS (SELECT fold, CASE WHEN fold = 1 THEN loss * 1.01 ELSE loss END AS stated FROM o WHERE fold <> 2 UNION ALL SELECT 9, 1.0) SELECT coalesce(o.fold, s.fold) AS fold, round(loss, 8) AS loss, round(stated, 8) AS stated, coalesce(abs(loss - stated) <= 1e-9 * abs(stated), false) AS agrees FROM o FULL JOIN s ON o.fold = s.fold")
def _(v):
    p = v("panel").filter("feature_id = 'mom_3' and value is not null and label is not null").select((F.col("idx") % 4).alias("fold"), "label", F.col("value").alias("prediction"))
    own = p.groupBy("fold").agg(F.avg(F.pow(F.col("label") - F.col("prediction"), 2)).alias("stated"))
    stated = own.filter("fold <> 2").withColumn("stated", F.when(F.col("fold") == 1, F.col("stated") * 1.01).otherwise(F.col("stated")))
    stated = stated.unionByName(own.limit(1).select(F.lit(9).cast("long").alias("fold"), F.lit(1.0).alias("stated")))
    return rounded(O.verify_losses(p, stated, 1e-9), "loss", "stated")


_TAIL = "k AS (SELECT s.idx, s.score, l.label, row_number() OVER (PARTITION BY s.idx ORDER BY score DESC, s.symbol) AS top, row_number() OVER (PARTITION BY s.idx ORDER BY score, s.symbol) AS bottom FROM score s JOIN label l ON l.symbol = s.symbol AND l.idx = s.idx WHERE label IS NOT NULL), t AS (SELECT idx, avg(label) AS universe, avg(CASE WHEN top <= 10 THEN label END) AS best, avg(CASE WHEN bottom <= 10 THEN label END) AS worst FROM k GROUP BY idx)"


@query("d18_tail_attribution", f"WITH {_TAIL} SELECT idx, round(universe, 8) AS universe, round(best, 8) AS best, round(worst, 8) AS worst, round(best - universe, 8) AS excess, round(best - worst, 8) AS spread FROM t")
def _(v):
    return rounded(O.tail_attribution(v("score").join(v("label"), ["symbol", "idx"]), 10), "universe", "best", "worst", "excess", "spread")


@query("d19_event_summary", "SELECT event_type AS rule, CASE WHEN value > 20 THEN 'REJECT' ELSE 'SCALE' END AS action, count(*) AS events, count(DISTINCT user_id) AS symbols FROM events GROUP BY 1, 2")
def _(v):
    return O.event_summary(v("events").select(F.col("event_type").alias("rule"), F.when(F.col("value") > 20, "REJECT").otherwise("SCALE").alias("action"), F.col("user_id").alias("symbol")))


@query("d20_annual_gap", "WITH y AS (SELECT run, CAST(floor(idx / 13) AS BIGINT) AS year, max_by(equity, idx) / min_by(equity, idx) - 1 AS annual FROM equity GROUP BY 1, 2), a AS (SELECT run AS pair, year, annual FROM y), b AS (SELECT run + 1 AS pair, year, annual FROM y WHERE year > 0) SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.year, b.year) AS year, round(a.annual, 8) AS a, round(b.annual, 8) AS b, round(a.annual - b.annual, 8) AS gap, a.annual IS NOT NULL AND b.annual IS NOT NULL AS complete FROM a FULL JOIN b ON a.pair = b.pair AND a.year = b.year")
def _(v):
    """Every run beside the run before it."""
    y = v("equity").groupBy("run", F.floor(F.col("idx") / 13).alias("year")).agg((F.max_by("equity", "idx") / F.min_by("equity", "idx") - 1).alias("annual"))
    return rounded(O.annual_gap(y.withColumnRenamed("run", "pair"), y.filter("year > 0").select((F.col("run") + 1).alias("pair"), "year", "annual"), ["pair"]), "a", "b", "gap")


@query("c22_prior_rank_correlation", "WITH k AS (SELECT *, rank() OVER (PARTITION BY feature_id, idx ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, idx, value) - 1) / 2.0 AS r FROM feature WHERE value IS NOT NULL), d AS (SELECT feature_id, idx, lag(idx) OVER (PARTITION BY feature_id ORDER BY idx) AS previous FROM (SELECT DISTINCT feature_id, idx FROM k)) SELECT k.feature_id, k.idx, round($rank_corr(k.r p.r), 8) + 0e0 AS autocorrelation, count(*) AS n FROM k JOIN d ON d.feature_id = k.feature_id AND d.idx = k.idx JOIN k p ON p.feature_id = k.feature_id AND p.idx = d.previous AND p.symbol = k.symbol GROUP BY 1, 2")
def _(v):
    return rounded(O.prior_rank_correlation(v("feature")), "autocorrelation")
