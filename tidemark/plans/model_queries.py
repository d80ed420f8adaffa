"""Queries of the preprocessing and model operators, and of the text jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import models as M
from tidemark.operators import text as X

from .registry import query
from .window_queries import rounded

_FIT = """tr AS (SELECT f.fold, p.feature_id, p.symbol, p.idx, p.value FROM feature p JOIN fold f ON f.idx = p.idx AND f.role = 'train'),
  q AS (SELECT fold, feature_id, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM tr GROUP BY 1, 2),
  fit AS (SELECT tr.fold, tr.feature_id, max(low) AS low, max(high) AS high, median(CASE WHEN value IS NOT NULL THEN greatest(low, least(high, value)) END) AS median FROM tr JOIN q ON q.fold = tr.fold AND q.feature_id = tr.feature_id GROUP BY 1, 2)"""
_Z = _FIT + """, te AS (SELECT f.fold, p.feature_id, p.symbol, p.idx, p.value, CASE WHEN p.value IS NOT NULL THEN greatest(t.low, least(t.high, p.value)) END AS c, t.median FROM feature p JOIN fold f ON f.idx = p.idx AND f.role = 'test' JOIN fit t ON t.fold = f.fold AND t.feature_id = p.feature_id),
  fl AS (SELECT *, coalesce(c, median(c) OVER (PARTITION BY fold, feature_id, idx), median) AS f FROM te),
  z AS (SELECT fold, feature_id, symbol, idx, CAST(value IS NULL AS INTEGER) AS missing, CASE WHEN stddev_pop(f) OVER w > 0 THEN (f - avg(f) OVER w) / stddev_pop(f) OVER w ELSE 0 END AS z FROM fl WINDOW w AS (PARTITION BY fold, feature_id, idx))"""


@query("c11_fold_rows", "SELECT fold, f.idx, symbol, round(score, 8) AS score FROM score s JOIN fold f ON f.idx = s.idx AND f.role = 'validation'")
def _(v):
    return rounded(M.fold_rows(v("score"), v("fold"), "validation").select("fold", "idx", "symbol", "score"), "score")


@query("d26_fold_fit", f"WITH {_FIT} SELECT fold, feature_id, round(low, 8) AS low, round(high, 8) AS high, round(median, 8) AS median FROM fit")
def _(v):
    return rounded(M.fit_bounds(v("feature"), v("fold")), "low", "high", "median")


@query("d27_neutral_fit", "WITH g AS (SELECT feature_id, idx, var_pop(size) AS vv, covar_pop(size, value) AS c, avg(size) AS mx, avg(value) AS my FROM panel WHERE value IS NOT NULL AND size IS NOT NULL GROUP BY 1, 2) SELECT feature_id, idx, round(CASE WHEN vv > 0 THEN c / vv ELSE 0 END, 8) AS slope, round(my - CASE WHEN vv > 0 THEN c / vv ELSE 0 END * mx, 8) AS intercept FROM g")
def _(v):
    return rounded(M.neutral_fit(v("panel"), ["feature_id", "idx"]), "slope", "intercept")


@query("e11_transform", f"WITH {_Z} SELECT fold, feature_id, symbol, idx, missing, round(z, 6) AS z FROM z")
def _(v):
    return rounded(M.transform(v("feature"), v("fold"), M.fit_bounds(v("feature"), v("fold")), "test"), "z", n=6)


@query("c08_join_violations", "SELECT symbol, idx, feature_id, 'MISSING' AS violation FROM bar, (SELECT DISTINCT feature_id FROM feature) WHERE symbol = 4 AND feature_id = 'mom_3' UNION ALL SELECT symbol, idx, feature_id, 'DUPLICATE' FROM feature WHERE symbol = 5 AND feature_id = 'mom_6' UNION ALL SELECT symbol, idx, feature_id, 'FUTURE' FROM feature WHERE symbol = 6 AND idx % 10 = 0")
def _(v):
    f = v("feature").filter("not (symbol = 4 and feature_id = 'mom_3')")
    f = f.unionAll(f.filter("symbol = 5 and feature_id = 'mom_6'"))
    return M.join_violations(v("bar"), f, (F.col("symbol") == 6) & (F.col("idx") % 10 == 0))


_MATRIX = "x AS (SELECT b.symbol, b.idx, max(CASE WHEN feature_id = 'mom_3' THEN value END) AS mom_3, max(CASE WHEN feature_id = 'mom_6' THEN value END) AS mom_6, max(CASE WHEN feature_id = 'log_amount' THEN value END) AS log_amount, any_value(l.label) AS label FROM bar b LEFT JOIN feature f ON f.symbol = b.symbol AND f.idx = b.idx LEFT JOIN label l ON l.symbol = b.symbol AND l.idx = b.idx WHERE NOT b.suspended GROUP BY 1, 2)"
NAMES = ["mom_3", "mom_6", "log_amount"]


def _matrix(v):
    return M.training_matrix(v("bar").filter("not suspended").select("symbol", "idx"), v("feature"), v("label"), NAMES)


@query("c09_training_matrix", f"WITH {_MATRIX} SELECT symbol, idx, round(mom_3, 8) AS mom_3, round(mom_6, 8) AS mom_6, round(log_amount, 8) AS log_amount, round(label, 8) AS label FROM x")
def _(v):
    return rounded(_matrix(v), *NAMES, "label")


@query("c10_score_frame", f"WITH {_Z} SELECT z.fold, z.feature_id, z.symbol, z.idx, z.missing, round(z.z, 6) AS z, round(l.label, 8) AS label FROM z JOIN bar b ON b.symbol = z.symbol AND b.idx = z.idx AND NOT b.suspended LEFT JOIN label l ON l.symbol = z.symbol AND l.idx = z.idx")
def _(v):
    return rounded(rounded(M.score_frame(v("bar").filter("not suspended"), v("feature"), v("label"), v("fold")), "z", n=6), "label")


def _rows(v):
    """The rows of the training matrix from the table that has features as columns already."""
    return v("wide").join(v("bar0").filter("not suspended").select("symbol", "idx"), ["symbol", "idx"], "left_semi")


def _complete(v):
    return _rows(v).filter("mom_3 is not null and mom_6 is not null and label is not null")


@query("d28_ridge")
def _(v):
    return M.ridge(_complete(v), v("fold"), NAMES)


@query("d28_moments", f"WITH {_MATRIX}, c AS (SELECT *, 1e0 AS one FROM x WHERE mom_3 IS NOT NULL AND mom_6 IS NOT NULL AND label IS NOT NULL) SELECT idx % 3 AS k, round(sum(mom_3 * mom_6), 6) AS s, round(sum(mom_3 * label), 6) AS t, round(sum(one), 0) AS n FROM c GROUP BY 1")
def _(v):
    m = M.moments(_complete(v).withColumn("k", F.col("idx") % 3), ["k"], NAMES, "label")
    at = lambda i, j, n: F.sum(F.when((F.col("i") == i) & (F.col("j") == j), F.col("total"))).alias(n)
    return rounded(m.groupBy("k").agg(at(1, 2, "s"), at(1, 4, "t"), at(0, 0, "n")), "s", "t", n=6)


@query("d29_equal_weight_loss", f"WITH {_MATRIX} SELECT round(avg(pow(label - (mom_3 + mom_6 + log_amount) / 3, 2)), 6) AS loss, count(*) AS n FROM x WHERE mom_3 IS NOT NULL AND mom_6 IS NOT NULL AND log_amount IS NOT NULL AND label IS NOT NULL")
def _(v):
    return rounded(M.equal_weight_loss(_matrix(v), NAMES), "loss", n=6)


# ridge of two features in closed form, for every fold and penalty
PAIR = ["mom_3", "mom_6"]
_RIDGE = _MATRIX + """, c AS (SELECT * FROM x WHERE mom_3 IS NOT NULL AND mom_6 IS NOT NULL AND label IS NOT NULL),
  mo AS (SELECT f.fold, count(*) AS n, avg(mom_3) AS m1, avg(mom_6) AS m2, avg(label) AS my, count(*) * var_pop(mom_3) AS s11, count(*) * var_pop(mom_6) AS s22, count(*) * covar_pop(mom_3, mom_6) AS s12, count(*) * covar_pop(mom_3, label) AS s1y, count(*) * covar_pop(mom_6, label) AS s2y FROM c JOIN fold f ON f.idx = c.idx AND f.role = 'train' GROUP BY 1),
  rg AS (SELECT fold, alpha, ((s22 + alpha) * s1y - s12 * s2y) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS w1, ((s11 + alpha) * s2y - s12 * s1y) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS w2, m1, m2, my FROM mo, (SELECT unnest([0.1e0, 1e0, 10e0, 100e0]) AS alpha)),
  rf AS (SELECT fold, alpha, w1, w2, my - w1 * m1 - w2 * m2 AS b FROM rg),
  va AS (SELECT rf.fold, alpha, avg(pow(label - (b + w1 * mom_3 + w2 * mom_6), 2)) AS loss, count(*) AS n FROM c JOIN fold f ON f.idx = c.idx AND f.role = 'validation' JOIN rf ON rf.fold = f.fold GROUP BY 1, 2),
  al AS (SELECT alpha FROM (SELECT alpha, avg(loss) AS loss FROM va GROUP BY 1) ORDER BY loss, alpha LIMIT 1),
  pr AS (SELECT f.fold, c.symbol, c.idx, c.label, b + w1 * mom_3 + w2 * mom_6 AS prediction FROM c JOIN fold f ON f.idx = c.idx AND f.role = 'test' JOIN rf ON rf.fold = f.fold AND alpha = (SELECT alpha FROM al))"""


def _trained(v):
    return M.train(_rows(v), v("fold"), PAIR)


@query("d28_ridge_pair", f"WITH {_RIDGE} SELECT fold, alpha, round(w1, 8) AS mom_3, round(w2, 8) AS mom_6, round(b, 8) AS intercept FROM rf")
def _(v):
    wide = M.ridge(_rows(v), v("fold"), PAIR).groupBy("fold", "alpha").pivot("feature_id", ["intercept", *PAIR]).agg(F.first("coefficient"))
    return rounded(wide, *PAIR, "intercept")


@query("d28_validation_losses", f"WITH {_RIDGE} SELECT fold, alpha, round(loss, 8) AS loss, n FROM va")
def _(v):
    return rounded(_trained(v).validation, "loss")


@query("f07_best_alpha", f"WITH {_RIDGE} SELECT alpha FROM al")
def _(v):
    return _trained(v).alpha


@query("i03_predict", f"WITH {_RIDGE} SELECT fold, symbol, idx, round(prediction, 8) AS prediction FROM pr")
def _(v):
    return rounded(_trained(v).predictions.select("fold", "symbol", "idx", "prediction"), "prediction")


@query("i04_evaluation_frame", f"WITH {_RIDGE} SELECT fold, symbol, idx, round(prediction, 8) AS prediction, round(label, 8) AS label FROM pr")
def _(v):
    p = _trained(v).predictions
    return rounded(M.evaluation_frame(p, p, ["fold", "symbol", "idx"])[0], "prediction", "label")


@query("i04_test_losses", f"WITH {_RIDGE} SELECT fold, count(*) AS n, round(avg(pow(label - prediction, 2)), 8) AS loss FROM pr GROUP BY 1")
def _(v):
    return rounded(_trained(v).test, "loss")


@query("i04_key_violations", f"WITH {_RIDGE} SELECT f.fold, bar.symbol, bar.idx, 'MISSING' AS violation FROM bar JOIN fold f ON f.idx = bar.idx AND f.role = 'test' LEFT JOIN pr ON pr.fold = f.fold AND pr.symbol = bar.symbol AND pr.idx = bar.idx WHERE pr.fold IS NULL")
def _(v):
    """Bars of test sessions that get no prediction: suspended ones, and those without features or label."""
    return M.evaluation_frame(_trained(v).predictions, M.fold_rows(v("bar").select("symbol", "idx"), v("fold"), "test"), ["fold", "symbol", "idx"])[1]


@query("i01_finite_target", "WITH r AS (SELECT symbol, idx, rank() OVER (PARTITION BY idx ORDER BY label) + (count(*) OVER (PARTITION BY idx, label) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY idx) AS n FROM label WHERE label IS NOT NULL) SELECT symbol, idx, round(CAST(CASE WHEN n > 1 THEN (r - 1) / (n - 1) ELSE 0.5 END AS DOUBLE), 8) AS target FROM r")
def _(v):
    from tidemark.operators.factors import finite
    from tidemark.operators.windows import percentile_rank

    rows = percentile_rank(v("label").filter(finite("label")), "label", ["idx"])
    return rounded(rows.select("symbol", "idx", F.col("target").cast("double").alias("target")), "target")


@query("i02_feature_matrix", f"WITH {_MATRIX} SELECT symbol, idx, round(coalesce(mom_3, 0), 8) AS mom_3, CAST(mom_3 IS NULL AS INTEGER) AS mom_3_missing, round(coalesce(mom_6, 0), 8) AS mom_6, CAST(mom_6 IS NULL AS INTEGER) AS mom_6_missing FROM x")
def _(v):
    return rounded(M.feature_matrix(_matrix(v), ["mom_3", "mom_6"], ["symbol", "idx"]), "mom_3", "mom_6")


_FRAME = "SELECT '{n}' AS frame, count(*) AS rows, sha256(CAST(sum(CAST('0x' || substr(sha256({t}), 1, 15) AS BIGINT)) AS VARCHAR) || '|' || count(*)) AS digest FROM {n}"
_LABEL_ROW = "concat_ws('|', symbol, idx, coalesce(CAST(CAST(round(label * 1e6) AS BIGINT) AS VARCHAR), ''))"
_FEATURE_ROW = "concat_ws('|', symbol, idx, feature_id, coalesce(CAST(CAST(round(value * 1e6) AS BIGINT) AS VARCHAR), ''))"


@query("i05_frame_evidence", f"{_FRAME.format(n='feature', t=_FEATURE_ROW)} UNION ALL {_FRAME.format(n='label', t=_LABEL_ROW)}")
def _(v):
    """Digests of both frames, their values in millionths."""
    from tidemark.operators.evidence import portable_hash, table_digest

    out = []
    for n, keys, value in (("feature", ["symbol", "idx", "feature_id"], "value"), ("label", ["symbol", "idx"], "label")):
        rows = v(n).select(*keys, F.round(F.col(value) * 1e6).cast("bigint").alias(value))
        out.append(table_digest(rows, portable_hash(rows.columns)).select(F.lit(n).alias("frame"), "rows", "digest"))
    return out[0].unionByName(out[1])


@query("i05_frame_digests")
def _(v):
    from tidemark.operators.evidence import table_digest

    one = [table_digest(v(n)).select(F.lit(n).alias("frame"), "rows", "digest") for n in ("feature", "label")]
    return one[0].unionByName(one[1])


@query("b34_development_rows", "SELECT symbol, idx FROM bar WHERE idx <= 60")
def _(v):
    return M.development_rows(v("bar"), 60).select("symbol", "idx")


_MAIL = r"WITH m AS (SELECT doc_id, list_distinct(regexp_extract_all(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', '', 'g'), '([a-z]+@[a-z]+\.[a-z]+)', 1)) AS v FROM documents) SELECT doc_id, CASE WHEN len(v) = 1 THEN v[1] END AS value, CASE WHEN len(v) = 0 THEN 'MISSING' WHEN len(v) > 1 THEN 'CONFLICTING' ELSE 'FOUND' END AS state FROM m"


# tried only where a run of letters starts, and never shortened: work in proportion to the text, however long a run is
_ADDRESS = r"(?<![a-z])([a-z]++@[a-z]++\.[a-z]++)"


@query("b30_disclosures", _MAIL)
def _(v):
    return X.disclosures(v("documents"), _ADDRESS, normalize=False)


@query("b30_normalized_disclosures", _MAIL)  # no text of the table holds compatibility forms in an address
def _(v):
    return X.disclosures(v("documents"), _ADDRESS)


@query("b31_announcements", "WITH a AS (SELECT user_id AS query, event_id AS id, event_type || ' ' || CAST(event_id % 7 AS VARCHAR) AS title, event_id % 1000 AS t FROM events WHERE event_type LIKE '%i%' AND event_type NOT LIKE '%up%') SELECT query, arg_max(id, row(t, id)) AS id, arg_max(title, row(t, id)) AS title FROM a GROUP BY 1")
def _(v):
    item = F.to_json(F.array(F.struct(F.col("event_id").alias("id"), F.concat(F.lit("<em>"), "event_type", F.lit("</em> "), (F.col("event_id") % 7).cast("string")).alias("title"), (F.col("event_id") % 1000).alias("time"))))
    return X.announcements(v("events").select(F.col("user_id").alias("query"), item.alias("body")), "i", ["up"])


@query("b32_neighbour_rows", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents), w AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY n) AS b, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS a FROM l), m AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k FROM w WHERE regexp_matches(line, 'licensed? under')) SELECT doc_id, CAST(n AS INTEGER) AS line_no, regexp_extract(line, 'licensed? under', 0) AS found, trim(coalesce(b, '')) || '|' || trim(coalesce(a, '')) AS around FROM m WHERE k = 1")
def _(v):
    return X.neighbour_rows(v("documents"), "licensed? under")


@query("b33_links", "SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS n, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1) AS h FROM pages)")
def _(v):
    return X.links(v("pages"))
