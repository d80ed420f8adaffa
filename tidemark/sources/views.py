"""Domain views over the supplied tables, as one SQL text for Spark and for the oracle.

Macros: $day(x) days since 1994-12-26, $date(n) that many days later as a date, $stack(a b) a row
for each of the columns as feature_id and value; $table names are base tables. A view may use views that stand before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "orders", "customer", "supplier", "part", "events", "nation", "region", "documents", "pages", "labels", "benchmark", "conversations", "embeddings")

VIEWS: dict[str, str] = {
    "trade": """
      SELECT l_suppkey AS symbol, CAST(floor($day(l_shipdate) / 28) AS BIGINT) AS idx, $day(l_shipdate) AS day,
        CAST($day(l_shipdate) AS BIGINT) * 10000000000 + l_orderkey * 10 + l_linenumber AS seq, l_extendedprice / l_quantity AS price,
        CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_returnflag AS flag
      FROM $lineitem""",
    "bar0": """
      SELECT symbol, idx, min_by(price, seq) AS open, max_by(price, seq) AS close, max(price) AS high, min(price) AS low, CAST(sum(qty) AS BIGINT) AS volume,
        CAST(sum(cents) AS BIGINT) AS amount, (max(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) = 1 AND sum(qty) < 60) AS suspended, 1e0 + (symbol % 3) / 1e1 AS adj
      FROM trade GROUP BY symbol, idx""",
    "bar": """
      SELECT b.*, lag(close) OVER (PARTITION BY symbol ORDER BY idx) AS previous_close, lag(close) OVER (PARTITION BY symbol ORDER BY idx) * 1.1e0 AS limit_up,
        lag(close) OVER (PARTITION BY symbol ORDER BY idx) * 0.9e0 AS limit_down FROM bar0 b""",
    "calendar": "SELECT idx, CAST($date(idx * 28) AS DATE) AS date FROM (SELECT DISTINCT idx FROM bar0) c",
    "valuation": """
      SELECT b.symbol, b.idx, b.close / 1e1 AS pe, CASE WHEN s.s_acctbal > 0 THEN s.s_acctbal * b.close END AS total_mv, s.s_nationkey AS industry
      FROM bar0 b JOIN $supplier s ON s.s_suppkey = b.symbol""",
    "benchmark_bar": "SELECT idx, avg(open) AS open, avg(close) AS close FROM bar0 GROUP BY idx",
    "security_event": """
      SELECT symbol, 'LISTED' AS kind, min(day) AS effective, min(day) AS available, CAST(NULL AS BOOLEAN) AS is_st, symbol * 10 AS event_id FROM trade GROUP BY symbol
      UNION ALL SELECT symbol, 'DELISTED', max(day) - 365, max(day) - 360, CAST(NULL AS BOOLEAN), symbol * 10 + 1 FROM trade WHERE symbol % 10 = 0 GROUP BY symbol
      UNION ALL SELECT symbol, 'LISTED', max(day) - 200, max(day) - 200, CAST(NULL AS BOOLEAN), symbol * 10 + 2 FROM trade WHERE symbol % 20 = 0 GROUP BY symbol
      UNION ALL SELECT t.symbol, 'NAME_STATUS', min(day) + 100, min(day) + 120, max(s.s_acctbal) < 0, t.symbol * 10 + 3 FROM trade t JOIN $supplier s ON s.s_suppkey = t.symbol GROUP BY t.symbol""",
    "financial_version": """
      SELECT o_custkey AS symbol, CAST(floor($day(o_orderdate) / 91) AS BIGINT) AS report_period, $day(o_orderdate) + CAST(o_orderkey % 60 AS INT) AS available,
        o_orderstatus = 'F' AS update_flag, o_orderkey AS event_id, o_totalprice AS metric FROM $orders""",
    "decision": "SELECT s.symbol, d.day FROM (SELECT DISTINCT o_custkey AS symbol FROM $orders) s CROSS JOIN (SELECT DISTINCT idx * 28 AS day FROM bar0) d",
    "wide": """
      SELECT symbol, idx, close, close / lag(close, 6) OVER (PARTITION BY symbol ORDER BY idx) - 1 AS mom_6, close / lag(close, 3) OVER (PARTITION BY symbol ORDER BY idx) - 1 AS mom_3,
        ln(amount / 1e2) AS log_amount, CASE WHEN volume > 150 THEN round((high - low) / close, 2) END AS range,
        lead(open, 3) OVER (PARTITION BY symbol ORDER BY idx) / lead(open, 1) OVER (PARTITION BY symbol ORDER BY idx) - 1 AS label FROM bar0""",
    "feature": "SELECT symbol, idx, $stack(mom_6 mom_3 log_amount range) FROM wide",
    "label": "SELECT symbol, idx, label FROM wide",
    "panel": """
      SELECT w.symbol, w.idx, $stack(mom_6 mom_3 log_amount range), w.label, CASE WHEN s.s_acctbal > 0 THEN ln(s.s_acctbal * w.close) END AS size, s.s_nationkey AS industry,
        CASE WHEN w.idx % 2 = 0 THEN 'BULL' ELSE 'BEAR' END AS regime FROM wide w JOIN $supplier s ON s.s_suppkey = w.symbol""",
    "score": "SELECT symbol, idx, ln(amount / 1e2) AS score FROM bar0",
    "equity": "SELECT symbol AS run, idx, CAST($date(idx * 28) AS DATE) AS date, close AS equity, amount / 1e2 AS notional FROM bar0",
    "run_trade": """
      SELECT symbol AS run, idx, seq, CASE WHEN seq % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, (price - lag(price) OVER (PARTITION BY symbol ORDER BY seq)) * qty AS realized, cents / 1e2 AS notional,
        cents * 3e-6 AS fee, qty * 1e0 / sum(qty) OVER (PARTITION BY symbol, idx) AS participation, CASE WHEN qty > 45 THEN 'PENDING' ELSE 'FILLED' END AS state FROM trade""",
    "target": """
      SELECT b.idx, b.symbol, 1e0 / (3 + b.symbol % 7) / 10 AS target_w, (b.volume % 9) / 1e2 AS current_w, b.close AS score, b.open AS price, b.volume,
        CASE WHEN b.idx % 17 = 3 AND b.symbol % 11 = 0 THEN NULL ELSE v.industry END AS industry, NOT b.suspended AS eligible
      FROM bar0 b JOIN valuation v ON v.symbol = b.symbol AND v.idx = b.idx""",
    "snapshot": """
      SELECT event_id AS snapshot_id, event_type AS endpoint, user_id, value, props AS params, CAST(ts AS DATE) AS day, CASE WHEN event_id % 13 = 0 THEN 'REJECTED' ELSE 'ACCEPTED' END AS status FROM $events""",
    "lineage": "SELECT event_id AS snapshot_id, event_id * 2 AS artifact_id, CASE WHEN event_id % 5 = 0 THEN 'short' ELSE lower(substr(concat('0123456789abcdef0123456789abcdef01234567', ''), 1, 40)) END AS code_version FROM $events WHERE event_id % 7 <> 0",
    "quality": "SELECT event_id * 2 AS artifact_id, event_id % 11 <> 0 AS passed FROM $events",
    "candidate": """
      SELECT c.c_custkey AS symbol, c.c_mktsegment AS segment, CAST(min(o.o_orderdate) AS DATE) AS listing_date, year(min(o.o_orderdate)) AS listing_year, c.c_nationkey AS exchange
      FROM $customer c JOIN $orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey, c.c_mktsegment, c.c_nationkey""",
    "fold": """
      SELECT f.fold, c.idx, CASE WHEN c.idx < 20 + 15 * f.fold THEN 'train' WHEN c.idx < 27 + 15 * f.fold THEN 'validation' ELSE 'test' END AS role
      FROM (SELECT DISTINCT idx FROM bar0) c CROSS JOIN (SELECT 0 AS fold UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) f
      WHERE c.idx < 35 + 15 * f.fold""",
    "order_row": """
      SELECT symbol, idx, CASE WHEN seq % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, seq, day, qty * 100 AS shares, qty * 70 AS sellable, qty * 9e1 * price AS cash, price FROM trade""",
}
_USES = {name: [v for v in VIEWS if v != name and re.search(rf"(?:FROM|JOIN) {v}\b", text)] for name, text in VIEWS.items()}


def _needed(names: list[str]) -> list[str]:
    todo, seen = list(names), set()
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += _USES[n]
    return [v for v in VIEWS if v in seen]


def _stacked(names: str, spark: bool) -> str:
    each = names.split()
    if spark:
        return f"stack({len(each)}, {', '.join(f"'{n}', {n}" for n in each)}) AS (feature_id, value)"
    return f"unnest([{', '.join(f"'{n}'" for n in each)}]) AS feature_id, unnest([{', '.join(each)}]) AS value"


def _text(names: list[str], spark: bool) -> str:
    body = ", ".join(f"{n} AS ({VIEWS[n]})" for n in _needed(names))
    body = re.sub(r"\$stack\(([^()]*)\)", lambda m: _stacked(m[1], spark), body)
    if spark:
        body = re.sub(r"\$day\(([^()]*)\)", r"datediff(\1, DATE'1994-12-26')", body)
        return re.sub(r"\$date\(([^()]*)\)", r"date_add(DATE'1994-12-26', CAST(\1 AS INT))", body)
    body = re.sub(r"\$day\(([^()]*)\)", r"CAST(date_diff('day', DATE '1994-12-26', CAST(\1 AS DATE)) AS INTEGER)", body)
    return re.sub(r"\$date\(([^()]*)\)", r"(DATE '1994-12-26' + CAST(\1 AS INTEGER))", body)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or base table of a folder of Parquet tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = f"WITH {_text([name], True)} SELECT * FROM {name}"
    used = sorted(set(re.findall(r"\$(\w+)", text)))
    for t in used:
        text = text.replace(f"${t} ", "{" + t + "} ").replace(f"${t})", "{" + t + "})").replace(f"${t}\n", "{" + t + "}\n")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def _rank_corr(a: str, b: str) -> str:
    """Correlation of average ranks from exact sums, as SQL of the oracle."""
    x, y = (f"CAST(2 * {c} AS HUGEINT)" for c in (a, b))

    def spread(u: str, v: str) -> str:
        return f"CAST(count(*) * sum({u} * {v}) - sum({u}) * sum({v}) AS DOUBLE)"

    return f"CASE WHEN {spread(x, x)} > 0 AND {spread(y, y)} > 0 THEN {spread(x, y)} / (sqrt({spread(x, x)}) * sqrt({spread(y, y)})) END"


def oracle(body: str) -> str:
    """An oracle query over the views that it names; $rank_corr(a b) is a correlation of ranks."""
    body = re.sub(r"\$rank_corr\(([\w.]+) ([\w.]+)\)", lambda m: _rank_corr(m[1], m[2]), body)
    names = [v for v in VIEWS if re.search(rf"(?:FROM|JOIN|,) {v}\b", body)]
    head = _text(names, False).replace("$", "") if names else ""
    body = body.strip()
    if not head:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
