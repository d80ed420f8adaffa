"""Queries hold whole tables; digests and fits against the same by hand."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, oracle_rows, rows_of
from tidemark.plans import ORACLES, QUERIES
from tidemark.plans.registry import PARTS
from tidemark.sources.views import view

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def whole(spark, con, name):
    got = rows_of(QUERIES[name](spark, SF))
    assert got == oracle_rows(con, ORACLES[name])
    return got


@pytest.mark.parametrize("name", ["e15_drawdown", "e21_breakers", "d30_equity_metrics", "d31_portfolio_metrics", "d32_annual_segments", "b35_promotion"])
def test_every_symbol_is_a_run(spark, con, name):
    columns, rows = whole(spark, con, name)
    at = columns.index("candidate" if "candidate" in columns else "run")
    assert {r[at] for r in rows} == {s for (s,) in con.execute("select distinct l_suppkey from lineitem").fetchall()}


@pytest.mark.parametrize("name", ["c04_as_of", "c05_replay_state", "c06_universe_panel"])
def test_every_session_is_a_decision(spark, con, name):
    columns, rows = whole(spark, con, name)
    days, symbol = columns.index("day"), columns.index("symbol")
    sessions = {28 * i for (i,) in con.execute("select distinct date_diff('day', date '1994-12-26', cast(l_shipdate as date)) // 28 from lineitem").fetchall()}
    assert {r[days] for r in rows} == sessions
    assert len(rows) == len(sessions) * len({r[symbol] for r in rows})


def by_hand(df):
    hashes = [r.h for r in df.select(F.xxhash64(*df.columns).alias("h")).collect()]
    return len(hashes), hashlib.sha256(f"{sum(hashes)}|{len(hashes)}".encode()).hexdigest()


def test_digests_are_of_the_content(spark):
    assert tuple(QUERIES["a13_content_digest"](spark, SF).first()) == by_hand(view(spark, SF, "bar"))
    got = {r.frame: (r.rows, r.digest) for r in QUERIES["i05_frame_digests"](spark, SF).collect()}
    assert got == {n: by_hand(view(spark, SF, n)) for n in ("feature", "label")}


def test_a_digest_tells_tables_of_one_size_apart(spark):
    f, bar = PARTS["a13_content_digest"][0], view(spark, SF, "bar")
    one = f(lambda _: bar).first()
    assert f(lambda _: bar.repartition(7).orderBy("close")).first() == one
    other = f(lambda _: bar.withColumn("volume", F.col("volume") + F.when((F.col("symbol") == 1) & (F.col("idx") == 3), 1).otherwise(0))).first()
    assert other.rows == one.rows and other.digest != one.digest


def test_every_row_is_read(spark, con):
    def one(sql):
        return con.execute(sql).fetchone()[0]

    _, days = whole(spark, con, "a10_open_calendar")
    assert 0 < len(days) < one("select count(distinct cast(l_shipdate as date)) from lineitem")
    columns, batches = whole(spark, con, "d34_weight_batches")
    assert sum(r[columns.index("n")] for r in batches) == one("select count(*) from (select distinct l_suppkey, date_diff('day', date '1994-12-26', cast(l_shipdate as date)) // 28 from lineitem)")
    assert {w for r in batches for w in r[columns.index("violations")].split(",")} >= {"MIXED_INDEX", "MIXED_DATE", "WEIGHT_SUM", ""}
    columns, cells = whole(spark, con, "d41_period_grid")
    assert len(cells) == 28 * one("select count(distinct o_custkey) from orders")
    assert {r[columns.index("state")] for r in cells} == {"FOUND", "DUPLICATE", "MISSING"}
    columns, rows = whole(spark, con, "d40_admission_report")
    assert {r[columns.index("state")] for r in rows} >= {"MISSING", "UNEXPECTED", "CONFLICTING", "ADMITTED"}


def test_every_reason_is_met(spark, con):
    columns, rows = whole(spark, con, "b23_factor_reasons")
    assert {r[columns.index("null_reason")] for r in rows} == {None, "MISSING_TRADING_SESSION", "INSUFFICIENT_HISTORY", "SOURCE_VALUE_MISSING", "NON_POSITIVE_DENOMINATOR"}


def test_ridge_of_three_features(spark):
    import numpy as np

    names = ["mom_3", "mom_6", "log_amount"]
    rows = QUERIES["c09_training_matrix"](spark, SF).toPandas().dropna(subset=[*names, "label"])
    folds = view(spark, SF, "fold").filter("role = 'train'").toPandas()
    got = QUERIES["d28_ridge"](spark, SF).toPandas().pivot(index=["fold", "alpha"], columns="feature_id", values="coefficient")
    assert len(got) == 16
    for (fold, alpha), r in got.iterrows():
        own = rows[rows.idx.isin(folds[folds.fold == fold].idx)]
        x, y = own[names].to_numpy(), own.label.to_numpy()
        c = x - x.mean(0)
        w = np.linalg.solve(c.T @ c + alpha * np.eye(3), c.T @ (y - y.mean()))
        assert r[names].to_numpy().astype(float) == pytest.approx(w, rel=1e-4, abs=1e-6)
        assert r.intercept == pytest.approx(y.mean() - x.mean(0) @ w, rel=1e-4, abs=1e-5)


def test_copies_of_a_computed_mean_do_not_conflict(spark):
    """Each evaluation of the view gives other last bits, as sums of doubles in another order do."""
    import random

    noise = F.udf(lambda i: i + random.random() * 1e-9, "double").asNondeterministic()
    rows = PARTS["a09_benchmark_opens"][0](lambda n: spark.range(50).select(F.col("id").alias("idx"), noise("id").alias("open"))).collect()
    assert sorted((r.idx, round(r.open, 6)) for r in rows) == [(i, float(i)) for i in range(10, 41)]
