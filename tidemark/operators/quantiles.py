"""Exact quantiles of large groups, without a group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], accuracy: int = 1000) -> DataFrame:
    """by, n (values that aren't null) and q, the two order statistics next to each share with the weight of the upper:
    an array of (low, high, weight) in the order of shares; null where a group has no value.

    A sketch for each group gives a band of values around each share, 6 / accuracy of the rows wide. One more pass
    counts what lies below each band, and each value inside: below it a row a group is left after the map side, and
    inside a row a distinct value. Only bands are sorted, so a task holds some thousandths of a group. The sketch's
    error is below a third of a band's half; should a band miss its rank all the same, that is an error, not a wrong value.
    """
    margin = 3 / accuracy
    edges = [min(1.0, max(0.0, s + d)) for s in shares for d in (-margin, margin)]
    sketch = rows.groupBy(*by).agg(F.count(value).alias("n"), F.percentile_approx(value, edges, accuracy).alias("_cuts"))
    named = sketch.select(*[F.col(c).alias(f"_{c}") for c in by], "_cuts")
    x = F.col(value)

    def cell(i: int) -> Column:
        side = F.when(x < F.col("_cuts")[2 * i], -1).when(x > F.col("_cuts")[2 * i + 1], 1).otherwise(0)
        return F.struct(F.lit(i).alias("_i"), side.alias("_side"), F.when(side == 0, x).alias("_v"))

    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    met = rows.filter(x.isNotNull()).join(named, same).select(*by, x.alias("_x"), F.explode(F.array(*map(cell, range(len(shares))))).alias("_c"))
    counted = met.groupBy(*by, "_c._i", "_c._side", "_c._v").agg(F.count("*").alias("_k"), F.min("_x").alias("_first"), F.max("_x").alias("_last"))
    up_to = Window.partitionBy(*by, "_i").orderBy("_side", "_v").rowsBetween(Window.unboundedPreceding, 0)  # a band
    placed = counted.withColumn("_to", F.sum("_k").over(up_to))
    sizes = sketch.select(*[F.col(c).alias(f"_{c}") for c in by], "n")
    share = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("_i") + 1)
    placed = placed.join(sizes, same).withColumn("_at", share * (F.col("n") - 1))

    def at(rank: Column) -> Column:
        """The value of a rank: of what lies below a band only the last is known, of what lies above only the first."""
        start, end, side = F.col("_to") - F.col("_k"), F.col("_to"), F.col("_side")
        inside = (side == 0) & (rank >= start) & (rank < end)
        return F.max(F.when(inside, F.col("_v")).when((side < 0) & (rank == end - 1), F.col("_last")).when((side > 0) & (rank == start), F.col("_first")))

    lower, upper = F.floor("_at"), F.ceil("_at")
    found = placed.groupBy(*by, "_i").agg(at(lower).alias("low"), at(upper).alias("high"), F.max(F.col("_at") - lower).alias("weight"))
    checked = F.when(F.col("low").isNull() | F.col("high").isNull(), F.raise_error(F.lit("a band missed its rank")).cast("double")).otherwise(F.col("low"))
    found = found.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_i", checked.alias("low"), "high", "weight"))).alias("q"))  # an entry a share
    found = found.select(*[F.col(c).alias(f"_{c}") for c in by], F.transform("q", lambda e: e.dropFields("_i")).alias("q"))
    return sketch.drop("_cuts").join(found, same, "left").select(*by, "n", "q")


def between(q: Column, clip: Callable[[Column], Column] | None = None) -> Column:
    """The linear quantile of an entry (low, high, weight), its ends clipped if asked."""
    low, high = (q["low"], q["high"]) if clip is None else (clip(q["low"]), clip(q["high"]))
    return low * (1 - q["weight"]) + high * q["weight"]
