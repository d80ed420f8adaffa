"""Per-fold preprocessing and linear models, all folds and features in one job.

fold tables: (fold, idx, role). Statistics are fitted on training rows only.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .factors import finite
from .quantiles import between, exact_quantiles


def fold_rows(rows: DataFrame, folds: DataFrame, role: str) -> DataFrame:
    """C11: rows of the sessions that a fold gives a role. A session lies in many folds.

    What is broadcast has a row for each fold and session of a calendar: thousands, whatever the rows.
    """
    return rows.join(F.broadcast(folds.filter(F.col("role") == role).select("fold", "idx")), "idx")  # a row a fold and session


def version_scan(versions: DataFrame, cutoff: Column | int, clock: str = "available") -> DataFrame:
    """All versions that are known by the cutoff; the filter reaches the scan."""
    return versions.filter(F.col(clock) <= cutoff)


def development_rows(rows: DataFrame, end: int, clock: str = "idx", asked: int | None = None) -> DataFrame:
    """Rows up to the end of development, or up to `asked`; asking beyond the end is an error."""
    if asked is not None and asked > end:
        raise ValueError(f"{asked} is sealed: development ends at {end}")
    return rows.filter(F.col(clock) <= (end if asked is None else asked))


def clean(column: str) -> Column:
    return F.when(finite(column), F.col(column))


def fit_bounds(features: DataFrame, folds: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Linear quantiles of finite training values and the median of the clipped values, by fold and feature.

    Clipping keeps the order, so the median of the clipped values is between the clipped middle ones: one selection
    of three exact quantiles gives all, and no task holds the values of a group.
    """
    rows = fold_rows(features, folds, "train").select("fold", "feature_id", clean("value").alias("x"))
    found = exact_quantiles(rows, ["fold", "feature_id"], "x", [low, 0.5, high])
    found = found.select("fold", "feature_id", between(F.col("q")[0]).alias("low"), between(F.col("q")[2]).alias("high"), F.col("q")[1].alias("middle"))
    return found.select("fold", "feature_id", "low", "high", between(F.col("middle"), lambda v: F.greatest("low", F.least("high", v))).alias("median"))


def neutral_fit(rows: DataFrame, by: list[str], x: str = "size", y: str = "value") -> DataFrame:
    """Slope and intercept of y on x; slope 0 where x doesn't vary."""
    g = rows.filter(finite(x, y)).groupBy(*by).agg(F.var_pop(x).alias("v"), F.covar_pop(x, y).alias("c"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    slope = F.when(F.col("v") > 0, F.try_divide(F.col("c"), F.col("v"))).otherwise(0.0)
    return g.select(*by, slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def transform(features: DataFrame, folds: DataFrame, bounds: DataFrame, role: str) -> DataFrame:
    """Clip, fill with the session's median and then the fold's, flag what was missing, standardise by session."""
    rows = fold_rows(features, folds, role).withColumn("x", clean("value")).join(F.broadcast(bounds), ["fold", "feature_id"])
    w = Window.partitionBy("fold", "feature_id", "idx")
    rows = rows.withColumn("missing", F.col("x").isNull().cast("int")).withColumn("c", F.when(F.col("x").isNotNull(), F.greatest("low", F.least("high", "x"))))
    rows = rows.withColumn("f", F.coalesce("c", F.median("c").over(w), "median"))
    rows = rows.withColumn("m", F.avg("f").over(w)).withColumn("sd", F.stddev_pop("f").over(w))
    return rows.select("fold", "feature_id", "symbol", "idx", "missing", F.when(F.col("sd") > 0, F.try_divide(F.col("f") - F.col("m"), F.col("sd"))).otherwise(0.0).alias("z"))


def training_matrix(universe: DataFrame, features: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """One row for each eligible key, features as columns, with its label."""
    wide = features.groupBy("symbol", "idx").pivot("feature_id", names).agg(F.first("value"))
    return universe.join(wide, ["symbol", "idx"], "left").join(labels, ["symbol", "idx"], "left")


def feature_matrix(matrix: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """The keys, then each feature as a double with what isn't finite as 0, and a flag for it, in the order of names."""
    cells = [e for n in names for e in (F.when(finite(n), F.col(n).cast("double")).otherwise(0.0).alias(n), (~finite(n)).cast("int").alias(f"{n}_missing"))]
    return matrix.select(*keys, *cells)


def join_violations(universe: DataFrame, features: DataFrame, decided: Column) -> DataFrame:
    """Keys without a feature row, with several, or with a row from after the decision.

    Names of features are a short list, so each key is paired with all of them.
    """
    g = features.withColumn("late", decided).groupBy("symbol", "idx", "feature_id").agg(F.count("*").alias("n"), F.bool_or("late").alias("late"))
    ids = features.select("feature_id").distinct()
    rows = universe.select("symbol", "idx").join(F.broadcast(ids)).join(g, ["symbol", "idx", "feature_id"], "left")
    why = F.when(F.col("n").isNull(), "MISSING").when(F.col("n") > 1, "DUPLICATE").when(F.col("late"), "FUTURE")
    return rows.withColumn("violation", why).filter("violation is not null").select("symbol", "idx", "feature_id", "violation")


def score_frame(universe: DataFrame, features: DataFrame, labels: DataFrame, folds: DataFrame) -> DataFrame:
    """Test rows of all folds, standardised with each fold's own fit, with their labels."""
    z = transform(features, folds, fit_bounds(features, folds), "test")
    return z.join(universe.select("symbol", "idx"), ["symbol", "idx"], "left_semi").join(labels, ["symbol", "idx"], "left")


def moments(rows: DataFrame, by: list[str], features: list[str], label: str) -> DataFrame:
    """Sums of all products of features, label and 1, by group, as (i, j, total): what a linear fit needs."""
    names = ["one", *features, label]
    rows = rows.withColumn("one", F.lit(1.0))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    g = rows.groupBy(*by).agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in pairs])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{i}_{j}").alias("total")) for i, j in pairs])
    return g.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def _matrices(rows: DataFrame, folds: DataFrame, features: list[str], label: str) -> dict[tuple[int, str], np.ndarray]:
    """Of each fold and role the sums of products of 1, features and label over its sessions.

    Rows are summed once by session, and sessions by fold and role, whatever number of folds a session lies in:
    one scan of the rows. The driver gets folds x roles x features^2 numbers.
    """
    sessions = moments(rows.filter(finite(*features, label)), ["idx"], features, label)
    roles = F.broadcast(folds.select("fold", "idx", "role"))  # a row a fold and session
    sums = sessions.join(roles, "idx").groupBy("fold", "role", "i", "j").agg(F.sum("total").alias("total")).collect()
    out: dict[tuple[int, str], np.ndarray] = {}
    for r in sums:
        s = out.setdefault((r.fold, r.role), np.zeros((len(features) + 2,) * 2))
        s[r.i, r.j] = s[r.j, r.i] = r.total
    return out


def _solved(sums: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and coefficients of the ridge fit to the rows of some sums; the intercept is free."""
    mean = sums[0] / sums[0, 0]
    centred = sums - sums[0, 0] * np.outer(mean, mean)
    w = np.linalg.solve(centred[1:-1, 1:-1] + alpha * np.eye(len(mean) - 2), centred[1:-1, -1])
    return np.concatenate([[mean[-1] - mean[1:-1] @ w], w])


def _loss(sums: np.ndarray, w: np.ndarray) -> float:
    """Mean squared error of a fit on the rows of some sums, as a quadratic form in them."""
    v = np.append(-w, 1.0)
    return float(v @ sums @ v / sums[0, 0])


def _fits(matrices: dict[tuple[int, str], np.ndarray], alphas: tuple[float, ...]) -> dict[tuple[int, float], np.ndarray]:
    return {(fold, a): _solved(s, a) for (fold, role), s in sorted(matrices.items()) if role == "train" for a in alphas}


def _coefficients(spark: SparkSession, fits: dict[tuple[int, float], np.ndarray], features: list[str]) -> DataFrame:
    out = [(fold, a, f, float(c)) for (fold, a), w in fits.items() for f, c in zip(["intercept", *features], w, strict=True)]
    return spark.createDataFrame(out, "fold int, alpha double, feature_id string, coefficient double")


def ridge(rows: DataFrame, folds: DataFrame, features: list[str], label: str = "label", alphas: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0)) -> DataFrame:
    """Coefficients by fold and penalty from one pass of sums; the intercept is free.

    (fold, alpha, feature_id, coefficient), the intercept under its own name.
    """
    return _coefficients(rows.sparkSession, _fits(_matrices(rows, folds, features, label), alphas), features)


def predict(rows: DataFrame, folds: DataFrame, coefficients: DataFrame, features: list[str], role: str = "test", by: list[str] | None = None) -> DataFrame:
    """Rows of each fold scored with that fold's coefficients (and penalty, if by has it).

    What is broadcast has a row for each fold and penalty.
    """
    keys = ["fold", *(by or [])]
    wide = coefficients.groupBy(*keys).pivot("feature_id", ["intercept", *features]).agg(F.first("coefficient"))
    wide = wide.select(*keys, F.col("intercept").alias("_intercept"), F.array(*[F.col(f) for f in features]).alias("_weights"))
    x = F.array(*[F.col(f) for f in features])
    dot = F.aggregate(F.zip_with(x, "_weights", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return fold_rows(rows, folds, role).join(F.broadcast(wide), "fold").withColumn("prediction", dot + F.col("_intercept")).drop("_intercept", "_weights")


def best_alpha(losses: DataFrame) -> DataFrame:
    """the penalty with the least mean loss over folds, the smaller one of equals."""
    g = losses.groupBy("alpha").agg(F.avg("loss").alias("loss"))
    return g.agg(F.min_by("alpha", F.struct("loss", "alpha")).alias("alpha"))


def losses(predictions: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """Mean squared error and rows of predictions by `by`."""
    return predictions.groupBy(*by).agg(F.avg(F.pow(F.col(label) - F.col("prediction"), 2)).alias("loss"), F.count("*").alias("n"))


class Trained(NamedTuple):
    """What a training run leaves; every part is a DataFrame."""

    validation: DataFrame
    """fold, alpha, loss, n of every penalty on validation rows."""
    alpha: DataFrame
    """The penalty chosen: one row."""
    coefficients: DataFrame
    """fold, feature_id, coefficient of the chosen penalty."""
    predictions: DataFrame
    """Test rows with their fold's prediction."""
    test: DataFrame
    """fold, loss, n of the chosen penalty on test rows."""


def train(rows: DataFrame, folds: DataFrame, features: list[str], label: str = "label", alphas: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0)) -> Trained:
    """Fits every penalty on each fold's training rows, chooses the one with the least mean
    loss on validation rows (the smaller of equals), and scores each fold's test rows with it.

    Fits and all losses come from the sums of one scan, as losses are quadratic forms in them; only predictions
    read rows again. A fold without validation rows has no say in the choice, one without test rows no test loss.
    """
    spark = rows.sparkSession
    matrices = _matrices(rows, folds, features, label)
    fits = _fits(matrices, alphas)

    def measured(role: str, of: dict[tuple[int, float], np.ndarray]) -> list[tuple[int, float, float, int]]:
        return [(fold, a, _loss(matrices[fold, role], w), round(matrices[fold, role][0, 0])) for (fold, a), w in of.items() if (fold, role) in matrices]

    validation = spark.createDataFrame(measured("validation", fits), "fold int, alpha double, loss double, n bigint")
    alpha = best_alpha(validation)
    best = alpha.first()[0]  # of a few numbers that the driver has
    chosen = {k: w for k, w in fits.items() if k[1] == best}
    coefficients = _coefficients(spark, chosen, features).drop("alpha")
    predictions = predict(rows.filter(finite(*features, label)), folds, coefficients, features, "test")
    test = spark.createDataFrame(measured("test", chosen), "fold int, alpha double, loss double, n bigint").drop("alpha")
    return Trained(validation, alpha, coefficients, predictions, test)


def evaluation_frame(predictions: DataFrame, keys: DataFrame, by: list[str], label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Predictions with their labels by key, and the keys that are wrong: predicted twice, not predicted,
    or not asked for. keys: the observations that each fold must predict."""
    n = predictions.groupBy(*by).agg(F.count("*").alias("n")).join(keys.select(*by, F.lit(True).alias("asked")).distinct(), by, "full_outer")
    why = F.when(F.col("n").isNull(), "MISSING").when(F.col("asked").isNull(), "UNKNOWN").when(F.col("n") > 1, "DUPLICATE")
    return predictions.select(*by, "prediction", label), n.select(*by, why.alias("violation")).filter("violation is not null")


def equal_weight_loss(rows: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Mean squared error of the plain mean of the features."""
    mean = F.aggregate(F.array(*[F.col(f) for f in features]), F.lit(0.0), lambda a, v: a + v) / len(features)
    return rows.filter(finite(*features, label)).agg(F.avg(F.pow(F.col(label) - mean, 2)).alias("loss"), F.count("*").alias("n"))
