"""Training sets, linear and boosted volatility models, scores and gates."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeseries import DAY


def model_matrix(training: DataFrame, inputs: list[str], target: str, at: str = "bucket") -> DataFrame:
    return training.select(at, *inputs, F.col(target).alias("target")).dropna()


def chronological_split(rows: DataFrame, at: str = "bucket", train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """Adds place and part by row position in time: counts by day give each day its first place, ranks run within days."""
    day = F.floor(F.col(at) / DAY)
    days = rows.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.orderBy("day")  # one row a day
    days = days.select("day", (F.sum("n").over(whole) - F.col("n")).alias("before"), F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    out = rows.withColumn("day", day).join(F.broadcast(days), "day")  # bounded by the number of days
    out = out.withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("day").orderBy(at)) - 1)
    part = F.when(F.col("place") < F.floor(F.col("all") * train), "train").when(F.col("place") < F.floor(F.col("all") * (train + valid)), "valid").otherwise("test")
    return out.withColumn("part", part).drop("day", "before", "all")


def train_har(rows: DataFrame, inputs: list[str]) -> dict[str, float]:
    """Least squares with coefficients of 0 or more and an intercept: one distributed pass for the moments, then the best
    of the active sets of at most 2**len(inputs) small systems.
    """
    names = ["1", *inputs, "target"]
    value = lambda n: F.lit(1.0) if n == "1" else F.col(n)
    sums = rows.agg(*[F.sum(value(a) * value(b)).alias(f"{i}_{j}") for (i, a), (j, b) in itertools.combinations_with_replacement(enumerate(names), 2)]).first()
    k = len(inputs)
    gram = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] for j in range(k + 2)] for i in range(k + 2)], dtype=float)
    best = None
    for size in range(k + 1):
        for chosen in itertools.combinations(range(1, k + 1), size):
            at = [0, *chosen]
            w = np.linalg.lstsq(gram[np.ix_(at, at)], gram[at, k + 1], rcond=None)[0]
            if (w[1:] >= 0).all():
                loss = gram[k + 1, k + 1] - 2 * w @ gram[at, k + 1] + w @ gram[np.ix_(at, at)] @ w
                if best is None or loss < best[0] - 1e-15:
                    best = (loss, dict(zip(at, w)))
    return {"intercept": float(best[1][0])} | {n: float(best[1].get(i + 1, 0.0)) for i, n in enumerate(inputs)}


def predict(model: dict[str, float]) -> Column:
    """The linear model as a column, 0 at least."""
    out = F.lit(model["intercept"])
    for n, w in model.items():
        if n != "intercept":
            out = out + w * F.col(n)
    return F.greatest(out, F.lit(0.0))


def train_boosted(rows: DataFrame, inputs: list[str], trees: int = 500, depth: int = 6, step: float = 0.05, subsample: float = 0.8):
    """Gradient-boosted trees; returns the model and the rows with its input vector."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    data = VectorAssembler(inputCols=inputs, outputCol="inputs").transform(rows)
    return GBTRegressor(featuresCol="inputs", labelCol="target", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=subsample, seed=7).fit(data), data


def metrics(actual: Column, forecast: Column) -> list[Column]:
    """QLIKE, RMSE, MAE, R2, RMSPE as aggregates."""
    av, fv = F.greatest(actual**2, F.lit(1e-18)), F.greatest(forecast**2, F.lit(1e-18))
    e = actual - forecast
    return [F.avg(F.log(fv) + av / fv).alias("qlike"), F.sqrt(F.avg(e**2)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
            (1 - F.sum(e**2) / F.when(F.var_pop(actual) > 0, F.var_pop(actual) * F.count(actual))).alias("r2"), F.sqrt(F.avg((e / F.when(actual != 0, actual)) ** 2)).alias("rmspe")]


def retrain_decision(rows: DataFrame, worse: float = 0.05, failures: int = 2, cooldown: int = 6 * 3600) -> DataFrame:
    """rows: rmse, champion_rmse, benchmark_rmse, failed_before, since_training. Adds change, degraded, failed, trigger, beats, promote."""
    change = (F.col("rmse") - F.col("champion_rmse")) / F.col("champion_rmse")
    out = rows.withColumn("change", change).withColumn("degraded", F.col("change") >= worse)
    out = out.withColumn("failed", F.when(F.col("degraded"), F.col("failed_before") + 1).otherwise(0))
    out = out.withColumn("trigger", (F.col("failed") >= failures) & (F.col("since_training") >= cooldown))
    out = out.withColumn("beats", (F.col("rmse") - F.col("benchmark_rmse")) / F.col("benchmark_rmse") <= -0.02)
    return out.withColumn("promote", F.col("beats") & ~F.col("degraded"))


def purged(split: DataFrame, gap: int, at: str = "bucket") -> DataFrame:
    """Rows whose labels reach into the next part go: those less than `gap` seconds before it starts."""
    starts = split.groupBy("part").agg(F.min(at).alias("start"))
    firsts = {r.part: r.start for r in starts.collect()}
    limit = F.when(F.col("part") == "train", F.lit(firsts.get("valid"))).when(F.col("part") == "valid", F.lit(firsts.get("test")))
    return split.where(limit.isNull() | (F.col(at) + gap < limit))


def evaluate(rows: DataFrame, forecasts: list[str], newest: int, at: str = "bucket") -> DataFrame:
    """Metrics of each forecast column, side by side, over the newest rows on which all of them and the target can be used."""
    usable = F.lit(True)
    for c in ("target", *forecasts):
        usable = usable & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    last = rows.where(usable).orderBy(F.desc(at)).limit(newest)  # the limit is the report's
    long = last.select("target", F.explode(F.map_from_arrays(F.array(*map(F.lit, forecasts)), F.array(*forecasts))).alias("kind", "forecast"))
    return long.groupBy("kind").agg(*metrics(F.col("target"), F.col("forecast")))


HORIZONS = (300, 900, 1800, 3600)


def score_curve(rows: DataFrame, models: dict[int, dict[str, float]], variances: dict[int, str], legacy: tuple[str, int] | None = None) -> DataFrame:
    """Adds sigma_<h> for each horizon, and error: the first reason why a row has no curve.

    A horizon with a linear model has its prediction, which needs all of its inputs; the others have the square root of
    the annualised variance in their column of `variances`, or, where a row hasn't all of these, of the one `legacy`
    (column, seconds of its bars) for all; an hour without a model has the half hour's. Every value must be above 0.
    """
    year = 365 * DAY
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (c < float("inf"))
    own = {h: F.col(variances[h]) for h in HORIZONS[:-1]}
    whole = F.lit(True)
    for c in own.values():
        whole = whole & c.isNotNull()
    out, error = {}, F.lit(None).cast("string")
    for h in HORIZONS:
        if h in models:
            inputs = F.lit(True)
            for n in models[h]:
                inputs = inputs & good(F.col(n)) if n != "intercept" else inputs
            value, reason = F.when(inputs, predict(models[h])), f"model_{h}"
        else:
            k = HORIZONS[-2] if h == HORIZONS[-1] else h
            old = F.lit(None).cast("double") if legacy is None else F.when(F.col(legacy[0]) > 0, F.sqrt(F.col(legacy[0]) * year / legacy[1]))
            value, reason = F.when(whole, F.when(own[k] > 0, F.sqrt(own[k] * year / k))).otherwise(old), f"variance_{k}"
        value = F.when(good(value) & (value > 0), value)
        out[f"sigma_{h}"] = value
        error = F.coalesce(error, F.when(value.isNull(), reason))
    return rows.withColumns({**out, "error": error})
