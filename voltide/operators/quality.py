"""Conservation, invariants, coverage and parity of bars and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timeseries import previous

FLOW = ("v_trade", "v_buy", "v_sell")


def conservation(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Raw against bars by measure: both values and whether they are equal within tolerance."""
    side = lambda s: F.sum(F.when(F.col("taker_side") == s, F.col("quantity")).otherwise(0.0))
    raw = trades.agg(F.count_if(F.col("quantity") > 0).cast("double").alias("cnt_trade"), F.sum("quantity").alias("v_trade"), side("buy").alias("v_buy"), side("sell").alias("v_sell"))
    own = bars.agg(F.sum("cnt_trade").cast("double").alias("cnt_trade"), *[F.sum(c).alias(c) for c in FLOW])
    names = ("cnt_trade", *FLOW)
    long = lambda df, out: df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("measure", out))
    both = long(raw, "raw").join(long(own, "bars"), "measure")
    return both.withColumn("equal", F.abs(F.col("raw") - F.col("bars")) <= 1e-3 + 1e-7 * F.abs("bars"))


def invariants(bars: DataFrame, seconds: int) -> DataFrame:
    """Violations by kind."""
    kinds = {
        "high": "p_high < p_close OR p_high < p_open", "low": "p_low > p_close OR p_low > p_open", "book": "p_bid_1 > p_ask_1",
        "fill": "dt_fill_min_ms > dt_fill_mean_ms + 1e-6 OR dt_fill_mean_ms > dt_fill_max_ms + 1e-6", "cadence": f"gap <> {seconds}", "volume": "abs(v_buy + v_sell - v_trade) > 1e-6",
    }
    spaced = previous(bars, "bucket", ["venue", "instrument"], {"before": F.col("bucket")}).withColumn("gap", F.col("bucket") - F.col("before"))
    one = spaced.agg(*[F.count_if(F.expr(e)).alias(k) for k, e in kinds.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*kinds))).alias("violation", "n"))


def coverage(rows: DataFrame) -> DataFrame:
    """rows: venue, day. Days, rows, span and missing days of each venue."""
    by = rows.groupBy("venue").agg(F.countDistinct("day").alias("n_days"), F.count(F.lit(1)).alias("n_rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return by.withColumn("n_missing", F.col("last_day") - F.col("first_day") + 1 - F.col("n_days"))


def close_to(a, b, rel: float, most: float):
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(most))


def parity(offline: DataFrame, online: DataFrame, newest: int = 30, least: int = 12, now: int | None = None, online_age: int = 180, offline_age: int = 10_800) -> DataFrame:
    """The newest usable offline rows against online ones by time: matched, missing, mismatched, stale_online,
    stale_offline (against `now` in epoch seconds; false without one), passed.

    Rows are usable with a price and a venue at least; venue counts must be equal, prices and returns close, or both null.
    """
    usable = offline.where("synthetic_price IS NOT NULL AND venue_count > 0")
    top = usable.orderBy(F.desc("bucket")).limit(newest)  # the limit is the report's
    b = online.select("bucket", F.lit(True).alias("there"), F.col("synthetic_price").alias("p"), F.col("log_return").alias("r"), F.col("venue_count").alias("n"))
    both = top.join(b, "bucket", "left")
    alike = lambda x, y: F.coalesce(close_to(F.col(x), F.col(y), 1e-9, 1e-10), F.col(x).isNull() & F.col(y).isNull())
    same = F.col("venue_count").eqNullSafe(F.col("n")) & alike("synthetic_price", "p") & alike("log_return", "r")
    out = both.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.col("there") & ~same).alias("mismatched"), F.count_if(F.col("there") & same).alias("matched"), F.max("bucket").alias("last_offline"))
    last = online.agg(F.max("bucket").alias("last_online"))
    stale = lambda c, most: F.lit(False) if now is None else F.coalesce(F.lit(now) - F.col(c) > most, F.lit(True))
    out = out.join(F.broadcast(last)).withColumns({"stale_online": stale("last_online", online_age), "stale_offline": stale("last_offline", offline_age)})  # a row each
    passed = (F.col("missing") == 0) & (F.col("mismatched") == 0) & (F.col("checked") - F.col("missing") >= least) & ~F.col("stale_online") & ~F.col("stale_offline")
    return out.select("missing", "mismatched", "matched", "stale_online", "stale_offline", passed.alias("passed"))


PHASES = ("resample", "features", "targets")


def backfill_plan(hours: DataFrame, done: DataFrame, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """hour, phase, state: what is left of a backfill, phase by phase.

    hours: hour; done: hour, phase, state (complete or failed) of runs so far. A complete phase is left alone; one whose
    phase before isn't complete is blocked unless that one is pending in the same run; others are pending.
    """
    states = done.groupBy("hour").agg(*[F.max(F.when(F.col("phase") == p, F.col("state") == "complete")).alias(p) for p in phases])
    wide = hours.join(states, "hour", "left").select("hour", *[F.coalesce(p, F.lit(False)).alias(p) for p in phases])
    return wide.select("hour", F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(p).alias("phase"), F.when(F.col(p), "complete").otherwise("pending").alias("state")) for i, p in enumerate(phases)])).alias("x")).select("hour", "x.*")


def blocked(plan: DataFrame, failed: DataFrame) -> DataFrame:
    """The plan after phases failed (hour, phase): they, and all pending phases of their hour behind them, change state."""
    first = plan.join(failed, ["hour", "phase"]).groupBy("hour").agg(F.min("place").alias("broken"))
    out = plan.join(first, "hour", "left")
    state = F.when((F.col("state") == "pending") & (F.col("place") == F.col("broken")), "failed").when((F.col("state") == "pending") & (F.col("place") > F.col("broken")), "blocked").otherwise(F.col("state"))
    return out.withColumn("state", state).drop("broken")


def ranges(plan: DataFrame, state: str = "pending", step: int = 3600) -> DataFrame:
    """phase, start, end (exclusive), n: runs of consecutive hours of a state, a job each; days in chunks meet at midnight."""
    w = Window.partitionBy("phase", F.floor(F.col("hour") / 86_400)).orderBy("hour")
    new = F.coalesce(F.col("hour") - F.lag("hour").over(w) != step, F.lit(True)).cast("int")
    rows = plan.where(F.col("state") == state).withColumn("new", new)
    rows = rows.withColumn("run", F.sum("new").over(w))
    return rows.groupBy("phase", F.floor(F.col("hour") / 86_400).alias("day"), "run").agg(F.min("hour").alias("start"), (F.max("hour") + step).alias("end"), F.count(F.lit(1)).alias("n")).drop("day", "run")


def compare_buckets(raw: DataFrame, bars: DataFrame, by: list[str], measure: str = "quantity", volume: str = "v_trade", rel: float = 1e-9, most: float = 1e-6) -> DataFrame:
    """Raw rows against bars, bucket by bucket, whichever side lacks one: n_raw, raw, bars, equal (within tolerance, what a side
    lacks counting as 0) and delta (raw - bars; 0 where equal). Both are summed before they meet.
    """
    r = raw.groupBy(*by).agg(F.sum(measure).alias("raw"), F.count(F.lit(1)).alias("n_raw"))
    b = bars.groupBy(*by).agg(F.sum(volume).alias("bars"))
    both = r.join(b, by, "full")
    x, y = F.coalesce("raw", F.lit(0.0)), F.coalesce("bars", F.lit(0.0))
    equal = close_to(x, y, rel, most)
    return both.select(*by, "n_raw", "raw", "bars", F.when(equal, 0.0).otherwise(x - y).alias("delta"), equal.alias("equal"))


def profile(rows: DataFrame, by: list[str], numbers: list[str]) -> DataFrame:
    """A row a group: n, and of each number its least, largest and mean value, how many are null and how many not finite."""
    out = [F.count(F.lit(1)).alias("n")]
    for c in numbers:
        odd = F.isnan(c) | (F.abs(c) == float("inf"))
        x = F.when(~odd, F.col(c))
        out += [F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"), F.avg(x).alias(f"{c}_mean"), F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"), F.count_if(odd).alias(f"{c}_odd")]
    return rows.groupBy(*by).agg(*out)
