"""Synthetic prices over venues, returns, volatility features and labels on regular bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltide.functions.columns import YEAR_SECONDS, log_ratio, ratio

from .bars import KEYS, time_grid
from .timeseries import DAY, carried, carry_scan, halo_window, in_chunks, previous


def synthetic(bars: DataFrame, asset: str = "SYN") -> DataFrame:
    """asset, bucket, synthetic_price (equal-weight mean over venues), venue_count, v_buy."""
    price = F.coalesce("p_trade_mean", "p_close")
    out = bars.groupBy("bucket").agg(F.avg(price).alias("synthetic_price"), F.count(price).alias("venue_count"), F.sum(F.coalesce("v_buy", F.lit(0.0))).alias("v_buy"))
    return out.select(F.lit(asset).alias("asset"), "bucket", "synthetic_price", "venue_count", "v_buy")


def with_return(prices: DataFrame, bar: int, chunk: int = DAY) -> DataFrame:
    """Adds log_return to the price one bar before (the grid has every bar); bucket in epoch seconds."""
    previous = lambda w: F.max("synthetic_price").over(w.rangeBetween(-bar, -bar))
    return halo_window(prices, "bucket", ["asset"], {"__p": previous}, back=bar, chunk=chunk).withColumn("log_return", log_ratio("synthetic_price", "__p")).drop("__p")


def _rv(squares: Column, n: Column, full: int, seconds: float, exact: bool = True) -> Column:
    enough = (n == full) if exact else (n >= full)
    return F.when(enough, F.sqrt(squares * YEAR_SECONDS / seconds))


def realized_vol(returns: DataFrame, bar: int, windows: list[int], chunk: int = DAY) -> DataFrame:
    """Annualised volatility over trailing windows with every return there, else null."""
    columns = {}
    for w in windows:
        columns[f"realized_vol_{w}s"] = lambda spec, w=w: _rv(F.sum(F.col("log_return") ** 2).over(spec.rangeBetween(-(w - bar), 0)), F.count("log_return").over(spec.rangeBetween(-(w - bar), 0)), w // bar, w)
    return halo_window(returns, "bucket", ["asset"], columns, back=max(windows), chunk=chunk)


def realized_vol_v1(returns: DataFrame, bar: int, windows: list[int], chunk: int = DAY) -> DataFrame:
    """The first contract: inclusive windows, one return may miss, annualised without dividing by the window."""
    columns = {}
    for w in windows:
        columns[f"realized_vol_{w}s"] = lambda spec, w=w: _rv(F.sum(F.col("log_return") ** 2).over(spec.rangeBetween(-w, 0)), F.count("log_return").over(spec.rangeBetween(-w, 0)), w // bar, 1, exact=False)
    return halo_window(returns, "bucket", ["asset"], columns, back=max(windows), chunk=chunk)


def log_buy_volume(prices: DataFrame, bar: int, windows: list[int], chunk: int = DAY) -> DataFrame:
    columns = {}
    for w in windows:
        columns[f"log_buy_volume_{w}s"] = lambda spec, w=w: F.when(F.count(F.lit(1)).over(spec.rangeBetween(-(w - bar), 0)) == w // bar, F.log1p(F.sum("v_buy").over(spec.rangeBetween(-(w - bar), 0))))
    return halo_window(prices, "bucket", ["asset"], columns, back=max(windows), chunk=chunk)


def future_rv(returns: DataFrame, bar: int, horizons: list[int], chunk: int = DAY) -> DataFrame:
    """Labels: volatility of the returns after each bar, to each horizon; null unless all are there."""
    columns = {}
    for h in horizons:
        columns[f"target_rv_{h}s"] = lambda spec, h=h: _rv(F.sum(F.col("log_return") ** 2).over(spec.rangeBetween(1, h)), F.count("log_return").over(spec.rangeBetween(1, h)), h // bar, h)
    out = halo_window(returns, "bucket", ["asset"], columns, back=0, ahead=max(horizons), chunk=chunk)
    return out.select("asset", "bucket", (F.col("bucket") + max(horizons)).alias("label_window_end"), *columns)


def features(bars: DataFrame, bar: int, windows: list[int], volumes: list[int], version: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """The whole feature contract; rows before `start` only serve as history."""
    if start is not None:
        bars = bars.where(F.col("bucket") >= start - max(windows) - bar)
    if end is not None:
        bars = bars.where(F.col("bucket") < end)
    prices = with_return(synthetic(bars), bar)
    out = log_buy_volume(realized_vol(prices, bar, windows), bar, volumes) if volumes else realized_vol(prices, bar, windows)
    out = out if start is None else out.where(F.col("bucket") >= start)
    return out.withColumn("feature_version", F.lit(version))


def ewma(df: DataFrame, at: str, by: list[str], value: Column, decay: float, out: str, before: str | None = None) -> DataFrame:
    """Exponential average of `value`: the first value, then decay * before + (1 - decay) * value; nulls count as 0.
    `before` names a column for the average before each row's own value (null in the first row).
    """
    x = F.coalesce(value, F.lit(0.0))
    return carry_scan(df, at, by, F.lit(decay), (1 - decay) * x, out, first=x, before=before)


def ewma_variance(returns: DataFrame, decay: float = 0.96) -> DataFrame:
    """variance: after each return; forecast: the variance before it (the first row's own square)."""
    out = ewma(returns, "bucket", ["asset"], F.col("log_return") ** 2, decay, "variance", "forecast")
    return out.withColumn("forecast", F.coalesce("forecast", "variance"))


def annualized(variance: Column, bar: int, horizon: int) -> Column:
    """Volatility a year of a per-bar variance over a horizon."""
    return F.sqrt(F.greatest(variance * max(1, horizon // bar) * YEAR_SECONDS / horizon, F.lit(1e-18)))


def sampled_ewma(prices: DataFrame, horizon: int, bar: int, decay: float) -> DataFrame:
    """Prices sampled at ends that the horizon divides; the published variance is the one before each update."""
    ends = prices.where(((F.col("bucket") + bar) % horizon == 0) & F.col("synthetic_price").isNotNull()).select("asset", "bucket", "synthetic_price")
    sampled = previous(ends, "bucket", ["asset"], {"__p": F.col("synthetic_price")}, 30 * DAY).withColumn("log_return", log_ratio("synthetic_price", "__p")).where("log_return IS NOT NULL")
    out = ewma(sampled.drop("__p"), "bucket", ["asset"], F.col("log_return") ** 2, decay, "variance", "published")
    return out.select("asset", "bucket", "log_return", "variance", "published")


def rows_back(n: int, by: list[str] | tuple[str, ...] = KEYS):
    return Window.partitionBy(*by).orderBy("bucket").rowsBetween(-(n - 1), 0)


def filled_return(price: str = "p_close", by: list[str] | tuple[str, ...] = KEYS) -> Column:
    """ln of the ratio to the bar before; 0 where there is none."""
    return F.coalesce(log_ratio(price, F.lag(price).over(Window.partitionBy(*by).orderBy("bucket"))), F.lit(0.0))


def rolling(bars: DataFrame, bar: int, window: int, chunk: int = DAY) -> DataFrame:
    """log_return (filled), rv, bv, jump and gk over the last window's rows, from a fifth of them on; `bars` is a full grid."""
    back = (math.ceil(window / bar) + 2) * bar
    return in_chunks(bars, "bucket", list(KEYS), lambda rows, by: _rolling(rows, by, bar, window), back, chunk=max(chunk, back))


def _rolling(bars: DataFrame, by: list[str], bar: int, window: int) -> DataFrame:
    n = math.ceil(window / bar)
    least = min(n, max(2, n // 5))
    w, order = rows_back(n, by), Window.partitionBy(*by).orderBy("bucket")
    out = bars.withColumn("log_return", filled_return(by=by))
    pair = F.abs("log_return") * F.abs(F.lag("log_return").over(order))
    hl, co = log_ratio("p_high", "p_low"), log_ratio("p_close", "p_open")
    out = out.withColumns({"__bv": math.pi / 2 * pair, "__gk": F.greatest(0.5 * hl * hl - (2 * math.log(2) - 1) * co * co, F.lit(0.0)), "__gk_null": hl + co})
    out = out.withColumn("__gk", F.when(F.col("__gk_null").isNotNull(), F.col("__gk")))
    some = lambda c, x: F.when(F.count(c).over(w) >= least, x)
    out = out.withColumns({
        "rv": some("log_return", F.sqrt(F.sum(F.col("log_return") ** 2).over(w))),
        "bv": some("__bv", F.sqrt(F.sum("__bv").over(w))),
        "gk": some("__gk", F.sqrt(F.avg("__gk").over(w))),
    })
    return out.withColumn("jump", F.greatest(F.col("rv") ** 2 - F.col("bv") ** 2, F.lit(0.0))).withColumn("jump_ratio", F.col("jump") / (F.col("rv") ** 2 + 1e-8)).drop("__bv", "__gk", "__gk_null")


def parkinson(bars: DataFrame, bar: int, window: int, chunk: int = DAY) -> DataFrame:
    """Adds parkinson, the volatility of highs over lows of the last window's rows; `bars` is a full grid."""
    n = math.ceil(window / bar)
    steps = lambda rows, by: rows.withColumn("parkinson", F.sqrt(F.avg(F.log(F.col("p_high") / F.col("p_low")) ** 2).over(rows_back(n, by)) / (4 * math.log(2))))
    return in_chunks(bars, "bucket", list(KEYS), steps, n * bar, chunk=max(chunk, n * bar))


def wap(k: int) -> Column:
    """Price at level k, weighted by the other side's quantity."""
    bp, bq, ap, aq = (F.col(f"{x}_{s}_{k}") for s in ("bid", "ask") for x in "pq")
    return ratio(bp * aq + ap * bq, bq + aq)


def obi(k: int) -> Column:
    return ratio(F.col(f"q_bid_{k}") - F.col(f"q_ask_{k}"), F.col(f"q_bid_{k}") + F.col(f"q_ask_{k}"))


def total(columns: list[str]) -> Column:
    """Sum of columns, nulls skipped."""
    out = F.lit(0.0)
    for c in columns:
        out = out + F.coalesce(c, F.lit(0.0))
    return out


def book_slope(side: str, depth: int = 10) -> Column:
    return ratio(total([f"q_{side}_{k}" for k in range(1, depth + 1)]), F.col(f"p_{side}_1") - F.col(f"p_{side}_{depth}"))


def cumulative_obi(k: int) -> Column:
    b, a = total([f"q_bid_{i}" for i in range(1, k + 1)]), total([f"q_ask_{i}" for i in range(1, k + 1)])
    return ratio(b - a, b + a)


def multi_level_microprice(depth: int) -> Column:
    """Level prices weighted by 1 / level."""
    out = F.lit(0.0)
    for k in range(1, depth + 1):
        out = out + wap(k) / k
    return out / sum(1 / k for k in range(1, depth + 1))


def ofi(by: list[str] | tuple[str, ...] = KEYS) -> Column:
    """Order flow imbalance at the top of the book. The first row has no change: its bid flow is 0, its ask flow the quantity."""
    w = Window.partitionBy(*by).orderBy("bucket")
    def flow(side: str, better_up: bool) -> Column:
        p, q = F.col(f"p_{side}_1"), F.col(f"q_{side}_1")
        dp, dq = p - F.lag(p).over(w), q - F.lag(q).over(w)
        up, down = (q, F.lit(0.0)) if better_up else (F.lit(0.0), q)
        return F.when(dp > 0, up).when(dp == 0, dq).otherwise(down)
    return flow("bid", True) - flow("ask", False)


def microstructure(bars: DataFrame, bar: int, chunk: int = DAY) -> DataFrame:
    """All measures of a bar's book and flow; `bars` is a full grid."""
    return in_chunks(bars, "bucket", list(KEYS), lambda rows, by: _microstructure(rows, by), bar, chunk=chunk)


def _microstructure(bars: DataFrame, by: list[str]) -> DataFrame:
    out = bars
    for k in (1, 5, 10):
        out = out.withColumns({f"wap_{k}": wap(k), f"microprice_{k}": wap(k), f"obi_{k}": obi(k)})
    return out.withColumns({
        "spread": F.col("p_ask_1") - F.col("p_bid_1"), "relative_spread": ratio(F.col("p_ask_1") - F.col("p_bid_1"), F.col("wap_1")),
        "bid_slope": book_slope("bid"), "ask_slope": book_slope("ask"),
        "liquidity_consumption": ratio("v_trade", F.col("q_bid_1") + F.col("q_ask_1")),
        "aggressor_imbalance": ratio(F.col("v_buy") - F.col("v_sell"), F.col("v_buy") + F.col("v_sell")), "ofi": ofi(by),
    })


FEATURES_V1 = [f"{n}_{k}" for k in (1, 5, 10) for n in ("wap", "microprice", "obi")] + ["spread", "relative_spread", "bid_slope", "ask_slope", "liquidity_consumption", "aggressor_imbalance", "ofi", "log_return", "rv", "bv", "jump", "gk"]


def venue_means(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy("bucket").agg(*[F.avg(c).alias(c) for c in columns])


def features_v1(bars: DataFrame, bar: int, window: int) -> DataFrame:
    """All of a venue's features, then their means over venues."""
    back = (math.ceil(window / bar) + 2) * bar
    both = in_chunks(bars, "bucket", list(KEYS), lambda rows, by: _rolling(_microstructure(rows, by), by, bar, window), back, chunk=max(DAY, back))
    return venue_means(both, FEATURES_V1)


def fresh_venue_spot(trades: DataFrame, seconds: int, fresh: int, chunk: int = DAY) -> DataFrame:
    """At each bucket's end: the mean of the venues' latest prices that are at most `fresh` seconds old, who they are, and
    the log return against the spot one bucket before.
    """
    ends = trades.select(((F.floor(F.unix_seconds("event_timestamp") / seconds) + 1) * seconds).alias("end"), "venue", "price", F.unix_micros("event_timestamp").alias("us"))
    latest = ends.groupBy("end", "venue").agg(F.max_by("price", "us").alias("price"), F.max("us").alias("us"))
    bounds = latest.agg(F.min("end").alias("low"), F.max("end").alias("high"))
    grid = time_grid(latest.select("venue").distinct(), bounds, seconds, by=["venue"]).select(F.unix_seconds("bucket").alias("end"), "venue")
    held = carried(grid.join(latest, ["end", "venue"], "left"), "end", ["venue"], ["price", "us"], chunk).where("us IS NOT NULL")
    is_fresh = F.col("end") * 1_000_000 - F.col("us") <= fresh * 1_000_000
    spots = held.groupBy("end").agg(
        F.avg(F.when(is_fresh, F.col("price"))).alias("spot"), F.count_if(is_fresh).alias("venue_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(is_fresh, F.col("venue")))), ",").alias("used"),
        F.array_join(F.array_sort(F.collect_list(F.when(~is_fresh, F.col("venue")))), ",").alias("stale"))
    before = lambda w: F.max("spot").over(w.rangeBetween(-seconds, -seconds))
    return halo_window(spots, "end", [], {"__spot": before}, seconds, chunk=chunk).withColumn("log_return", log_ratio("spot", "__spot")).drop("__spot")
