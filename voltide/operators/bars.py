"""Bars: trades and book snapshots on a regular time grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltide.functions.columns import time_bucket
from voltide.sources.shared import cut

from .timeseries import DAY, carried, previous

KEYS = ("venue", "instrument")
SIDES = ("bid", "ask")


def dedupe_trades(trades: DataFrame) -> DataFrame:
    """Rows without a trade id all stay; of each id the first received stays."""
    order = Window.partitionBy(*KEYS, "trade_id").orderBy(F.coalesce("received_timestamp", "event_timestamp"), "ingested_at", "source_object", "event_timestamp", "price", "quantity", "taker_side")
    named = trades.where("trade_id IS NOT NULL").withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
    return trades.where("trade_id IS NULL").unionByName(named)  # rows without an id don't meet in one task


def sequence_of_trade() -> Column:
    return F.struct("event_timestamp", "received_timestamp", "trade_id")


def ohlc(trades: DataFrame, seconds: int) -> DataFrame:
    return trades.groupBy(time_bucket("event_timestamp", seconds).alias("bucket"), *KEYS).agg(*price_aggregates())


def price_aggregates() -> list[Column]:
    return [
        F.min_by("price", sequence_of_trade()).alias("p_open"), F.max("price").alias("p_high"), F.min("price").alias("p_low"),
        F.max_by("price", sequence_of_trade()).alias("p_close"), F.avg("price").alias("p_trade_mean"),
    ]


def volume_aggregates() -> list[Column]:
    side = lambda s: F.sum(F.when(F.col("taker_side") == s, F.col("quantity")).otherwise(0.0))
    return [F.sum("quantity").alias("v_trade"), side("buy").alias("v_buy"), side("sell").alias("v_sell"), F.count_if(F.col("quantity") > 0).alias("cnt_trade")]


def volume_by_side(trades: DataFrame, seconds: int) -> DataFrame:
    return trades.groupBy(time_bucket("event_timestamp", seconds).alias("bucket"), *KEYS).agg(*volume_aggregates())


def with_fill_interval(trades: DataFrame, chunk: int = DAY) -> DataFrame:
    """Adds dt_ms, the milliseconds since the previous trade of the venue and instrument, across buckets."""
    rows = trades.withColumn("__us", F.unix_micros("event_timestamp"))
    rows = previous(rows, "__us", list(KEYS), {"__last_us": F.col("__us")}, chunk, ("received_timestamp", "trade_id"), 1_000_000)
    return rows.withColumn("dt_ms", (F.col("__us") - F.col("__last_us")) / 1000).drop("__us", "__last_us")


def fill_aggregates() -> list[Column]:
    return [F.avg("dt_ms").alias("dt_fill_mean_ms"), F.max("dt_ms").alias("dt_fill_max_ms"), F.min("dt_ms").alias("dt_fill_min_ms")]


def fill_intervals(trades: DataFrame, seconds: int) -> DataFrame:
    return with_fill_interval(trades).groupBy(time_bucket("event_timestamp", seconds).alias("bucket"), *KEYS).agg(*fill_aggregates())


def trade_bars(trades: DataFrame, seconds: int) -> DataFrame:
    """Prices, volumes and fill intervals in one aggregation over deduplicated trades."""
    return with_fill_interval(trades).groupBy(time_bucket("event_timestamp", seconds).alias("bucket"), *KEYS).agg(*price_aggregates(), *volume_aggregates(), *fill_aggregates())


def vwap_bars(trades: DataFrame, seconds: int) -> DataFrame:
    """Over all venues: volume-weighted price, volume, signed delta."""
    signed = F.when(F.col("taker_side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    out = trades.groupBy(time_bucket("event_timestamp", seconds).alias("bucket")).agg(F.sum(F.col("price") * F.col("quantity")).alias("notional"), F.sum("quantity").alias("volume"), F.sum(signed).alias("delta"))
    return out.select("bucket", (F.col("notional") / F.when(F.col("volume") != 0, F.col("volume"))).alias("vwap"), "volume", "delta")


def latest_book(levels: DataFrame, seconds: int) -> DataFrame:
    """The last state of each level in each bucket."""
    last = F.max_by(F.struct("price", "quantity"), F.struct("event_timestamp", "received_timestamp"))
    return levels.groupBy(time_bucket("event_timestamp", seconds).alias("bucket"), *KEYS, "side", "level").agg(last.alias("l")).select("bucket", *KEYS, "side", "level", "l.price", "l.quantity")


def book_columns(depth: int = 10) -> list[str]:
    return [f"{x}_{side}_{k}" for side in SIDES for k in range(1, depth + 1) for x in "pq"]


def book_wide(book: DataFrame, depth: int = 10) -> DataFrame:
    """Long levels to fixed columns, in one conditional aggregation."""
    pick = [F.max(F.when((F.col("side") == side) & (F.col("level") == k), F.col({"p": "price", "q": "quantity"}[x]))).alias(f"{x}_{side}_{k}") for side in SIDES for k in range(1, depth + 1) for x in "pq"]
    return book.groupBy("bucket", *KEYS).agg(*pick)


def time_grid(keys: DataFrame, bounds: DataFrame, seconds: int, run: int = 4096, by: list[str] | tuple[str, ...] = KEYS) -> DataFrame:
    """Every bucket from the first to the last of `bounds` (one row: low, high in epoch seconds), for each key.

    Keys meet the bounds alone; buckets are made in runs of `run`, which are dealt out.
    """
    span = seconds * run
    starts = keys.join(F.broadcast(bounds)).select(*by, "high", F.explode(F.sequence("low", "high", F.lit(span).cast("long"))).alias("start")).repartition(*by, "start")
    buckets = F.sequence("start", F.least(F.col("high"), F.col("start") + (span - seconds)), F.lit(seconds).cast("long"))
    return starts.select(F.explode(buckets).alias("s"), *by).select(F.timestamp_seconds("s").alias("bucket"), *by)


def bounds_of(df: DataFrame, seconds: int) -> DataFrame:
    at = F.floor(F.unix_seconds("event_timestamp") / seconds) * seconds
    return df.agg(F.min(at).alias("low"), F.max(at).alias("high"))


def ffill(df: DataFrame, columns: list[str], by: list[str], order: str = "bucket", chunk: int = DAY) -> DataFrame:
    """The last value that isn't null, up to each row; `order` is a timestamp."""
    return carried(df.withColumn("__at", F.unix_seconds(order)), "__at", by, columns, chunk).drop("__at")


FLOW = ("v_trade", "v_buy", "v_sell", "cnt_trade")


def zero_fill(df: DataFrame) -> DataFrame:
    """Volumes and counts of empty buckets are 0; prices stay null."""
    return df.withColumns({c: F.coalesce(c, F.lit(0)) for c in FLOW})


def resample_bars(trades: DataFrame, levels: DataFrame, seconds: int, depth: int = 10, fill: str | None = None) -> DataFrame:
    """Grid, deduplicated trade bars and carried book on one row a bucket, venue and instrument.

    fill="state" carries prices forward too.
    """
    clean = cut(dedupe_trades(trades))
    bars, book = trade_bars(clean, seconds), book_wide(latest_book(levels, seconds), depth)
    # keys and bounds in one pass over either table: a row a key is left of each
    ends = lambda df: df.groupBy(*KEYS).agg(F.min("event_timestamp").alias("first"), F.max("event_timestamp").alias("last"))
    spans = cut(ends(clean).unionByName(ends(levels)))
    keys = spans.select(*KEYS).distinct()
    bounds = bounds_of(spans.select(F.explode(F.array("first", "last")).alias("event_timestamp")), seconds)
    out = time_grid(keys, bounds, seconds).join(bars, ["bucket", *KEYS], "left").join(book, ["bucket", *KEYS], "left")
    carried = book_columns(depth) + (["p_open", "p_high", "p_low", "p_close"] if fill == "state" else [])
    return zero_fill(ffill(out, carried, list(KEYS)))


def resample_up(bars: DataFrame, seconds: int) -> DataFrame:
    """Coarser bars from finer ones."""
    priced = F.when(F.col("p_open").isNotNull(), F.col("bucket"))
    out = bars.groupBy(time_bucket("bucket", seconds).alias("coarse"), *KEYS).agg(
        F.min_by("p_open", priced).alias("p_open"), F.max("p_high").alias("p_high"), F.min("p_low").alias("p_low"), F.max_by("p_close", priced).alias("p_close"),
        *[F.sum(c).alias(c) for c in FLOW], F.sum(F.col("p_trade_mean") * F.col("v_trade")).alias("notional"))
    return out.select(F.col("coarse").alias("bucket"), *KEYS, "p_open", "p_high", "p_low", "p_close", *FLOW, (F.col("notional") / F.when(F.col("v_trade") != 0, F.col("v_trade"))).alias("vwap"))


def multi_frequency(trades: DataFrame, frequencies: list[int]) -> DataFrame:
    """Bars of several lengths from one read of the trades."""
    each = with_fill_interval(trades).withColumn("seconds", F.explode(F.array(*map(F.lit, frequencies))))
    at = F.timestamp_seconds(F.floor(F.unix_seconds("event_timestamp") / F.col("seconds")) * F.col("seconds"))
    return each.groupBy("seconds", at.alias("bucket"), *KEYS).agg(*price_aggregates(), *volume_aggregates(), *fill_aggregates())


def forward_fill_bars(bars: DataFrame) -> DataFrame:
    """Empty buckets after the first bar repeat the bar before: its close as every price, no flow, no fill times."""
    filled = ffill(bars.withColumn("carried", F.col("p_close")), ["carried"], list(KEYS)).where("carried IS NOT NULL")
    return zero_fill(filled.withColumns({c: F.coalesce(c, "carried") for c in ("p_open", "p_high", "p_low", "p_close", "p_trade_mean")}).drop("carried"))


def row_count_gate(bars: DataFrame, seconds: int, per: int = 86_400) -> DataFrame:
    """Rows a venue and period against what a full grid has."""
    return bars.groupBy("venue", time_bucket("bucket", per).alias("period")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("passed", F.col("n_rows") == per // seconds)
