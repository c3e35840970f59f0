"""Queries over bars and joins on the grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltide.operators import bars as B
from voltide.operators import joins as J
from voltide.sources.adapters import book_levels, trades

from .base import BARS, BUCKET, HOUR, TRADE_BARS, query


def flat(df):
    """Buckets as epoch seconds."""
    return df.withColumn("bucket", F.unix_seconds("bucket"))


def clean(spark, d):
    return B.dedupe_trades(trades(spark, d))


def hourly(spark, d):
    return B.resample_bars(trades(spark, d), book_levels(spark, d), HOUR)


@query("dedupe_trades", "SELECT venue, trade_id, price, quantity, taker_side, epoch_us(ingested_at) AS ingested FROM deduped")
def dedupe_trades(spark, d):
    return clean(spark, d).select("venue", "trade_id", "price", "quantity", "taker_side", F.unix_micros("ingested_at").alias("ingested"))


@query("time_bucket", f"SELECT event_id, {BUCKET} AS bucket, epoch_us(event_timestamp) // 600000000 * 600 AS bucket_600 FROM trades")
def time_bucket(spark, d):
    return trades(spark, d).select("event_id", *[F.unix_seconds(B.time_bucket("event_timestamp", n)).alias(a) for n, a in ((HOUR, "bucket"), (600, "bucket_600"))])


PRICES = "p_open, p_high, p_low, p_close, p_trade_mean"
VOLUMES = "v_trade, v_buy, v_sell, cnt_trade"
FILLS = "dt_fill_mean_ms, dt_fill_max_ms, dt_fill_min_ms"


@query("ohlc", f"SELECT bucket, venue, instrument, {PRICES} FROM trade_bars", TRADE_BARS)
def ohlc(spark, d):
    return flat(B.ohlc(clean(spark, d), HOUR))


@query("volume_by_side", f"SELECT bucket, venue, instrument, {VOLUMES} FROM trade_bars", TRADE_BARS)
def volume_by_side(spark, d):
    return flat(B.volume_by_side(clean(spark, d), HOUR))


@query("fill_intervals", f"SELECT bucket, venue, instrument, {FILLS} FROM trade_bars", TRADE_BARS)
def fill_intervals(spark, d):
    return flat(B.fill_intervals(clean(spark, d), HOUR))


@query("vwap_bars", f"SELECT {BUCKET} AS bucket, sum(price * quantity) / nullif(sum(quantity), 0) AS vwap, sum(quantity) AS volume, sum(CASE taker_side WHEN 'buy' THEN quantity ELSE -quantity END) AS delta FROM deduped GROUP BY ALL")
def vwap_bars(spark, d):
    return flat(B.vwap_bars(clean(spark, d), HOUR))


@query("latest_book_per_bucket", "SELECT bucket, venue, instrument, side, level, price, quantity FROM latest", TRADE_BARS)
def latest_book(spark, d):
    return flat(B.latest_book(book_levels(spark, d), HOUR))


@query("book_wide", "SELECT * FROM wide", TRADE_BARS)
def book_wide(spark, d):
    return flat(B.book_wide(B.latest_book(book_levels(spark, d), HOUR)))


@query("time_grid", "SELECT * FROM grid", TRADE_BARS)
def time_grid(spark, d):
    t = clean(spark, d)
    return flat(B.time_grid(t.select(*B.KEYS).distinct(), B.bounds_of(t, HOUR), HOUR))


@query("grid_left_join", f"SELECT bucket, venue, instrument, {PRICES}, v_trade FROM grid LEFT JOIN trade_bars USING (bucket, venue, instrument)", TRADE_BARS)
def grid_left_join(spark, d):
    t = clean(spark, d)
    grid = B.time_grid(t.select(*B.KEYS).distinct(), B.bounds_of(t, HOUR), HOUR)
    return flat(grid.join(B.trade_bars(t, HOUR), ["bucket", *B.KEYS], "left").select("bucket", *B.KEYS, *PRICES.split(", "), "v_trade"))


BOOK_GRID = "SELECT * FROM (SELECT bucket, venue, instrument, side, level FROM grid, (VALUES ('bid'), ('ask')) s(side), (SELECT unnest(range(1, 11)) AS level)) LEFT JOIN latest USING (bucket, venue, instrument, side, level)"


@query("book_grid_join", f"SELECT * FROM ({BOOK_GRID})", TRADE_BARS)
def book_grid_join(spark, d):
    return flat(J.book_grid(_grid(spark, d), B.latest_book(book_levels(spark, d), HOUR)))


def _grid(spark, d):
    t = clean(spark, d)
    return B.time_grid(t.select(*B.KEYS).distinct(), B.bounds_of(t, HOUR), HOUR)


@query("ffill_state", f"SELECT bucket, venue, instrument, side, level, last_value(price IGNORE NULLS) OVER w AS price, last_value(quantity IGNORE NULLS) OVER w AS quantity FROM ({BOOK_GRID}) WINDOW w AS (PARTITION BY venue, instrument, side, level ORDER BY bucket ROWS UNBOUNDED PRECEDING)", TRADE_BARS)
def ffill_state(spark, d):
    long = J.book_grid(_grid(spark, d), B.latest_book(book_levels(spark, d), HOUR))
    return flat(B.ffill(long, ["price", "quantity"], [*B.KEYS, "side", "level"]))


@query("zero_fill_flow", f"SELECT bucket, venue, instrument, p_close, {VOLUMES} FROM bars", BARS)
def zero_fill_flow(spark, d):
    t = clean(spark, d)
    return flat(B.zero_fill(_grid(spark, d).join(B.trade_bars(t, HOUR), ["bucket", *B.KEYS], "left")).select("bucket", *B.KEYS, "p_close", *VOLUMES.split(", ")))


@query("resample_bars", "SELECT * FROM bars", BARS)
def resample_bars(spark, d):
    return flat(hourly(spark, d))


@query("resample_up", "SELECT bucket // 14400 * 14400 AS bucket, venue, instrument, first(p_open ORDER BY bucket) FILTER (p_open IS NOT NULL) AS p_open, max(p_high) AS p_high, min(p_low) AS p_low, last(p_close ORDER BY bucket) FILTER (p_close IS NOT NULL) AS p_close, sum(v_trade) AS v_trade, sum(v_buy) AS v_buy, sum(v_sell) AS v_sell, sum(cnt_trade)::BIGINT AS cnt_trade, sum(p_trade_mean * v_trade) / nullif(sum(v_trade), 0) AS vwap FROM bars GROUP BY ALL", BARS)
def resample_up(spark, d):
    return flat(B.resample_up(hourly(spark, d), 4 * HOUR))


def _frequency(n):
    b = f"epoch_us(event_timestamp) // {n}000000 * {n}"
    return f"SELECT {n} AS seconds, {b} AS bucket, venue, instrument, first(price ORDER BY event_timestamp) AS p_open, last(price ORDER BY event_timestamp) AS p_close, sum(quantity) AS v_trade, count(*) FILTER (quantity > 0) AS cnt_trade, max(dt_ms) AS dt_fill_max_ms FROM timed GROUP BY ALL"


@query("multi_frequency", " UNION ALL ".join(_frequency(n) for n in (60, 600, 3600)), TRADE_BARS)
def multi_frequency(spark, d):
    return flat(B.multi_frequency(clean(spark, d), [60, 600, 3600])).select("seconds", "bucket", *B.KEYS, "p_open", "p_close", "v_trade", "cnt_trade", "dt_fill_max_ms")


@query("forward_fill_bars", f"""SELECT bucket, venue, instrument, coalesce(p_open, c) AS p_open, coalesce(p_high, c) AS p_high, coalesce(p_low, c) AS p_low, coalesce(p_close, c) AS p_close, coalesce(p_trade_mean, c) AS p_trade_mean, {VOLUMES}, {FILLS}
  FROM (SELECT *, last_value(p_close IGNORE NULLS) OVER (PARTITION BY venue, instrument ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS c FROM bars) WHERE c IS NOT NULL""", BARS)
def forward_fill_bars(spark, d):
    return flat(B.forward_fill_bars(hourly(spark, d).select("bucket", *B.KEYS, *PRICES.split(", "), *VOLUMES.split(", "), *FILLS.split(", "))))


@query("row_count_gate", "SELECT venue, bucket // 86400 * 86400 AS period, count(*) AS n_rows, count(*) = 24 AS passed FROM bars GROUP BY ALL", BARS)
def row_count_gate(spark, d):
    return B.row_count_gate(hourly(spark, d), HOUR).withColumn("period", F.unix_seconds("period"))


@query("asof_book_join", f"""SELECT t.bucket, t.venue, b.price AS p_bid_1, epoch_us(b.event_timestamp) AS book_us FROM trade_bars t
  ASOF LEFT JOIN (SELECT venue, event_timestamp, price FROM book_levels WHERE side = 'bid' AND level = 1) b
  ON t.venue = b.venue AND make_timestamp((t.bucket + 3600) * 1000000) > b.event_timestamp""", TRADE_BARS)
def asof_book_join(spark, d):
    tops = book_levels(spark, d).where("side = 'bid' AND level = 1").select("venue", F.col("event_timestamp").alias("at"), "price")
    ends = B.trade_bars(clean(spark, d), HOUR).select("venue", "bucket", F.timestamp_seconds(F.unix_seconds("bucket") + HOUR).alias("at"))
    out = J.asof(ends, tops, ["venue"], "at", ["price"], strict=True)
    return out.select(F.unix_seconds("bucket").alias("bucket"), "venue", F.col("price").alias("p_bid_1"), F.unix_micros("matched_at").alias("book_us"))


@query("venue_outer_join", f"SELECT bucket, {', '.join(f'''max(p_close) FILTER (venue = '{v}') AS {v}''' for v in ('click', 'purchase', 'view'))}, count(p_close) AS n_venues FROM trade_bars GROUP BY bucket", TRADE_BARS)
def venue_outer_join(spark, d):
    return flat(J.align_venues(B.ohlc(clean(spark, d), HOUR), "p_close", ["click", "purchase", "view"]))


DAYS = "SELECT DISTINCT venue, epoch_us(event_timestamp) // 86400000000 AS day FROM trades WHERE event_id % 3 = 0 AND (epoch_us(event_timestamp) // 86400000000) % 4 <> 0"


@query("coverage_anti_join", "SELECT venue, day FROM (SELECT venue, unnest(range(min(day), max(day) + 1)) AS day FROM o GROUP BY venue) ANTI JOIN o USING (venue, day)", f"o AS ({DAYS})")
def coverage_anti_join(spark, d):
    day = F.floor(F.unix_seconds("event_timestamp") / 86400)
    seen = trades(spark, d).where("event_id % 3 = 0").select("venue", day.alias("day")).where("day % 4 <> 0")
    return J.missing_days(seen)


@query("load_bars", "SELECT bucket, venue, p_close FROM trade_bars WHERE venue IN ('click', 'view')", TRADE_BARS)
def load_bars(spark, d):
    return flat(J.chosen_venues(B.ohlc(clean(spark, d), HOUR), ["click", "view"])).select("bucket", "venue", "p_close")


@query("exclude_venues", "SELECT venue, count(*) AS n FROM trades WHERE venue NOT IN ('click', 'view') GROUP BY venue")
def exclude_venues(spark, d):
    return trades(spark, d).where(~F.col("venue").isin("click", "view")).groupBy("venue").agg(F.count(F.lit(1)).alias("n"))
