"""Streaming bars, deduplication, spot prices, archives and features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_dedup(trades: DataFrame, lateness: str = "5 seconds") -> DataFrame:
    """Repeated event ids go, remembered as long as the watermark needs."""
    return trades.withWatermark("event_timestamp", lateness).dropDuplicatesWithinWatermark(["event_id"])


def stale_entry_skip(trades: DataFrame, seconds: int | None, now: Column | None = None) -> DataFrame:
    """Live recency over completeness: entries that arrived too long before `now` (the clock) are skipped; None keeps all, as in batch."""
    if seconds is None:
        return trades
    return trades.where(F.col("received_timestamp") >= (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {seconds} SECONDS"))


def stream_bars(trades: DataFrame, seconds: int, lateness: str = "5 seconds") -> DataFrame:
    """Tumbling event-time bars by venue, each out once, when the watermark has passed its end; later trades are dropped."""
    side = lambda s: F.sum(F.when(F.col("taker_side") == s, F.col("quantity")).otherwise(0.0))
    marked = trades.withWatermark("event_timestamp", lateness)
    order = F.struct("event_timestamp", "received_timestamp", "trade_id")
    out = marked.groupBy(F.window("event_timestamp", f"{seconds} seconds").alias("w"), "venue").agg(
        F.min_by("price", order).alias("p_open"), F.max("price").alias("p_high"), F.min("price").alias("p_low"), F.max_by("price", order).alias("p_close"),
        F.avg("price").alias("p_trade_mean"), F.sum("quantity").alias("v_trade"), side("buy").alias("v_buy"), side("sell").alias("v_sell"), F.count_if(F.col("quantity") > 0).alias("cnt_trade"))
    return out.select("w", F.col("w.start").alias("bucket"), *[c for c in out.columns if c != "w"])


def stream_candles(bars: DataFrame, seconds: int) -> DataFrame:
    """Coarser candles chained behind streaming bars (append mode)."""
    return bars.groupBy(F.window(F.window_time("w"), f"{seconds} seconds").alias("c"), "venue").agg(
        F.min_by("p_open", "bucket").alias("p_open"), F.max("p_high").alias("p_high"), F.min("p_low").alias("p_low"), F.max_by("p_close", "bucket").alias("p_close"), F.sum("v_trade").alias("v_trade")).select(F.col("c.start").alias("bucket"), "venue", "p_open", "p_high", "p_low", "p_close", "v_trade")


def stream_spot(trades: DataFrame) -> DataFrame:
    """The latest price of each venue, updated by every trade (update or complete mode)."""
    return trades.groupBy("venue").agg(F.max_by("price", F.struct("event_timestamp", "received_timestamp", "event_id")).alias("price"), F.max("event_timestamp").alias("at"))


def forming_bar(trades: DataFrame, seconds: int) -> DataFrame:
    """Bars that still change, the unfinished one with them (update or complete mode)."""
    order = F.struct("event_timestamp", "received_timestamp", "trade_id")
    return trades.groupBy(F.window("event_timestamp", f"{seconds} seconds").alias("w")).agg(F.min_by("price", order).alias("p_open"), F.max("price").alias("p_high"), F.min("price").alias("p_low"), F.max_by("price", order).alias("p_close")).select(F.col("w.start").alias("bucket"), "p_open", "p_high", "p_low", "p_close")


def coalesce_latest(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the last row of a micro-batch."""
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def flush(batch: DataFrame, lossless: Column, keys: list[str], order: list[str]) -> DataFrame:
    """A flush window's rows: all that must not be lost (trades), and of the rest (books) the last of each key."""
    return batch.where(lossless).unionByName(coalesce_latest(batch.where(~lossless), keys, order))


#: What the archive holds of each kind of event beside its path's columns, and what its path is made of, before date and hour.
KINDS = {
    "trade": (("event_id", "trade_id", "price", "quantity", "taker_side", "exchange_ts_ms", "received_ts_ms"), ("venue", "instrument")),
    "book": (("event_id", "sequence", "bids", "asks", "depth", "exchange_ts_ms", "received_ts_ms"), ("venue", "instrument")),
    "contract_ticker": (("event_id", "yes_bid_dollars", "yes_ask_dollars", "last_price_dollars", "volume", "open_interest", "exchange_ts_ms", "received_ts_ms"), ("series_ticker", "event_ticker", "market_ticker")),
    "contract_trade": (("event_id", "trade_id", "yes_price_dollars", "count", "taker_side", "exchange_ts_ms", "received_ts_ms"), ("series_ticker", "event_ticker", "market_ticker")),
    "contract_book": (("event_id", "event_type", "sequence", "yes_bids", "no_bids", "delta_price_dollars", "delta_fp", "delta_side", "exchange_ts_ms", "received_ts_ms"), ("series_ticker", "event_ticker", "market_ticker")),
}
FLUSH_ROWS = 10_000


def archive_batch(batch: DataFrame, root: str, name: str, number: int, kinds: dict = KINDS, most: int = FLUSH_ROWS) -> None:
    """Writes a micro-batch: each kind (column kind) below <root>/<kind>/batch=<name>-<number>/, by its path's columns, date
    and hour, files of at most `most` rows that hold one partition each, in order of arrival; rows with an error, or of no
    known kind, to <root>/dead/ likewise. A part that is there in full stays as it is, so a batch that is replayed leaves
    the files that it has made; a part that broke off is written again whole.
    """
    spark = batch.sparkSession
    held = batch.persist()  # read once for all kinds
    try:
        good = F.col("error").isNull() & F.coalesce(F.col("kind").isin(list(kinds)), F.lit(False)) if "error" in batch.columns else F.coalesce(F.col("kind").isin(list(kinds)), F.lit(False))
        at = F.timestamp_millis(F.coalesce("exchange_ts_ms", "received_ts_ms"))
        for kind, (columns, path) in (kinds | {"dead": ((), ())}).items():
            target = f"{root.rstrip('/')}/{kind}/batch={name}-{number}"
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
            if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
                continue
            if kind == "dead":
                rows, by = held.where(~good), []
            else:
                by = [*path, "date", "hour"]
                safe = [F.regexp_replace(F.coalesce(c, F.lit("unknown")), "[^A-Za-z0-9_.-]+", "_").alias(c) for c in path]
                rows = held.where(good & (F.col("kind") == kind)).select(*columns, *safe, F.date_format(at, "yyyy-MM-dd").alias("date"), F.date_format(at, "HH").alias("hour"))
                rows = rows.hint("rebalance", *by).sortWithinPartitions(*by, "received_ts_ms", "event_id")
            if by or not rows.isEmpty():
                rows.write.mode("overwrite").option("maxRecordsPerFile", most).partitionBy(*by).parquet(target)
    finally:
        held.unpersist()


def archive_kinds(events: DataFrame, root: str, name: str, checkpoint: str, trigger: dict | None = None, kinds: dict = KINDS, most: int = FLUSH_ROWS):
    """The archive of all kinds as a streaming query of this name: a flush every 60 seconds, or as `trigger` says. Batches are
    named by the query and their number, so what a failure makes it write again is in its place already.
    """
    return events.writeStream.queryName(name).foreachBatch(lambda batch, number: archive_batch(batch, root, name, number, kinds, most)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def archive_stream(events: DataFrame, root: str, checkpoint: str, by: list[str], trigger: dict | None = None):
    """Exactly-once archive of one kind to partitioned Parquet."""
    return events.writeStream.format("parquet").option("path", root).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", FLUSH_ROWS).partitionBy(*by).trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def split_stream(events: DataFrame, checkpoint: str, good: Callable[[DataFrame], None], dead: Callable[[DataFrame], None], trigger: dict | None = None):
    """Rows without and with an error to their own sinks, batch by batch."""
    def each(batch: DataFrame, _: int) -> None:
        good(batch.where("error IS NULL"))
        dead(batch.where("error IS NOT NULL"))

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()
