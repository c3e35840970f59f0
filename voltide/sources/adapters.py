"""Market data from the star-schema tables: trades and book levels from events, option-like quotes from hourly prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = 10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with `ts` as a TIMESTAMP in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def later(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + seconds * 1_000_000)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trades, some of them delivered twice."""
    e = events(spark, sf_dir)
    received = later(F.col("ts"), F.col("event_id") % 7)
    once = e.select(
        F.col("ts").alias("event_timestamp"), received.alias("received_timestamp"), received.alias("ingested_at"),
        F.col("event_type").alias("venue"), F.lit("SYN").alias("instrument"),
        F.when(F.col("event_id") % 50 != 0, F.col("event_id").cast("string")).alias("trade_id"),
        (100 + F.col("value") / 10).alias("price"), (F.get_json_object("props", "$.k").cast("int") / 10.0).cast("double").alias("quantity"),
        F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("taker_side"),
        F.col("event_id").alias("event_id"), F.lit(None).cast("string").alias("source_object"),
    )
    again = once.where("trade_id IS NOT NULL AND event_id % 40 = 0").withColumn("ingested_at", later(F.col("ingested_at"), F.lit(60)))
    return once.unionByName(again)


def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book snapshots of the even events, a row a side and level."""
    e = events(spark, sf_dir).where("event_id % 2 = 0")
    rows = e.select("*", F.explode(F.array(F.lit("bid"), F.lit("ask"))).alias("side")).select("*", F.explode(F.sequence(F.lit(1), F.lit(LEVELS))).alias("level"))
    mid, step = 100 + F.col("value") / 10, 0.01 * F.col("level")
    return rows.select(
        F.col("ts").alias("event_timestamp"), later(F.col("ts"), F.col("event_id") % 7).alias("received_timestamp"),
        F.col("event_type").alias("venue"), F.lit("SYN").alias("instrument"), "side", "level",
        F.when(F.col("side") == "bid", mid - step).otherwise(mid + step).alias("price"),
        (1 + (F.col("event_id") * F.col("level") * 7) % 13).cast("double").alias("quantity"), "event_id",
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Above-strike contract quotes of each hour: 17 strikes about the hour's mean trade price."""
    hour = (F.floor(F.unix_seconds("event_timestamp") / 3600) * 3600).alias("hour")
    spots = trades(spark, sf_dir).where("ingested_at = received_timestamp").groupBy(hour).agg(F.avg("price").alias("spot"))
    rows = spots.select("*", F.explode(F.sequence(F.lit(-8), F.lit(8))).alias("j"))
    mid = 1 / (1 + F.exp(0.27 * F.col("j")))
    event = F.concat(F.lit("SER-"), F.date_format(F.timestamp_seconds("hour"), "yyyyMMddHH"))
    return rows.select(
        "hour", "j", event.alias("event_ticker"), F.concat(event, F.lit("-T"), F.col("j") + 8).alias("market_ticker"), "spot",
        (F.col("spot") * F.exp(F.col("j") * 0.0005)).alias("strike"),
        F.round(mid - 0.01, 4).alias("bid"), F.round(mid + 0.01, 4).alias("ask"),
        ((F.floor(F.col("hour") / 3600) * 31 + F.abs("j") * 17) % 100).cast("long").alias("open_interest"),
        (F.col("hour") + 3600).alias("expiry"), (F.col("hour") + 1800).alias("quoted_on"),
    )


#: The same tables as common table expressions of DuckDB.
SQL = """
trades AS (
  WITH o AS (SELECT ts AS event_timestamp, ts + to_seconds(event_id % 7) AS received_timestamp, ts + to_seconds(event_id % 7) AS ingested_at,
    event_type AS venue, 'SYN' AS instrument, CASE WHEN event_id % 50 <> 0 THEN event_id::VARCHAR END AS trade_id,
    100 + value / 10 AS price, json_extract_string(props, '$.k')::INT / 10.0::DOUBLE AS quantity,
    CASE WHEN user_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS taker_side, event_id, NULL::VARCHAR AS source_object FROM events)
  SELECT * FROM o UNION ALL
  SELECT * REPLACE (ingested_at + to_seconds(60) AS ingested_at) FROM o WHERE trade_id IS NOT NULL AND event_id % 40 = 0),
deduped AS (SELECT * FROM trades QUALIFY trade_id IS NULL OR row_number() OVER (PARTITION BY venue, instrument, trade_id
  ORDER BY coalesce(received_timestamp, event_timestamp), ingested_at, source_object, event_timestamp, price, quantity, taker_side) = 1),
book_levels AS (
  SELECT ts AS event_timestamp, ts + to_seconds(event_id % 7) AS received_timestamp, event_type AS venue, 'SYN' AS instrument, side, level,
    CASE side WHEN 'bid' THEN 100 + value / 10 - 0.01::DOUBLE * level ELSE 100 + value / 10 + 0.01::DOUBLE * level END AS price,
    (1 + (event_id * level * 7) % 13)::DOUBLE AS quantity, event_id
  FROM events, (VALUES ('bid'), ('ask')) s(side), (SELECT unnest(range(1, 11)) AS level) l WHERE event_id % 2 = 0),
quotes AS (
  WITH s AS (SELECT epoch_us(event_timestamp) // 3600000000 * 3600 AS hour, avg(price) AS spot FROM trades WHERE ingested_at = received_timestamp GROUP BY ALL)
  SELECT hour, j, 'SER-' || strftime(make_timestamp(hour * 1000000), '%Y%m%d%H') AS event_ticker,
    'SER-' || strftime(make_timestamp(hour * 1000000), '%Y%m%d%H') || '-T' || (j + 8) AS market_ticker, spot,
    spot * exp(j * 0.0005::DOUBLE) AS strike, round(1 / (1 + exp(0.27::DOUBLE * j)) - 0.01, 4) AS bid, round(1 / (1 + exp(0.27::DOUBLE * j)) + 0.01, 4) AS ask,
    ((hour // 3600 * 31 + abs(j) * 17) % 100)::BIGINT AS open_interest, hour + 3600 AS expiry, hour + 1800 AS quoted_on
  FROM s, (SELECT unnest(range(-8, 9)) AS j))
"""
