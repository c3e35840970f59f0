"""Queries over sources, sinks, normalisation and validation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voltide.operators import bars as B
from voltide.operators import ingest as G
from voltide.sources import lake
from voltide.sources.adapters import book_levels, events, quotes, trades

from .bars import clean
from .base import BUCKET, SYNTHETIC, query
from .features import FEATURES, LABELS, features, labels

DAY = "(epoch_us(event_timestamp) // 86400000000)"


def folder_of(spark) -> str:
    """Where queries put tables of their own: the shared folder of a cluster, below the warehouse where none is named."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def lake_of(spark, d):
    """The trades, written to a lake of our own below the warehouse or checkpoint folder."""
    root = f"{folder_of(spark)}/lake-{uuid.uuid4().hex}"
    rows = G.partition_keys(clean(spark, d).drop("source_object"), "venue")
    lake.write_hive(rows, root, ["date", "venue"], cluster=["instrument", "event_timestamp"])
    return root


@query("scan_partitioned", "SELECT venue, epoch_us(event_timestamp) // 3600000000 AS hour, trade_id, price FROM deduped WHERE (epoch_us(event_timestamp) // 3600000000 BETWEEN 19727 * 24 + 20 AND 19728 * 24 + 3 OR epoch_us(event_timestamp) // 3600000000 = 19740 * 24 + 20) AND venue IN ('click', 'view')")
def scan_partitioned(spark, d):
    """Eight hours across midnight, and one hour alone, of a lake by date and hour."""
    root = f"{folder_of(spark)}/hours-{uuid.uuid4().hex}"
    lake.write_hive(G.partition_keys(clean(spark, d).drop("source_object"), "venue"), root, ["date", "hour"], cluster=["venue", "event_timestamp"])
    found = lake.scan_partitioned(spark, root, "2024-01-05 20", "2024-01-06 03", ["click", "view"]).unionByName(lake.scan_partitioned(spark, root, "2024-01-18 20", "2024-01-18 20", ["click", "view"]))
    return found.select("venue", F.floor(F.unix_seconds("event_timestamp") / 3600).alias("hour"), "trade_id", "price")


@query("write_hive", f"SELECT venue, {DAY} AS day, count(*) AS n, sum(price) AS total FROM deduped GROUP BY ALL")
def write_hive(spark, d):
    rows = spark.read.parquet(lake_of(spark, d))
    return rows.groupBy("venue", F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))


@query("replace_partition", f"SELECT venue, {DAY} AS day, count(*) AS n, sum(CASE WHEN {DAY} = 19728 THEN price + 1 ELSE price END) AS total FROM deduped GROUP BY ALL")
def replace_partition(spark, d):
    root = lake_of(spark, d)
    new = spark.read.parquet(root).where("date = DATE'2024-01-06'").withColumn("price", F.col("price") + 1)
    lake.replace_partition(new, root, ["date", "venue"])
    rows = spark.read.parquet(root)
    return rows.groupBy("venue", F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))


SLICE = "event_id BETWEEN 100 AND 5000 AND venue = 'view'"


@query("replace_slice", f"SELECT event_id, venue, price FROM deduped WHERE NOT ({SLICE}) UNION ALL SELECT event_id, venue, price * 2 FROM deduped WHERE {SLICE} AND event_id % 2 = 0")
def replace_slice(spark, d):
    rows = clean(spark, d).select("event_id", "venue", "price")
    new = rows.where("event_id % 2 = 0").withColumn("price", F.col("price") * 2)
    return G.replace_slice(rows, new, F.col("event_id").between(100, 5000) & (F.col("venue") == "view"))


@query("upsert", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE price END AS price FROM deduped WHERE event_id % 2 = 0 OR event_id % 3 = 0")
def upsert(spark, d):
    rows = clean(spark, d).select("event_id", "price")
    return G.upsert(rows.where("event_id % 2 = 0"), rows.where("event_id % 3 = 0").withColumn("price", F.lit(0.0)), ["event_id"])


@query("append_dedup", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN price + 1 ELSE price END AS price FROM deduped WHERE event_id % 2 = 0 OR event_id % 3 = 0")
def append_dedup(spark, d):
    rows = clean(spark, d).select("event_id", "price")
    return G.append_dedup(rows.where("event_id % 2 = 0"), rows.where("event_id % 3 = 0").withColumn("price", F.col("price") + 1), ["event_id"])


def landing(spark, d):
    e = events(spark, d)
    return e.select(
        F.unix_millis("ts").alias("exchange_ts_ms"), F.when(F.col("event_id") % 5 != 0, F.unix_millis("ts") + F.col("event_id") % 7 * 1000).alias("received_ts_ms"),
        F.upper("event_type").alias("venue"), F.lit("syn").alias("instrument"), F.when(F.col("event_id") % 4 != 0, F.col("event_id").cast("string")).alias("trade_id"),
        F.concat(F.lit("e"), "event_id").alias("event_id"), F.concat(F.lit("r"), "event_id").alias("redis_id"),
        F.when(F.col("event_id") % 11 == 0, "bad").when(F.col("event_id") % 13 == 0, "-1").otherwise(F.format_string("%.4f", F.col("value"))).alias("price"),
        F.get_json_object("props", "$.k").alias("quantity"), F.when(F.col("user_id") % 3 == 0, "buy").when(F.col("user_id") % 3 == 1, "sell").otherwise("none").alias("taker_side"),
        F.when(F.col("event_id") % 17 == 0, 2).otherwise(1).alias("schema_version"))


LANDING = """
landing AS (SELECT epoch_us(ts) // 1000 AS exchange_ts_ms, CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) // 1000 + event_id % 7 * 1000 END AS received_ts_ms, upper(event_type) AS venue, 'syn' AS instrument,
  CASE WHEN event_id % 4 <> 0 THEN event_id::VARCHAR END AS trade_id, 'e' || event_id AS event_id, 'r' || event_id AS redis_id,
  CASE WHEN event_id % 11 = 0 THEN 'bad' WHEN event_id % 13 = 0 THEN '-1' ELSE printf('%.4f', value) END AS price, json_extract_string(props, '$.k') AS quantity,
  CASE user_id % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' ELSE 'none' END AS taker_side, CASE WHEN event_id % 17 = 0 THEN 2 ELSE 1 END AS schema_version FROM events)"""


@query("load_trades", "SELECT exchange_ts_ms AS event_ms, coalesce(received_ts_ms, exchange_ts_ms) AS received_ms, lower(venue) AS venue, upper(instrument) AS instrument, coalesce(trade_id, event_id, redis_id) AS trade_id, try_cast(price AS DOUBLE) AS price, try_cast(quantity AS DOUBLE) AS quantity, taker_side FROM landing", LANDING)
def load_trades(spark, d):
    out = G.load_trades(landing(spark, d))
    return out.select(F.unix_millis("event_timestamp").alias("event_ms"), F.unix_millis("received_timestamp").alias("received_ms"), "venue", "instrument", "trade_id", "price", "quantity", "taker_side")


ERROR = """CASE WHEN schema_version <> 1 THEN 'schema_version' WHEN trade_id IS NULL THEN 'text' WHEN try_cast(price AS DOUBLE) IS NULL OR try_cast(price AS DOUBLE) < 0 THEN 'price'
  WHEN try_cast(quantity AS DOUBLE) IS NULL OR try_cast(quantity AS DOUBLE) < 0 THEN 'quantity' WHEN received_ts_ms IS NULL OR received_ts_ms <= 0 THEN 'timestamp' WHEN taker_side NOT IN ('buy', 'sell') THEN 'taker_side' END"""


@query("validate_trades", f"SELECT event_id, lower(venue) AS venue, upper(instrument) AS instrument, {ERROR} AS error FROM landing", LANDING)
def validate_trades(spark, d):
    return G.validate_trades(landing(spark, d)).select("event_id", "venue", "instrument", "error")


@query("dead_letter", f"SELECT coalesce({ERROR}, 'good') AS kind, count(*) AS n FROM landing GROUP BY 1", LANDING)
def dead_letter(spark, d):
    good, dead = G.split_dead(G.validate_trades(landing(spark, d)))
    return good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("good").alias("kind"), "n").unionByName(dead.groupBy(F.col("error").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


def books(spark, d):
    """Books as arrays best first; every eleventh is crossed, every thirteenth has no asks."""
    rows = book_levels(spark, d).groupBy("event_id", "venue", "event_timestamp")
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("level", "price", "quantity")))), lambda x: F.struct(x["price"].alias("price"), x["quantity"].alias("quantity")))
    out = rows.agg(side("bid").alias("bids"), side("ask").alias("asks"))
    return out.withColumn("asks", F.when(F.col("event_id") % 13 == 0, F.slice("asks", 1, 0)).when(F.col("event_id") % 11 == 0, F.transform("asks", lambda a: F.struct((a["price"] - 0.05).alias("price"), a["quantity"].alias("quantity")))).otherwise(F.col("asks")))


BOOKS = """
asks AS (SELECT event_id, venue, level, CASE WHEN event_id % 11 = 0 THEN price - 0.05::DOUBLE ELSE price END AS price, quantity FROM book_levels WHERE side = 'ask' AND event_id % 13 <> 0),
best AS (SELECT event_id, venue, price AS bid FROM book_levels WHERE side = 'bid' AND level = 1)"""


@query("validate_books", "SELECT b.event_id, CASE WHEN a.event_id IS NULL THEN 'empty' WHEN bid >= a.price THEN 'crossed' END AS error, 10 AS depth FROM best b LEFT JOIN asks a ON a.event_id = b.event_id AND a.level = 1", BOOKS)
def validate_books(spark, d):
    raw = books(spark, d).select("event_id", "bids", "asks", F.lit(None).cast("long").alias("exchange_ts_ms"), F.unix_millis("event_timestamp").alias("received_ts_ms"))
    return G.validate_books(raw).select("event_id", "error", "depth")


@query("uncross_snapshot_asks", "SELECT b.event_id, count(a.price) AS n_asks, min(a.price) AS best_ask, CASE WHEN count(a.price) = 0 THEN 'crossed' END AS error FROM best b LEFT JOIN asks a ON a.event_id = b.event_id AND a.price > bid GROUP BY b.event_id", BOOKS)
def uncross_snapshot_asks(spark, d):
    return G.uncross_asks(books(spark, d)).select("event_id", F.size("asks").cast("long").alias("n_asks"), F.get("asks", F.lit(0))["price"].alias("best_ask"), "error")


@query("load_book_levels", "SELECT event_id, side, level, price, quantity FROM book_levels")
def load_book_levels(spark, d):
    json = lambda s: F.to_json(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("level", "price", "quantity")))), lambda x: F.struct(x["price"].cast("string").alias("price"), x["quantity"].cast("string").alias("quantity"))))
    landed = book_levels(spark, d).groupBy("event_id").agg(json("bid").alias("bids"), json("ask").alias("asks"))
    return G.load_book_levels(landed)


@query("archive_trade_csv", """SELECT trade_id, us, price, taker_side, coalesce(us >= lag(us) OVER (ORDER BY event_id), true) AS in_order FROM (SELECT event_id, event_id::VARCHAR AS trade_id, value AS price, CASE WHEN user_id % 2 = 0 THEN 'sell' ELSE 'buy' END AS taker_side,
  CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000 * 1000 ELSE epoch_us(ts) END - CASE WHEN event_id % 97 = 0 THEN 3600000000 ELSE 0 END AS us FROM events)""")
def archive_trade_csv(spark, d):
    """Every other time in milliseconds, and one in 97 an hour too early."""
    us = F.unix_micros("ts") - F.when(F.col("event_id") % 97 == 0, 3_600_000_000).otherwise(0)
    rows = events(spark, d).select(F.col("event_id").alias("id"), F.col("value").alias("price"), F.lit(1.0).alias("qty"), F.when(F.col("event_id") % 2 == 0, F.floor(us / 1000)).otherwise(us).alias("time"), (F.col("user_id") % 2 == 0).alias("is_buyer_maker"))
    out = G.archive_trade_csv(rows, "archive", "SYN")
    return out.select("trade_id", F.unix_micros("event_timestamp").alias("us"), "price", "taker_side", "in_order")


@query("drop_path_columns", "SELECT event_id, price FROM deduped")
def drop_path_columns(spark, d):
    to = f"{folder_of(spark)}/bare-{uuid.uuid4().hex}"
    return lake.drop_path_columns(clean(spark, d).select("event_id", "price", "venue", "instrument"), ["venue", "instrument"], to)


@query("compat_view", f"SELECT asset, bucket, log_return, realized_vol_10800s, 'v2' AS feature_version FROM ({FEATURES})", SYNTHETIC)
def compat_view(spark, d):
    return lake.compat_view(features(spark, d), ["asset", "bucket", "log_return", "realized_vol_10800s"], "v2")


@query("partition_keys", "SELECT event_id, regexp_replace(event_type || '/x y', '[^A-Za-z0-9_.-]+', '_', 'g') AS venue, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour FROM events")
def partition_keys(spark, d):
    rows = events(spark, d).select("event_id", F.concat("event_type", F.lit("/x y")).alias("venue"), F.col("ts").alias("event_timestamp"), F.col("ts").alias("received_timestamp"))
    return G.partition_keys(rows, "venue").select("event_id", "venue", "date", "hour")


@query("dedupe_events", "SELECT event_id, count(*) AS n FROM (SELECT DISTINCT event_id FROM trades) GROUP BY 1")
def dedupe_events(spark, d):
    return trades(spark, d).dropDuplicates(["event_id"]).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("prepare_bars", f"SELECT venue, {BUCKET} AS second, last(price ORDER BY event_id) AS price FROM deduped GROUP BY ALL")
def prepare_bars(spark, d):
    raw = clean(spark, d).select("venue", B.time_bucket("event_timestamp", 3600).cast("string").alias("timestamp"), F.col("price").cast("string").alias("price"), F.col("event_id").alias("ordinal"))
    return G.prepare_bars(raw, ["price"]).select("venue", F.unix_seconds("timestamp").alias("second"), "price")


@query("validate_training", f"SELECT count(*) AS n_rows, count(target_rv_3600s) AS n_1h, count(target_rv_21600s) AS n_6h, count(*) FILTER (bucket IS NULL) AS n_null_time FROM ({LABELS})", SYNTHETIC)
def validate_training(spark, d):
    """Counts of a training set that is found fit; one that isn't is an error."""
    rows = G.validate_training(labels(spark, d), ["target_rv_3600s", "target_rv_21600s"])
    found = G.training_violations(rows, ["target_rv_3600s", "target_rv_21600s"])
    return found.select("n_rows", F.col("usable_target_rv_3600s").alias("n_1h"), F.col("usable_target_rv_21600s").alias("n_6h"), "n_null_time")


@query("validate_features", f"""SELECT unnest(['blank_asset', 'after_as_of', 'null_log_return', 'null_realized_vol_86400s']) AS violation, unnest([count(*) FILTER (trim(asset) = ''), count(*) FILTER (bucket > 1706000000), count(*) FILTER (log_return IS NULL), count(*) FILTER (realized_vol_86400s IS NULL)]) AS n FROM ({FEATURES})""", SYNTHETIC)
def validate_features(spark, d):
    return G.validate_features(features(spark, d), ["log_return", "realized_vol_86400s"], 1706000000)


@query("fresh_only", "SELECT event_id, CASE WHEN 1704067200 + 86400 - epoch_us(ts) // 1000000 > 3600 THEN 'stale' WHEN 1704067200 + 86400 - epoch_us(ts) // 1000000 < -2 THEN 'future' END AS reason FROM events")
def fresh_only(spark, d):
    return events(spark, d).select("event_id", G.fresh(F.unix_seconds("ts"), F.lit(1704067200 + 86400), 3600, 2).alias("reason"))


@query("parse_contract_metadata", "SELECT market_ticker, CASE WHEN j % 3 = 0 THEN (j + 8)::DOUBLE WHEN j % 3 IN (1, -2) THEN (j + 8)::DOUBLE ELSE 999.0 END AS parsed, CASE WHEN j % 3 NOT IN (0, 1, -2) THEN 'mismatch' WHEN abs(j) = 6 THEN 'type' END AS error FROM quotes")
def parse_contract_metadata(spark, d):
    q = quotes(spark, d)
    rows = q.select("market_ticker", F.when(F.col("j") % 3 == 0, (F.col("j") + 8).cast("string")).alias("floor_strike"), F.when(~(F.col("j") % 3).isin(0, 1, -2), "999").alias("functional_strike"), F.lit(None).cast("string").alias("strike"), F.when(F.abs("j") == 6, "below").otherwise("above").alias("strike_type"))
    return G.contract_metadata(rows).select("market_ticker", "parsed", "error")


@query("choose_event", "SELECT 'SER' AS series, first(event_ticker ORDER BY (expiry - 1704500000 > 7200)::INT, expiry) AS event_ticker FROM (SELECT DISTINCT event_ticker, expiry FROM quotes WHERE expiry > 1704500000 AND hour // 3600 % 2 = 0)")
def choose_event(spark, d):
    rows = quotes(spark, d).select(F.lit("SER").alias("series"), "event_ticker", F.col("expiry").alias("when"), F.when(F.floor(F.col("hour") / 3600) % 2 == 0, "open").otherwise("closed").alias("status")).distinct()
    return G.choose_event(rows, 1704500000)


@query("flatten_envelope", f"""SELECT asset, bucket, CASE WHEN h % 11 <> 3 THEN log_return END AS log_return, CASE WHEN h % 11 NOT IN (4, 5) THEN venue_count END AS venue_count, bucket + 3600 AS available,
  CASE h % 11 WHEN 1 THEN 'feature_version' WHEN 2 THEN 'feature_set' WHEN 3 THEN 'missing:log_return' WHEN 4 THEN 'type:venue_count' END AS error FROM (SELECT *, bucket // 3600 AS h FROM ({FEATURES}))""", SYNTHETIC)
def flatten_envelope(spark, d):
    """Envelopes made from features and read again: some of another version or set, with a field left out, of the wrong type, or null."""
    h = F.floor(F.col("bucket") / 3600) % 11
    fields = {"log_return": "double", "venue_count": "long"}
    rows = features(spark, d).withColumn("available", F.col("bucket") + 3600)
    made = rows.where(h != 5).withColumn("h", h)
    text = G.envelope(made.where("h NOT IN (1, 2)"), fields, "v4").unionByName(G.envelope(made.where("h = 1"), fields, "v3")).unionByName(G.envelope(made.where("h = 2"), fields, "v4", "other"))
    none = rows.where(h == 5).withColumn("venue_count", F.lit(None).cast("long"))
    text = text.unionByName(G.envelope(none, fields, "v4")).withColumn("at", F.floor(F.get_json_object("envelope", "$.event_timestamp_ms").cast("long") / 3_600_000) % 11)
    text = text.withColumn("envelope", F.when(F.col("at") == 3, F.regexp_replace("envelope", '"log_return":', '"log_ret":')).when(F.col("at") == 4, F.regexp_replace("envelope", '"venue_count":[0-9]+', '"venue_count":"some"')).otherwise(F.col("envelope")))
    return G.flatten_envelope(text, fields, "v4").select("asset", "bucket", "log_return", "venue_count", "available", "error")


@query("atomic_replace", f"""SELECT venue, {DAY} AS day, count(*) AS n, sum(CASE WHEN {DAY} = 19728 THEN price + 1 WHEN event_id BETWEEN 100 AND 5000 AND venue = 'view' THEN price * 2 ELSE price END) AS total FROM deduped
  WHERE {DAY} = 19728 OR NOT (event_id BETWEEN 100 AND 5000 AND venue = 'view') OR event_id % 2 = 0 GROUP BY ALL""")
def atomic_replace(spark, d):
    """Three versions of a table: all trades, one day replaced, a slice of a venue replaced (all but that day); each in one step."""
    rows = G.partition_keys(clean(spark, d).select("event_id", "event_timestamp", "received_timestamp", "venue", "instrument", "price"), "venue").drop("hour")
    lakes = lake.AtomicTable(spark, f"{folder_of(spark)}/atomic-{uuid.uuid4().hex}", ["date", "venue"], ["instrument", "event_timestamp"])
    lakes.replace_partitions(rows)
    lakes.replace_partitions(lakes.read().where("date = '2024-01-06'").withColumn("price", F.col("price") + 1))
    inside = F.col("event_id").between(100, 5000) & (F.col("venue") == "view") & (F.col("date") != "2024-01-06")
    lakes.replace_slice(rows.where("event_id % 2 = 0").withColumn("price", F.col("price") * 2), inside)
    lakes.vacuum()
    return lakes.read().groupBy("venue", F.datediff(F.col("date").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))
