"""Streaming queries, run to their end over the given tables: files in, available now, rows out of a sink."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.operators import bars as B
from voltide.sources.adapters import later
from voltide.sources.shared import shuffle_partitions
from voltide.streaming import bars as S
from voltide.streaming import features as L
from voltide.streaming import pricing as T
from voltide.streaming.pricing import KNOTS as P_KNOTS

from .bars import clean
from .base import HOUR, TRADE_BARS, query


def folder(spark, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def trades_stream(spark, d) -> DataFrame:
    """The events as a stream of trades."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # a table is one file or a folder of files: both match the pattern below their folder
    e = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/events.parquet" if _is_folder(spark, f"{d}/events.parquet") else f"{d}/events*.parquet")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(F.col("ts").alias("event_timestamp"), later(F.col("ts"), F.col("event_id") % 7).alias("received_timestamp"), F.col("event_type").alias("venue"), F.col("event_id").cast("string").alias("trade_id"), "event_id",
                    (100 + F.col("value") / 10).alias("price"), (F.get_json_object("props", "$.k").cast("int") / 10.0).cast("double").alias("quantity"), F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("taker_side"))


def _is_folder(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def finished(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a streaming query puts out over what is available: append mode to Parquet, else the last batch's table."""
    spark, at = df.sparkSession, folder(df.sparkSession, name)
    out = f"{at}/out"
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    else:
        q = df.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


MIDDLE = 1704067200 + 15 * 86_400
ONE = "one AS (SELECT * FROM trades WHERE ingested_at = received_timestamp), last_hour AS (SELECT max(epoch_us(event_timestamp)) // 3600000000 * 3600 AS h FROM one)"


@query("stream_bars", f"""SELECT epoch_us(event_timestamp) // 3600000000 * 3600 AS bucket, venue, first(price ORDER BY event_timestamp) AS p_open, max(price) AS p_high, min(price) AS p_low, last(price ORDER BY event_timestamp) AS p_close,
  sum(quantity) AS v_trade, count(*) FILTER (quantity > 0) AS cnt_trade FROM one, last_hour WHERE epoch_us(event_timestamp) // 3600000000 * 3600 < h GROUP BY ALL""", ONE)
def stream_bars(spark, d):
    out = finished(S.stream_bars(trades_stream(spark, d), HOUR).drop("w"), "bars")
    return out.select(F.unix_seconds("bucket").alias("bucket"), "venue", "p_open", "p_high", "p_low", "p_close", "v_trade", "cnt_trade")


@query("stream_dedup", "SELECT event_id, price FROM one", ONE)
def stream_dedup(spark, d):
    return finished(S.stream_dedup(trades_stream(spark, d)), "dedup").select("event_id", "price")


@query("stream_spot", "SELECT venue, last(price ORDER BY event_timestamp) AS price FROM one GROUP BY venue", ONE)
def stream_spot(spark, d):
    return finished(S.stream_spot(trades_stream(spark, d)), "spot", "complete").select("venue", "price")


@query("forming_bar", "SELECT epoch_us(event_timestamp) // 3600000000 * 3600 AS bucket, first(price ORDER BY event_timestamp) AS p_open, max(price) AS p_high, min(price) AS p_low, last(price ORDER BY event_timestamp) AS p_close FROM one GROUP BY 1", ONE)
def forming_bar(spark, d):
    return finished(S.forming_bar(trades_stream(spark, d), HOUR), "forming", "complete").withColumn("bucket", F.unix_seconds("bucket"))


@query("archive_stream", "SELECT venue, count(*) AS n, sum(price) AS total FROM one GROUP BY venue", ONE)
def archive_stream(spark, d):
    at = folder(spark, "archive")
    S.archive_stream(trades_stream(spark, d), f"{at}/out", f"{at}/state", ["venue"], {"availableNow": True}).awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("venue").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))


@query("stale_entry_skip", f"SELECT count(*) AS n, min(event_id) AS first_id FROM one WHERE epoch_us(received_timestamp) >= {MIDDLE - 5}000000", ONE)
def stale_entry_skip(spark, d):
    """As a reader at a fixed moment would see the stream: entries that arrived more than 5 seconds before it are skipped."""
    kept = S.stale_entry_skip(trades_stream(spark, d), 5, F.timestamp_seconds(F.lit(MIDDLE)))
    return finished(kept.select("event_id"), "stale").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("coalesce_latest", "SELECT 'trade' AS kind, count(*) AS n, max(price) AS price FROM one UNION ALL SELECT 'book', count(*), sum(price) FROM (SELECT venue, arg_max(price, event_timestamp) AS price FROM one GROUP BY venue)", ONE)
def coalesce_latest(spark, d):
    """Every event is a trade and a book of its venue: a flush keeps all trades, and of each venue's books the last."""
    at = folder(spark, "latest")
    kinds = F.explode(F.array(F.lit("trade"), F.lit("book")))
    rows = trades_stream(spark, d).select(kinds.alias("kind"), "venue", "event_timestamp", "price")
    each = lambda batch, _: S.flush(batch, F.col("kind") == "trade", ["venue"], ["event_timestamp"]).write.mode("append").parquet(f"{at}/out")
    rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    # the last flush wins for books
    books = S.coalesce_latest(out.where("kind = 'book'"), ["venue"], ["event_timestamp"]).agg(F.lit("book").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"))
    return out.where("kind = 'trade'").agg(F.lit("trade").alias("kind"), F.count(F.lit(1)).alias("n"), F.max("price").alias("price")).unionByName(books)


#: Bars of two hours in every fifty, and the second venue by name of another hour, don't come.
LIVE = """sy AS (SELECT bucket, avg(p_trade_mean) AS p, count(*) AS n, sum(v_buy) AS vb FROM trade_bars WHERE bucket // 3600 % 50 NOT IN (7, 8) AND (bucket // 3600 % 50 <> 20 OR venue <> 'click') GROUP BY bucket),
sr AS (SELECT *, ln(p / lag(p) OVER (ORDER BY bucket)) AS r, CASE WHEN bucket - lag(bucket) OVER (ORDER BY bucket) = 3600 THEN ln(p / lag(p) OVER (ORDER BY bucket)) END AS r1, row_number() OVER (ORDER BY bucket) AS k FROM sy),
sv AS (WITH RECURSIVE v AS (SELECT k, NULL::DOUBLE AS before, NULL::DOUBLE AS after FROM sr WHERE k = 1
  UNION ALL SELECT sr.k, v.after, CASE WHEN v.after IS NULL THEN sr.r * sr.r ELSE 0.96::DOUBLE * v.after + 0.04::DOUBLE * sr.r * sr.r END FROM v JOIN sr ON sr.k = v.k + 1) SELECT k, before FROM v),
sh AS (SELECT *, ln(p / lag(p) OVER (ORDER BY bucket)) AS r, row_number() OVER (ORDER BY bucket) AS k FROM sy WHERE (bucket + 3600) % 14400 = 0),
hv AS (WITH RECURSIVE v AS (SELECT k, bucket, NULL::DOUBLE AS after FROM sh WHERE k = 1
  UNION ALL SELECT sh.k, sh.bucket, CASE WHEN v.after IS NULL THEN sh.r * sh.r ELSE 0.96::DOUBLE * v.after + 0.04::DOUBLE * sh.r * sh.r END FROM v JOIN sh ON sh.k = v.k + 1) SELECT bucket, after FROM v),
live AS (SELECT s.bucket, p AS synthetic_price, n AS venue_count, r AS log_return, before AS variance, hv.after AS variance_14400s, CASE WHEN count(r1) OVER w = 3 THEN sqrt(sum(r1 * r1) OVER w * 31536000 / 10800) END AS realized_vol_10800s,
  CASE WHEN count(*) OVER w = 3 THEN ln(1 + sum(vb) OVER w) END AS log_buy_volume_10800s, k = max(k) OVER () AS open FROM sr s JOIN sv USING (k) ASOF LEFT JOIN hv ON s.bucket > hv.bucket WINDOW w AS (ORDER BY s.bucket RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW))"""
LIVE_COLUMNS = ["bucket", "synthetic_price", "venue_count", "log_return", "variance", "variance_14400s", "realized_vol_10800s", "log_buy_volume_10800s"]


def live_bars(spark, d) -> DataFrame:
    t = clean(spark, d)
    hour = F.floor(F.unix_seconds("bucket") / HOUR) % 50
    bars = B.ohlc(t, HOUR).join(B.volume_by_side(t, HOUR), ["bucket", *B.KEYS]).where(~hour.isin(7, 8) & ((hour != 20) | (F.col("venue") != "click")))
    return bars.select(F.lit("SYN").alias("asset"), "venue", F.unix_seconds("bucket").alias("bucket"), F.col("p_trade_mean").alias("price"), "v_buy")


def _live(spark, at: str, schema, history=None) -> None:
    """One run of the live features over what lies in the input folder, from the state of the run before."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = L.stream_features(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/in"), HOUR, [3 * HOUR], [3 * HOUR], history=history, horizons=(4 * HOUR,))
        out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@query("stream_features", f"SELECT {', '.join(LIVE_COLUMNS)} FROM live WHERE NOT open AND realized_vol_10800s IS NOT NULL AND log_buy_volume_10800s IS NOT NULL", TRADE_BARS + "," + LIVE)
def stream_features(spark, d):
    """Two runs, the second from the first one's state; bars of completed buckets, sent again with other prices, change nothing."""
    at, bars = folder(spark, "live"), live_bars(spark, d)
    early = F.col("bucket") < MIDDLE
    bars.where(early).write.parquet(f"{at}/in/0")
    _live(spark, at, bars.schema)
    bars.where(~early).unionByName(bars.where(early & (F.col("bucket") < MIDDLE - HOUR)).withColumn("price", F.col("price") * 2)).write.parquet(f"{at}/in/1")
    _live(spark, at, bars.schema)
    return spark.read.parquet(f"{at}/out").select(*LIVE_COLUMNS)


@query("stream_candles", """SELECT bucket // 14400 * 14400 AS bucket, venue, arg_min(p_open, bucket) AS p_open, max(p_high) AS p_high, min(p_low) AS p_low, arg_max(p_close, bucket) AS p_close, sum(v_trade) AS v_trade
  FROM (SELECT epoch_us(event_timestamp) // 3600000000 * 3600 AS bucket, venue, first(price ORDER BY event_timestamp) AS p_open, max(price) AS p_high, min(price) AS p_low, last(price ORDER BY event_timestamp) AS p_close, sum(quantity) AS v_trade FROM one GROUP BY ALL), done
  WHERE bucket // 14400 * 14400 + 14400 <= until GROUP BY ALL""", ONE + ", done AS (SELECT (max(epoch_us(event_timestamp)) - 5000000) // 1000000 AS until FROM one)")
def stream_candles(spark, d):
    out = finished(S.stream_candles(S.stream_bars(trades_stream(spark, d), HOUR), 4 * HOUR), "candles")
    return out.withColumn("bucket", F.unix_seconds("bucket"))


LATE = f"""mark AS (SELECT max(epoch_us(event_timestamp)) - 5000000 AS us FROM one WHERE event_id % 2 = 0 AND epoch_us(event_timestamp) < {MIDDLE}000000),
seen AS (SELECT epoch_us(event_timestamp) // 3600000000 * 3600 AS bucket, venue, price FROM one, mark
  WHERE (event_id % 2 = 0 AND epoch_us(event_timestamp) < {MIDDLE}000000) OR (epoch_us(event_timestamp) // 3600000000 + 1) * 3600000000 > us)"""


@query("late_drop", "SELECT bucket, venue, count(*) AS n FROM seen, last_hour WHERE bucket < h GROUP BY ALL", ONE + "," + LATE)
def late_drop(spark, d):
    """Half of the earlier trades come too late: their buckets are final, so the watermark drops them."""
    from voltide.sources.adapters import trades

    rows = trades(spark, d).where("ingested_at = received_timestamp").select("event_timestamp", "received_timestamp", "venue", "trade_id", "event_id", "price", "quantity", "taker_side")
    even, early = F.col("event_id") % 2 == 0, F.unix_seconds("event_timestamp") < MIDDLE
    at = folder(spark, "late")
    for i, part in enumerate((rows.where(even & early), rows.where(~(even & early)))):
        part.write.parquet(f"{at}/in/{i}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{at}/in")
        marked = stream.withWatermark("event_timestamp", "5 seconds").groupBy(F.window("event_timestamp", f"{HOUR} seconds").alias("w"), "venue").agg(F.count(F.lit(1)).alias("n"))
        # a run for each part, from the state of the run before
        marked.select(F.unix_seconds("w.start").alias("bucket"), "venue", "n").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("warmup_replay", f"SELECT bucket, synthetic_price, log_return, realized_vol_10800s, log_buy_volume_10800s FROM live WHERE NOT open AND bucket >= {MIDDLE} AND realized_vol_10800s IS NOT NULL", TRADE_BARS + "," + LIVE)
def warmup_replay(spark, d):
    """A new stream whose state starts from the history that its windows need, equal to one that never stopped."""
    at, bars = folder(spark, "warm"), live_bars(spark, d)
    bars.where(F.col("bucket") >= MIDDLE).write.parquet(f"{at}/in/0")
    bars.where((F.col("bucket") < MIDDLE) & (F.col("bucket") >= MIDDLE - 48 * HOUR)).write.parquet(f"{at}/history")
    _live(spark, at, bars.schema, spark.read.parquet(f"{at}/history"))
    return spark.read.parquet(f"{at}/out").where(F.col("bucket") >= MIDDLE).select("bucket", "synthetic_price", "log_return", "realized_vol_10800s", "log_buy_volume_10800s")


ROLL = """ev AS (SELECT hour, hour // 3600 AS h, event_ticker FROM quotes GROUP BY ALL),
turn AS (SELECT min(hour) + 600 AS moment, event_ticker FROM ev WHERE h % 3 = 0 GROUP BY event_ticker),
msg AS (SELECT hour + 600 AS moment, event_ticker, h FROM ev UNION ALL SELECT hour + 900, lag(event_ticker) OVER (ORDER BY hour), h FROM ev WHERE h % 3 = 0)"""


ROLLED = """SELECT moment, event_ticker, coalesce(event_ticker = active, false) AS accepted, coalesce(active, '') AS active, coalesce(generation, 0) AS generation FROM (
  SELECT m.moment, m.event_ticker, t.event_ticker AS active, t.generation FROM (SELECT * FROM msg WHERE event_ticker IS NOT NULL) m ASOF LEFT JOIN (SELECT *, row_number() OVER (ORDER BY moment) AS generation FROM turn) t ON m.moment >= t.moment)"""


def stagings(spark, d) -> tuple[DataFrame, DataFrame]:
    """Every third event is staged and confirmed by its own first message; the others' messages are to be refused, and so are the old event's after the switch."""
    from pyspark.sql import Window

    from voltide.sources.adapters import quotes

    series = F.lit("SER").alias("series")
    ev = quotes(spark, d).select("hour", "event_ticker").distinct()
    third = ev.where(F.floor(F.col("hour") / HOUR) % 3 == 0)
    staged = third.select(series, "event_ticker", (F.col("hour") + 300).alias("at"))
    # staging again what is active changes nothing
    staged = staged.unionByName(third.select(series, "event_ticker", (F.col("hour") + 1200).alias("at")))
    before = third.withColumn("event_ticker", F.lag("event_ticker").over(Window.partitionBy(F.lit(1)).orderBy("hour"))).where("event_ticker IS NOT NULL")
    messages = ev.select(series, "event_ticker", (F.col("hour") + 600).alias("at")).unionByName(before.select(series, "event_ticker", (F.col("hour") + 900).alias("at")))
    return staged, messages


@query("event_rollover", ROLLED, ROLL)
def event_rollover(spark, d):
    from voltide.operators import pricing as P

    return P.rollover(*stagings(spark, d)).drop("series").withColumnRenamed("at", "moment")


#: Rows of a micro-batch where a stream's input comes in portions.
PORTION = 200_000


def in_portions(part: DataFrame, staged: str, order: str, portion: int) -> Iterator[DataFrame]:
    """A part in portions of about `portion` rows, one after the other in the order of a whole number; rows of one number stay
    together. `staged` is a folder for the rows sorted, so that a portion's rows lie together.
    """
    spark = part.sparkSession
    part.repartitionByRange(shuffle_partitions(spark), order).sortWithinPartitions(order).write.parquet(staged)
    rows = spark.read.schema(part.schema).parquet(staged)
    n = max(1, math.ceil(rows.count() / portion))
    bounds = sorted({int(b) for b in rows.approxQuantile(order, [k / n for k in range(1, n)], 0.1 / n)}) if n > 1 else []
    for k, (low, high) in enumerate(zip([None, *bounds], [*bounds, None])):
        above = F.lit(True) if low is None else F.col(order) >= low
        below = F.lit(True) if high is None else F.col(order) < high
        yield rows.where(above & below if k else below | F.col(order).isNull())


def in_runs(spark, name: str, parts: list[DataFrame], step, order: str | None = None, portion: int = PORTION) -> DataFrame:
    """What a streaming query puts out over several runs, each from the state of the one before, over a part of its input each.

    A run takes its part as one micro-batch, or with `order` (a column of whole numbers) in portions in that order, which
    bounds what a stateful step holds of a key at once. A portion is a file, and a stream takes the oldest files first; it
    runs while the next ones are written.
    """
    at = folder(spark, name)

    def started(part: DataFrame, **how):
        source = spark.readStream.schema(part.schema).option("recursiveFileLookup", "true")
        out = step((source.option("maxFilesPerTrigger", 1) if order else source).parquet(f"{at}/in"))
        return out.schema, out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(**how).start()

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i, part in enumerate(parts):
            if order is None:
                part.write.parquet(f"{at}/in/{i}")
                schema, run = started(part, availableNow=True)
                run.awaitTermination()
                continue
            run = None
            try:
                for k, rows in enumerate(in_portions(part, f"{at}/staged/{i}", order, portion)):
                    rows.coalesce(1).write.parquet(f"{at}/in/{i}/{k:06}")
                    if run is None:
                        schema, run = started(part, processingTime="0 seconds")
                    if not run.isActive:  # it failed, which the next line tells
                        break
                run.processAllAvailable()
            finally:
                if run is not None:
                    run.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(schema).parquet(f"{at}/out")


@query("stream_rollover", ROLLED, ROLL)
def stream_rollover(spark, d):
    """The same on a stream, in two runs."""
    staged, messages = stagings(spark, d)
    rows = staged.withColumn("kind", F.lit("staged")).unionByName(messages.withColumn("kind", F.lit("message")))
    out = in_runs(spark, "rollover", [rows.where(F.col("at") < MIDDLE), rows.where(F.col("at") >= MIDDLE)], T.stream_rollover, order="at")
    return out.select(F.col("at").alias("moment"), "event_ticker", "accepted", "active", "generation")


def _stream_books(spark, d):
    """The book of each venue after each message, in two runs of a stream whose micro-batches are bounded."""
    from voltide.operators import running_book as R

    from .book import book_messages

    messages = book_messages(spark, d, F.greatest(F.col("quantity") - 3, F.lit(0)))
    out = in_runs(spark, "books", [messages.where("event_id < 4000"), messages.where("event_id >= 4000")], lambda rows: R.stream_books(rows, ["venue"], "at", signed=False), order="at", portion=5 * PORTION)
    price = lambda side: F.get(side, F.lit(0))["price"].cast("double")
    return out.select("venue", "sequence", F.size("bid").alias("n_bids"), F.size("ask").alias("n_asks"), price("bid").alias("best_bid"), price("ask").alias("best_ask"), F.aggregate(F.concat("bid", "ask"), F.lit(0.0), lambda t, x: t + x["quantity"].cast("double")).alias("total"))


ARCHIVED = "['trade', 'book', 'contract_ticker', 'contract_trade', 'contract_book'][(event_id % 5) + 1]"


@query("archive_kinds", f"""SELECT CASE WHEN event_id % 97 = 0 THEN 'dead' ELSE {ARCHIVED} END AS kind, CASE WHEN event_id % 97 <> 0 THEN venue END AS part, CASE WHEN event_id % 97 <> 0 THEN epoch_us(event_timestamp) // 3600000000 % 24 END AS hour, count(*) AS n, sum(event_id)::BIGINT AS ids FROM one GROUP BY ALL""", ONE)
def archive_kinds(spark, d):
    """An archive of five kinds and of rows with an error, by the hour of the day, in two runs of a stream."""
    from voltide.sources.adapters import trades

    kinds, at = list(S.KINDS), folder(spark, "kinds")
    columns = {c for own, path in S.KINDS.values() for c in (*own, *path)} - {"event_id", "venue", "instrument", "series_ticker", "exchange_ts_ms", "received_ts_ms"}
    t = trades(spark, d).where("ingested_at = received_timestamp")
    rows = t.select(F.get(F.array(*map(F.lit, kinds)), (F.col("event_id") % 5).cast("int")).alias("kind"), F.when(F.col("event_id") % 97 == 0, "price").alias("error"), "event_id", "venue", "instrument", F.col("venue").alias("series_ticker"),
                    (F.unix_millis("event_timestamp") % 86_400_000).alias("exchange_ts_ms"), F.unix_millis("received_timestamp").alias("received_ts_ms"), *[F.lit("x").alias(c) for c in sorted(columns)])
    for i, part in enumerate((rows.where("event_id < 3000"), rows.where("event_id >= 3000"))):
        part.write.parquet(f"{at}/in/{i}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{at}/in")
        S.archive_kinds(stream, f"{at}/out", "events", f"{at}/state", {"availableNow": True}).awaitTermination()
    out = None
    for kind, (_, path) in (S.KINDS | {"dead": ((), ())}).items():
        part = spark.read.parquet(f"{at}/out/{kind}")
        name, hour = (F.col(path[0]), F.floor(F.col("exchange_ts_ms") / 3_600_000)) if path else (F.lit(None).cast("string"), F.lit(None).cast("long"))
        counts = part.groupBy(F.lit(kind).alias("kind"), name.alias("part"), hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
        out = counts if out is None else out.unionByName(counts)
    return out


CURVES = """curves AS (SELECT * FROM (VALUES (0, 0.3::DOUBLE, 0.35::DOUBLE, 0.5::DOUBLE, 0.45::DOUBLE), (1704067200 + 864000, 0.3, NULL, 0.5, 0.45), (1704067200 + 1728000, 0.6, 0.7, 0.8, 0.9)) c(feature_at, sigma_300, sigma_900, sigma_1800, sigma_3600))"""


def _stream_pricing(spark, d):
    """Each event a series: its tickers, spot and the curves of its time as a stream, in two runs; without a valid curve its
    prices are taken back: rows without a price, with the reason.
    """
    from voltide.operators import joins as J
    from voltide.sources.adapters import quotes

    from .book import metadata

    q = quotes(spark, d).withColumn("quoted_at", F.col("quoted_on") - F.when(F.col("j") % 4 == 0, 100).otherwise(10)).drop("strike", "expiry")
    tickers = J.with_metadata(q, metadata(spark, d)).select(F.col("event_ticker").alias("series"), F.lit("ticker").alias("kind"), F.col("quoted_on").alias("at"), "market_ticker", "event_ticker", "bid", "ask", "quoted_at", "strike", "expiry", "status")
    events = q.groupBy("event_ticker", "quoted_on").agg(F.max("spot").alias("spot"))
    spots = events.select(F.col("event_ticker").alias("series"), F.lit("spot").alias("kind"), F.col("quoted_on").alias("at"), "spot")
    rows = [(0, 0.3, 0.35, 0.5, 0.45), (1704067200 + 864_000, 0.3, None, 0.5, 0.45), (1704067200 + 1_728_000, 0.6, 0.7, 0.8, 0.9)]
    curves = spark.createDataFrame(rows, "feature_at long, sigma_300 double, sigma_900 double, sigma_1800 double, sigma_3600 double")
    known = events.join(F.broadcast(curves), F.col("feature_at") <= F.col("quoted_on"))  # three rows
    curves = known.select(F.col("event_ticker").alias("series"), F.lit("curve").alias("kind"), F.col("quoted_on").alias("at"), "feature_at", *P_KNOTS)
    stream = tickers.unionByName(spots, allowMissingColumns=True).unionByName(curves, allowMissingColumns=True)
    out = in_runs(spark, "pricing", [stream.where(F.col("at") < MIDDLE), stream.where(F.col("at") >= MIDDLE)], lambda rows: T.stream_pricing(rows, spot_age=None, curve_age=None))
    return out.select("market_ticker", "reason", "model", "edge")


def _register_pricing():
    from .book import META, cdf, interpolated

    year = 31_536_000
    priced = f"""pr AS (SELECT q.*, m.strike AS k, status, m.expiry - quoted_on AS tau FROM quotes q LEFT JOIN meta m USING (event_ticker, market_ticker)),
pc AS (SELECT pr.*, c.* EXCLUDE (feature_at) FROM pr ASOF LEFT JOIN curves c ON pr.quoted_on >= c.feature_at),
ps AS (SELECT *, {interpolated('tau')} AS sigma FROM pc),
pq AS (SELECT *, CASE WHEN k IS NULL THEN 'no_metadata' WHEN status <> 'active' THEN 'not_open' WHEN sigma_900 IS NULL THEN 'bad_curve' WHEN tau <= 0 THEN 'expired' WHEN sigma IS NULL THEN 'beyond_curve' END AS reason, ln(spot / k) / (sigma * sqrt(tau / {year})) AS x FROM ps),
priced AS (SELECT market_ticker, reason, CASE WHEN reason IS NULL THEN {cdf('x')} END AS model, bid, ask, j FROM pq)"""
    query("stream_pricing", "SELECT market_ticker, reason, model, CASE WHEN j % 4 <> 0 THEN model - (bid + ask) / 2 END AS edge FROM priced", META + "," + CURVES + "," + priced)(_stream_pricing)


_register_pricing()


def _register_books():
    from .book import BOOK_AFTER_MESSAGES

    query("stream_books", *BOOK_AFTER_MESSAGES)(_stream_books)


_register_books()
