"""Queries over raw frames: trades of eight venues, books of four, contract events; broken frames among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltide.operators import frames as R
from voltide.sources.adapters import book_levels, events, quotes

from .base import query

VENUES = tuple(R.TRADE_LAYOUTS)
LISTED = ", ".join(f"'{v}'" for v in VENUES)


def by_venue(of):
    out = F.lit(None).cast("string")
    for venue, raw in of.items():
        out = F.when(F.col("venue") == venue, raw).otherwise(out)
    return out


@query("normalize_trade_frames", f"""SELECT venue, CASE WHEN NOT cut THEN CASE venue WHEN 'bitstamp' THEN 'BTCUSD' ELSE 'SYN-USD' END END AS instrument, CASE WHEN NOT cut THEN event_id::VARCHAR END AS trade_id,
  CASE WHEN cut THEN NULL WHEN event_id % 37 = 0 THEN -1.0::DOUBLE ELSE value END AS price, CASE WHEN NOT cut THEN epoch_us(ts) // 1000 END AS exchange_ts_ms,
  CASE WHEN cut OR event_id % 31 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS taker_side,
  CASE WHEN cut THEN 'frame' WHEN event_id % 37 = 0 OR value < 0 THEN 'price' WHEN event_id % 31 = 0 THEN 'taker_side' END AS error
  FROM (SELECT *, [{LISTED}][event_id % 8 + 1] AS venue, event_id % 41 = 0 AS cut FROM events WHERE event_id % 43 <> 0)""")
def normalize_trade_frames(spark, d):
    e = events(spark, d).withColumn("venue", F.get(F.array(*map(F.lit, VENUES)), (F.col("event_id") % 8).cast("int")))
    us, buy, named = F.unix_micros("ts"), F.col("user_id") % 2 == 0, F.col("event_id") % 31 != 0
    e = e.withColumns({"p": F.when(F.col("event_id") % 37 == 0, "-1").otherwise(F.col("value").cast("string")), "q": F.get_json_object("props", "$.k"), "us": us, "i": F.lit("SYN-USD"),
                       "iso": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "side": F.when(~named, "x").when(buy, "buy").otherwise("sell"), "maker": F.when(named, ~buy), "code": F.when(~named, 7).when(buy, 0).otherwise(1)})
    ms, c = F.floor(F.col("us") / 1000), F.col
    fields = lambda **f: F.struct(*[x.alias(k) for k, x in f.items()])
    raw = by_venue({
        "binance": F.to_json(fields(stream=F.lit("syn@trade"), data=fields(s=c("i"), t=c("event_id"), p=c("p"), q=c("q"), T=ms, m=c("maker")))),
        "bitstamp": F.to_json(fields(event=F.lit("trade"), data=fields(id=c("event_id"), price_str=c("p"), amount=c("q"), microtimestamp=c("us").cast("string"), type=c("code")))),
        "bybit": F.to_json(fields(topic=F.lit("publicTrade.SYN"), data=F.array(fields(s=c("i"), i=c("event_id").cast("string"), p=c("p"), v=c("q"), T=ms, S=F.initcap("side"))))),
        "coinbase": F.to_json(fields(type=F.lit("match"), product_id=c("i"), trade_id=c("event_id"), price=c("p"), size=c("q"), time=c("iso"), side=F.upper("side"))),
        "crypto_com": F.to_json(fields(result=fields(channel=F.lit("trade.SYN-USD"), instrument_name=c("i"), data=F.array(fields(d=c("event_id").cast("string"), p=c("p"), q=c("q"), t=ms, s=F.upper("side")))))),
        "deribit": F.to_json(fields(method=F.lit("subscription"), params=fields(data=fields(instrument_name=c("i"), trade_id=c("event_id").cast("string"), price=c("p"), amount=c("q"), timestamp=ms, direction=c("side"))))),
        "gemini": F.to_json(fields(symbol=F.lower("i"), t=c("event_id"), p=c("p"), q=c("q"), E=c("us") * 1000, m=c("maker"))),
        "kraken": F.to_json(fields(channel=F.lit("trade"), data=F.array(fields(symbol=c("i"), trade_id=c("event_id"), price=c("p"), qty=c("q"), timestamp=c("iso"), side=c("side"))))),
    })
    raw = F.when(F.col("event_id") % 43 == 0, '{"type":"subscribed"}').when(F.col("event_id") % 41 == 0, '{"data": [').otherwise(raw)
    out = R.normalize_trade_frames(e.select("venue", ms.alias("received_ts_ms"), raw.alias("raw")))
    return out.select("venue", "instrument", "trade_id", F.col("price").cast("double").alias("price"), "exchange_ts_ms", "taker_side", "error")


BOOKS = ("binance", "bitstamp", "crypto_com", "gemini")


@query("normalize_book_frames", f"""SELECT venue, CASE WHEN NOT cut THEN event_id END AS sequence, CASE WHEN cut THEN 0 ELSE n END AS n_bids, CASE WHEN cut OR empty OR crossed THEN 0 ELSE n END AS n_asks,
  CASE WHEN NOT cut THEN bid END AS best_bid, CASE WHEN NOT (cut OR empty OR crossed) THEN ask END AS best_ask, CASE WHEN cut THEN 'frame' WHEN odd THEN 'levels' WHEN empty THEN 'sides' WHEN crossed THEN 'crossed' END AS error
  FROM (SELECT event_id, [{', '.join(f"'{v}'" for v in BOOKS)}][event_id // 2 % 4 + 1] AS venue, count(*) FILTER (side = 'bid')::INT AS n, max(price) FILTER (side = 'bid') AS bid, min(price) FILTER (side = 'ask') AS ask,
    event_id % 34 = 0 AS cut, event_id % 22 = 0 AS empty, event_id % 26 = 0 AS crossed, event_id % 38 = 0 AND event_id % 22 <> 0 AND event_id % 26 <> 0 AS odd FROM book_levels GROUP BY event_id)""")
def normalize_book_frames(spark, d):
    pair = F.struct("level", F.array(F.col("price").cast("string"), F.col("quantity").cast("string")).alias("l"))
    of = lambda side: F.transform(F.reverse(F.array_sort(F.collect_list(F.when(F.col("side") == side, pair)))), lambda x: x["l"])  # noqa: E731  worst first
    b = book_levels(spark, d).groupBy("event_id").agg(of("bid").alias("bids"), of("ask").alias("asks"))
    # a quantity that is no number, below 0, or not finite, in the last ask
    odd = F.get(F.array(*map(F.lit, ("x", "-1", "NaN"))), (F.col("event_id") % 3).cast("int"))
    b = b.withColumn("asks", F.when(F.col("event_id") % 38 == 0, F.concat(F.slice("asks", 2, 20), F.array(F.array(F.get(F.get("asks", F.lit(0)), F.lit(0)), odd)))).otherwise(F.col("asks")))
    b = b.withColumn("asks", F.when(F.col("event_id") % 22 == 0, F.array()).when(F.col("event_id") % 26 == 0, F.col("bids")).otherwise(F.col("asks")))
    b = b.withColumn("venue", F.get(F.array(*map(F.lit, BOOKS)), (F.floor(F.col("event_id") / 2) % 4).cast("int")))
    sides, i = [F.col("bids"), F.col("asks")], F.col("event_id")
    raw = by_venue({
        "binance": F.to_json(F.struct(F.lit("syn@depth20").alias("stream"), F.struct(i.alias("lastUpdateId"), *sides).alias("data"))),
        "bitstamp": F.to_json(F.struct(F.lit("data").alias("event"), F.struct(i.cast("string").alias("microtimestamp"), *sides).alias("data"))),
        "crypto_com": F.to_json(F.struct(F.struct(F.lit("book.SYN").alias("channel"), F.lit("SYN").alias("instrument_name"), F.array(F.struct(i.alias("u"), *sides)).alias("data")).alias("result"))),
        "gemini": F.to_json(F.struct(F.lit("syn").alias("s"), i.alias("lastUpdateId"), *sides)),
    })
    frames = b.select("venue", F.lit(1).alias("received_ts_ms"), F.when(i % 34 == 0, '{"data": {').otherwise(raw).alias("raw"))
    best = lambda side: F.get(side, F.lit(0))["price"].cast("double")
    return R.normalize_book_frames(frames).select("venue", "sequence", F.size("bids").alias("n_bids"), F.size("asks").alias("n_asks"), best("bids").alias("best_bid"), best("asks").alias("best_ask"), "error")


KIND = "['ticker', 'trade', 'orderbook_snapshot', 'orderbook_delta'][(j + 8) % 4 + 1]"


@query("normalize_contract_frames", f"""SELECT market_ticker, CASE kind WHEN 'ticker' THEN 'contract_ticker' WHEN 'trade' THEN 'contract_trade' WHEN 'orderbook_snapshot' THEN 'contract_book_snapshot' ELSE 'contract_book_delta' END AS event_type,
  market_ticker || ':' || CASE kind WHEN 'ticker' THEN 'ticker:' || left(sha256('market_ticker=' || market_ticker || CASE WHEN exact THEN '&ts_ms=' || quoted_on * 1000 + 5 ELSE '&ts=' || quoted_on END || '&yes_bid_dollars=' || cents), 16)
    WHEN 'trade' THEN 'trade:' || j ELSE 'book:' || (j + 8) END AS event_id,
  CASE WHEN kind = 'orderbook_snapshot' THEN NULL WHEN exact THEN quoted_on * 1000 + 5 ELSE quoted_on * 1000 END AS exchange_ts_ms,
  CASE WHEN kind = 'ticker' THEN cents::VARCHAR END AS yes_bid_dollars, CASE WHEN kind = 'trade' THEN 'yes' END AS taker_side, CASE WHEN kind = 'orderbook_snapshot' THEN 1 ELSE 0 END AS n_yes, 0 AS n_no, CASE WHEN kind = 'orderbook_delta' THEN 'no' END AS delta_side
  FROM (SELECT *, {KIND} AS kind, hour // 3600 % 2 = 0 AS exact, round(100 * bid)::BIGINT AS cents FROM quotes WHERE j <> 8)""")
def normalize_contract_frames(spark, d):
    exact, cents = F.floor(F.col("hour") / 3600) % 2 == 0, F.round(100 * F.col("bid")).cast("long").cast("string")
    kind = F.get(F.array(*map(F.lit, R.CONTRACT_KINDS)), ((F.col("j") + 8) % 4).cast("int"))
    q = quotes(spark, d).withColumn("kind", F.when(F.col("j") == 8, "subscribed").otherwise(kind))
    of = lambda name, x: F.when(F.col("kind") == name, x)
    msg = F.struct("market_ticker", of("ticker", cents).alias("yes_bid_dollars"), of("trade", F.col("j").cast("string")).alias("trade_id"), of("trade", F.lit("yes")).alias("taker_side"), of("orderbook_snapshot", F.array(F.array(F.lit("0.4"), F.lit("7")))).alias("yes_dollars_fp"),
                   of("orderbook_delta", F.lit("no")).alias("side"), F.when(exact, F.col("quoted_on") * 1000 + 5).alias("ts_ms"), F.when(~exact, F.col("quoted_on")).alias("ts"))
    frames = q.select(F.to_json(F.struct(F.col("kind").alias("type"), (F.col("j") + 8).alias("seq"), msg.alias("msg"))).alias("raw"), (F.col("quoted_on") * 1000 + 9).alias("received_ts_ms"))
    return R.normalize_contract_frames(frames).select("market_ticker", "event_type", "event_id", "exchange_ts_ms", "yes_bid_dollars", "taker_side", F.size("yes_bids").alias("n_yes"), F.size("no_bids").alias("n_no"), "delta_side")


@query("validate_contract_events", f"""SELECT market_ticker, CASE flaw WHEN 0 THEN 'schema_version' WHEN 1 THEN 'text' WHEN 2 THEN CASE kind WHEN 'ticker' THEN 'quote' END WHEN 3 THEN CASE kind WHEN 'trade' THEN 'taker_side' END
    WHEN 4 THEN CASE WHEN kind LIKE 'order%' THEN 'sequence' END WHEN 5 THEN CASE WHEN kind LIKE 'order%' THEN 'levels' END WHEN 6 THEN CASE WHEN kind LIKE 'order%' THEN 'delta_side' END WHEN 7 THEN 'received'
    WHEN 8 THEN CASE WHEN kind NOT LIKE 'order%' THEN 'timestamp' END WHEN 9 THEN CASE kind WHEN 'trade' THEN 'trade' END END AS error
  FROM (SELECT market_ticker, {KIND} AS kind, hour // 3600 % 11 AS flaw FROM quotes)""")
def validate_contract_events(spark, d):
    flaw = F.floor(F.col("hour") / 3600) % 11
    kind = F.get(F.array(*map(F.lit, R.CONTRACT_KINDS.values())), ((F.col("j") + 8) % 4).cast("int"))
    but = lambda k, bad, good: F.when(flaw == k, bad).otherwise(good)
    text = F.lit(None).cast("string")
    rows = quotes(spark, d).select(
        kind.alias("event_type"), but(0, F.lit(2), F.lit(1)).alias("schema_version"), F.col("market_ticker").alias("event_id"), F.lit("SYN").alias("instrument"), but(1, F.lit(" "), F.lit("SER")).alias("series_ticker"), "event_ticker", "market_ticker",
        but(2, F.lit(""), F.lit("0.5")).alias("yes_bid_dollars"), text.alias("yes_ask_dollars"), text.alias("last_price_dollars"), text.alias("volume"), text.alias("open_interest"), F.lit("t").alias("trade_id"), but(9, F.lit(" "), F.lit("0.5")).alias("yes_price_dollars"), F.lit("1").alias("count"),
        but(3, F.lit("maybe"), F.lit("yes")).alias("taker_side"), but(4, F.lit(-1), F.lit(1)).alias("sequence"), but(5, F.array(F.array(F.lit("x"), F.lit("1"))), F.array(F.array(F.lit("0.4"), F.lit("1")))).alias("yes_bids"), F.array().cast("array<array<string>>").alias("no_bids"),
        text.alias("delta_price_dollars"), text.alias("delta_fp"), but(6, F.lit("up"), text).alias("delta_side"), but(8, F.lit(None), F.lit(5)).cast("long").alias("exchange_ts_ms"), but(7, F.lit(0), F.lit(6)).cast("long").alias("received_ts_ms"))
    return R.validate_contract_events(rows).select("market_ticker", "error")
