"""Raw message frames (venue, received_ts_ms, raw JSON) to canonical trades, books and contract events, as columns.

A frame that can't be read, or that a rule refuses, comes out as one row with `error`; frames of other kinds leave none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import first_error, number_bad, text_missing

DEPTH = 15


@dataclass(frozen=True)
class Layout:
    """Where a venue's frame has its trades or book. Names of a field are tried in order; `at` is (name, kind of time)."""

    kind: str  # SQL over `raw` that tells the venue's frames of this sort from its others
    body: str | None  # JSON path of the trades or the book; None: the frame itself
    instrument: tuple[str, ...] = ()
    id: tuple[str, ...] = ()
    price: tuple[str, ...] = ()
    quantity: tuple[str, ...] = ()
    at: tuple[tuple[str, str], ...] = ()
    side: tuple[str, dict] = ("", {})
    outer_instrument: str | None = None  # JSON path in the frame, where items don't name theirs
    fixed_instrument: str | None = None


TEXT_SIDE = {"buy": "buy", "sell": "sell"}
MAKER_BUYS = {"true": "sell", "false": "buy"}

# Field names of the venues' public message formats.
TRADE_LAYOUTS = {
    "binance": Layout("get_json_object(raw, '$.stream') LIKE '%@trade'", "$.data", ("s",), ("t",), ("p",), ("q",), (("T", "ms"),), ("m", MAKER_BUYS)),
    "bitstamp": Layout("get_json_object(raw, '$.event') = 'trade'", "$.data", (), ("id",), ("price_str", "price"), ("amount_str", "amount"), (("microtimestamp", "us"), ("timestamp", "s")), ("type", {"0": "buy", "1": "sell"}), fixed_instrument="BTCUSD"),
    "bybit": Layout("get_json_object(raw, '$.topic') LIKE 'publicTrade.%'", "$.data", ("s",), ("i",), ("p",), ("v",), (("T", "ms"),), ("S", TEXT_SIDE)),
    "coinbase": Layout("get_json_object(raw, '$.type') IN ('match', 'last_match')", None, ("product_id",), ("trade_id",), ("price",), ("size",), (("time", "iso"),), ("side", TEXT_SIDE)),
    "crypto_com": Layout("get_json_object(raw, '$.result.channel') LIKE 'trade%'", "$.result.data", (), ("d",), ("p",), ("q",), (("t", "ms"),), ("s", TEXT_SIDE), outer_instrument="$.result.instrument_name"),
    "deribit": Layout("get_json_object(raw, '$.method') = 'subscription'", "$.params.data", ("instrument_name",), ("trade_id",), ("price",), ("amount",), (("timestamp", "ms"),), ("direction", TEXT_SIDE)),
    "gemini": Layout("get_json_object(raw, '$.t') IS NOT NULL", None, ("symbol", "s"), ("t",), ("p",), ("q",), (("E", "ns"),), ("m", MAKER_BUYS)),
    "kraken": Layout("get_json_object(raw, '$.channel') = 'trade'", "$.data", ("symbol",), ("trade_id",), ("price",), ("qty",), (("timestamp", "iso"),), ("side", TEXT_SIDE)),
}
BOOK_LAYOUTS = {
    "binance": Layout("get_json_object(raw, '$.stream') LIKE '%@depth%'", "$.data", id=("lastUpdateId",)),
    "bitstamp": Layout("get_json_object(raw, '$.event') = 'data'", "$.data", id=("microtimestamp", "timestamp"), fixed_instrument="BTCUSD"),
    "crypto_com": Layout("get_json_object(raw, '$.result.channel') LIKE 'book%'", "$.result.data[0]", id=("u",), outer_instrument="$.result.instrument_name"),
    "gemini": Layout("get_json_object(raw, '$.lastUpdateId') IS NOT NULL", None, ("symbol", "s"), ("lastUpdateId",)),
}


def _known(values: dict) -> Column:
    """What a map of literals has for the row's venue."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("venue")) if values else F.lit(None).cast("string")


def _items(frames: DataFrame, layouts: dict[str, Layout]) -> DataFrame:
    """A row for each item of the frames of the layouts' sort, x: its fields as text; x is null where the JSON can't be read."""
    ours = frames.where(F.col("venue").isin(list(layouts))).withColumn("__unread", F.expr("try_parse_json(raw) IS NULL"))
    kind, body = F.lit(False), F.col("raw")
    for venue, k in layouts.items():
        kind = kind | ((F.col("venue") == venue) & F.coalesce(F.expr(k.kind), F.lit(False)))
        if k.body:
            body = F.when(F.col("venue") == venue, F.get_json_object("raw", k.body)).otherwise(body)
    ours = ours.where(F.col("__unread") | kind).withColumn("__body", F.when(~F.col("__unread"), body))
    listed = F.when(F.col("__body").startswith("["), F.col("__body")).otherwise(F.concat(F.lit("["), F.col("__body"), F.lit("]")))
    items = F.coalesce(F.from_json(listed, "array<map<string,string>>"), F.array(F.lit(None).cast("map<string,string>")))
    return ours.withColumn("x", F.explode(items)).drop("__body")


def _field(name: str | Column) -> Column:
    return F.nullif(F.try_element_at("x", F.lit(name) if isinstance(name, str) else name), F.lit(""))


def _named(layouts: dict[str, Layout], part: str) -> Column:
    """The text of a part (price, id and so on), under the first of the venue's names for it that has one."""
    names = {v: getattr(k, part) for v, k in layouts.items() if getattr(k, part)}
    found = [_field(_known({v: n[i] for v, n in names.items() if len(n) > i})) for i in range(max(map(len, names.values())))]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def _instruments(layouts: dict[str, Layout]) -> Column:
    fixed = _known({v: k.fixed_instrument for v, k in layouts.items() if k.fixed_instrument})
    outer = F.lit(None).cast("string")
    for venue, k in layouts.items():
        if k.outer_instrument:
            outer = F.when(F.col("venue") == venue, F.get_json_object("raw", k.outer_instrument)).otherwise(outer)
    return F.upper(F.coalesce(F.when(F.col("x").isNotNull(), fixed), outer, _named(layouts, "instrument")))


def _millis(i: int) -> Column:
    """Epoch milliseconds of the venue's i-th name of a time."""
    at = {v: k.at[i] for v, k in TRADE_LAYOUTS.items() if len(k.at) > i}
    text, kind = _field(_known({v: n for v, (n, _) in at.items()})), _known({v: unit for v, (_, unit) in at.items()})
    scale = F.try_element_at(F.create_map(*[F.lit(x) for x in ("s", 1e3, "ms", 1.0, "us", 1e-3, "ns", 1e-6)]), kind)
    return F.when(kind == "iso", F.unix_millis(F.try_to_timestamp(text))).otherwise(F.floor(text.try_cast("decimal(38,9)") * scale.cast("decimal(18,9)")).cast("long"))


def normalize_trade_frames(frames: DataFrame) -> DataFrame:
    """event_id, venue, instrument, trade_id, price, quantity, taker_side, exchange_ts_ms, received_ts_ms, error."""
    x = _items(frames, TRADE_LAYOUTS)
    code = F.concat_ws(":", "venue", F.lower(_field(_known({v: k.side[0] for v, k in TRADE_LAYOUTS.items()}))))
    sides = F.create_map(*[F.lit(t) for v, k in TRADE_LAYOUTS.items() for given, side in k.side[1].items() for t in (f"{v}:{given}", side)])
    out = x.select(
        "venue", _instruments(TRADE_LAYOUTS).alias("instrument"), _named(TRADE_LAYOUTS, "id").alias("trade_id"), _named(TRADE_LAYOUTS, "price").alias("price"), _named(TRADE_LAYOUTS, "quantity").alias("quantity"),
        F.try_element_at(sides, code).alias("taker_side"), F.coalesce(_millis(0), _millis(1)).alias("exchange_ts_ms"), "received_ts_ms", F.col("x").isNull().alias("__unread"))
    out = out.withColumn("error", first_error(("frame", F.col("__unread")), ("instrument", text_missing("instrument")), ("trade_id", text_missing("trade_id")), ("price", number_bad("price")), ("quantity", number_bad("quantity")), ("timestamp", F.coalesce(F.col("exchange_ts_ms") <= 0, F.lit(True))), ("taker_side", F.col("taker_side").isNull())))
    return out.select(F.concat_ws(":", "venue", "instrument", F.lit("trade"), "trade_id").alias("event_id"), "venue", "instrument", "trade_id", "price", "quantity", "taker_side", "exchange_ts_ms", "received_ts_ms", "error")


LEVELS = "array<array<string>>"


def _levels(side: str, best_is_high: bool) -> Column:
    """A side's levels as structs of text, best first, DEPTH of them."""
    level = lambda p: F.struct(F.get(p, F.lit(0)).alias("price"), F.get(p, F.lit(1)).alias("quantity"))
    keyed = F.transform(F.from_json(_field(side), LEVELS), lambda p: F.struct((-1 if best_is_high else 1) * F.get(p, F.lit(0)).try_cast("double"), level(p).alias("level")))
    return F.coalesce(F.transform(F.slice(F.array_sort(keyed), 1, DEPTH), lambda p: p["level"]), F.array())


def _bad_levels(side: str) -> Column:
    """Whether a side has a level that isn't a pair of finite numbers, price and quantity, neither below 0."""
    number = lambda p, i: F.get(p, F.lit(i)).try_cast("double")
    fine = lambda x: (x >= 0) & ~F.isnan(x) & (x < float("inf"))
    bad = F.exists(F.from_json(_field(side), LEVELS), lambda p: ~F.coalesce(fine(number(p, 0)) & fine(number(p, 1)), F.lit(False)))
    return F.coalesce(bad, F.lit(False))


def normalize_book_frames(frames: DataFrame) -> DataFrame:
    """event_id, venue, instrument, sequence, bids, asks (arrays of price, quantity, best first), depth, received_ts_ms, error.

    Asks at or below the best bid go; a book that has none left, or lacks a side, is refused, and so is one with a level
    that isn't a pair of finite numbers of at least 0 (error levels).
    """
    x = _items(frames, BOOK_LAYOUTS)
    stream = F.upper(F.split_part(F.get_json_object("raw", "$.stream"), F.lit("@"), F.lit(1)))
    out = x.select("venue", F.when(F.col("venue") == "binance", stream).otherwise(_instruments(BOOK_LAYOUTS)).alias("instrument"), _named(BOOK_LAYOUTS, "id").try_cast("long").alias("sequence"), _levels("bids", True).alias("bids"), _levels("asks", False).alias("asks"), "received_ts_ms", F.col("x").isNull().alias("__unread"), (_bad_levels("bids") | _bad_levels("asks")).alias("__bad"))
    best = F.get("bids", F.lit(0))["price"].try_cast("double")
    out = out.withColumn("__sides", (F.size("bids") > 0) & (F.size("asks") > 0)).withColumn("asks", F.filter("asks", lambda a: F.coalesce(a["price"].try_cast("double") > best, F.lit(True))))
    out = out.withColumn("error", first_error(("frame", F.col("__unread")), ("sequence", F.col("sequence").isNull()), ("levels", F.col("__bad")), ("sides", ~F.col("__sides")), ("crossed", F.size("asks") == 0)))
    return out.select(F.concat_ws(":", "venue", "instrument", F.lit("book"), "sequence").alias("event_id"), "venue", "instrument", "sequence", "bids", "asks", F.greatest(F.size("bids"), F.size("asks")).alias("depth"), "received_ts_ms", "error")


#: Kinds of contract events by the frame's type.
CONTRACT_KINDS = {"ticker": "contract_ticker", "trade": "contract_trade", "orderbook_snapshot": "contract_book_snapshot", "orderbook_delta": "contract_book_delta"}


def normalize_contract_frames(frames: DataFrame) -> DataFrame:
    """Frames (received_ts_ms, raw with type, seq and msg) to one wide row an event; other types leave none.

    Times: ts_ms, else ts in seconds, else the arrival. An omitted book side is empty. A ticker has no id of its own: the
    digest of its fields, sorted by name, is one.
    """
    kind = F.get_json_object("raw", "$.type")
    rows = frames.where(kind.isin(list(CONTRACT_KINDS))).withColumns({"__type": kind, "sequence": F.coalesce(F.get_json_object("raw", "$.seq").try_cast("long"), F.lit(0).cast("long")), "x": F.from_json(F.get_json_object("raw", "$.msg"), "map<string,string>")})
    is_ = lambda name: F.col("__type") == name
    own = F.array_join(F.array_sort(F.transform(F.map_entries("x"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "&")
    event_type = F.lit(None)
    for name, event in CONTRACT_KINDS.items():
        event_type = F.when(is_(name), event).otherwise(event_type)
    at = F.coalesce(_field("ts_ms").try_cast("long"), (_field("ts").try_cast("long") * 1000), F.col("received_ts_ms"))
    ident = F.when(is_("ticker"), F.concat(F.lit("ticker:"), F.substring(F.sha2(own, 256), 1, 16))).when(is_("trade"), F.concat(F.lit("trade:"), _field("trade_id"))).otherwise(F.concat(F.lit("book:"), F.col("sequence")))
    side = lambda name: F.when(is_("orderbook_snapshot"), F.coalesce(F.from_json(_field(name), LEVELS), F.array())).otherwise(F.array())
    return rows.select(
        F.concat_ws(":", _field("market_ticker"), ident).alias("event_id"), event_type.alias("event_type"), _field("market_ticker").alias("market_ticker"), "sequence",
        _field("yes_bid_dollars").alias("yes_bid_dollars"), _field("yes_ask_dollars").alias("yes_ask_dollars"), F.when(is_("ticker"), _field("price_dollars")).alias("last_price_dollars"), _field("volume_fp").alias("volume"), _field("open_interest_fp").alias("open_interest"),
        _field("trade_id").alias("trade_id"), _field("yes_price_dollars").alias("yes_price_dollars"), _field("count_fp").alias("count"), _field("taker_side").alias("taker_side"),
        side("yes_dollars_fp").alias("yes_bids"), side("no_dollars_fp").alias("no_bids"), F.when(is_("orderbook_delta"), _field("price_dollars")).alias("delta_price_dollars"), _field("delta_fp").alias("delta_fp"), F.when(is_("orderbook_delta"), _field("side")).alias("delta_side"),
        F.when(~is_("orderbook_snapshot"), at).alias("exchange_ts_ms"), "received_ts_ms")


def validate_contract_events(events: DataFrame) -> DataFrame:
    """Adds error: the first rule that a contract event of its kind breaks, over all of the kind's fields.

    Texts of quotes may be missing but not blank; of a trade all are needed; a book's levels are pairs of numbers, a
    delta names side, price and change; a snapshot's own time may be missing.
    """
    kind = F.col("event_type")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(False))  # noqa: E731  given, but empty
    bad_time = lambda c: F.coalesce(F.col(c) <= 0, F.lit(True))
    is_book = kind.isin("contract_book_snapshot", "contract_book_delta")
    bad_pairs = lambda c: F.coalesce(F.exists(c, lambda p: (F.size(p) != 2) | F.get(p, F.lit(0)).try_cast("double").isNull() | F.get(p, F.lit(1)).try_cast("double").isNull()), F.lit(True))
    return events.withColumn("error", first_error(
        ("event_type", F.coalesce(~kind.isin(list(CONTRACT_KINDS.values())), F.lit(True))),
        ("schema_version", F.coalesce(F.col("schema_version") != 1, F.lit(True))),
        ("text", text_missing("event_id", "instrument", "series_ticker", "event_ticker", "market_ticker")),
        ("quote", (kind == "contract_ticker") & (blank("yes_bid_dollars") | blank("yes_ask_dollars") | blank("last_price_dollars") | blank("volume") | blank("open_interest"))),
        ("trade", (kind == "contract_trade") & text_missing("trade_id", "yes_price_dollars", "count")),
        ("taker_side", (kind == "contract_trade") & ~F.coalesce(F.col("taker_side").isin("yes", "no"), F.lit(False))),
        ("sequence", is_book & F.coalesce(F.col("sequence") < 0, F.lit(True))),
        ("levels", is_book & (bad_pairs("yes_bids") | bad_pairs("no_bids"))),
        ("delta", is_book & (blank("delta_price_dollars") | blank("delta_fp"))),
        ("delta_side", is_book & F.col("delta_side").isNotNull() & ~F.col("delta_side").isin("yes", "no")),
        ("received", bad_time("received_ts_ms")),
        ("timestamp", F.when(is_book & F.col("exchange_ts_ms").isNull(), False).otherwise(bad_time("exchange_ts_ms"))),
    ))
