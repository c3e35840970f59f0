"""Above-strike contracts: curves, probabilities, edges, implied volatility, monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltide.functions.columns import YEAR_SECONDS, normal_cdf

from .joins import asof
from .timeseries import previous

HORIZONS = (300, 900, 1800, 3600)
#: Seconds of tickers that one task joins with their curves.
CURVE_CHUNK = 300


def valid_curve(curve: DataFrame) -> DataFrame:
    """curve: one column sigma_<h> a horizon; adds valid: all are finite and above 0."""
    ok = F.lit(True)
    for h in HORIZONS:
        x = F.col(f"sigma_{h}")
        ok = ok & F.coalesce((x > 0) & (x < float("inf")) & ~F.isnan(x), F.lit(False))
    return curve.withColumn("valid", ok)


def interpolate_vol(tau: Column) -> Column:
    """Flat up to the first knot, linear in volatility between knots, null beyond the last or at no time left."""
    out = F.when((tau > 0) & (tau <= HORIZONS[0]), F.col(f"sigma_{HORIZONS[0]}"))
    for a, b in zip(HORIZONS, HORIZONS[1:]):
        x, y = F.col(f"sigma_{a}"), F.col(f"sigma_{b}")
        out = out.when((tau > a) & (tau <= b), x + (y - x) * (tau - a) / (b - a))
    return out


def deviation(sigma: Column, tau: Column) -> Column:
    return sigma * F.sqrt(tau / YEAR_SECONDS)


def above_strike(spot: Column, strike: Column, v: Column) -> Column:
    """Chance of ending above the strike without drift, from the deviation v."""
    return normal_cdf(F.log(spot / strike) / v)


def black_digital(spot: Column, strike: Column, v: Column) -> Column:
    return normal_cdf(F.log(spot / strike) / v - v / 2)


def with_edges(quotes: DataFrame, model: str = "model") -> DataFrame:
    """mid, model - mid, model - ask, bid - model; all null where the quote is crossed or out of range."""
    fine = (F.col("bid") >= 0) & (F.col("ask") <= 1) & (F.col("bid") <= F.col("ask"))
    mid = (F.col("bid") + F.col("ask")) / 2
    return quotes.withColumns({n: F.when(fine, e) for n, e in (("mid", mid), ("edge", F.col(model) - mid), ("buy_edge", F.col(model) - F.col("ask")), ("sell_edge", F.col("bid") - F.col(model)))})


def implied_vol(quotes: DataFrame, keys: list[str], rounds: int = 6, least: int = 5, nearest: int = 7) -> DataFrame:
    """The volatility whose digital prices fit the nearest quotes best, by weighted Huber loss.

    quotes: keys, spot, strike, bid, ask, open_interest, tau. A grid of 161 points, then 41 points between its
    neighbours, again and again. A group has at most `nearest` quotes, so all rounds are one expression over its row.
    """
    mid = (F.col("bid") + F.col("ask")) / 2
    good = quotes.where("bid > 0 AND bid <= ask AND ask < 1").withColumn("mid", mid).where("mid BETWEEN 0.01 AND 0.99")
    near = Window.partitionBy(*keys).orderBy(F.abs(F.log(F.col("spot") / F.col("strike"))), "strike")
    good = good.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= nearest)
    group = Window.partitionBy(*keys)
    good = good.withColumns({"n": F.count(F.lit(1)).over(group), "w": (F.col("open_interest") + 1) / F.sum(F.col("open_interest") + 1).over(group)}).where(F.col("n") >= least)
    packed = good.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "mid", "w", F.log(F.col("spot") / F.col("strike")).alias("m"), F.sqrt(F.col("tau") / YEAR_SECONDS).alias("s")))).alias("quotes"))

    def loss(sigma: Column) -> Column:
        misses = F.transform(F.transform("quotes", lambda q: F.struct((q["m"] / (sigma * q["s"]) - sigma * q["s"] / 2).alias("x"), q["mid"].alias("mid"), q["w"].alias("w"))), lambda r: F.struct(F.abs(normal_cdf(r["x"]) - r["mid"]).alias("e"), r["w"].alias("w")))
        return F.aggregate(misses, F.lit(0.0), lambda total, r: total + r["w"] * F.when(r["e"] <= 0.02, 0.5 * r["e"] * r["e"]).otherwise(0.02 * (r["e"] - 0.01)))

    def closer(s: Column, points: Column) -> Column:
        step = (s["high"] - s["low"]) / (points - 1)
        tried = F.transform(F.transform(F.sequence(F.lit(0), points - 1), lambda i: s["low"] + i * step), lambda sigma, i: F.struct(loss(sigma).alias("loss"), i.alias("i"), sigma.alias("sigma")))
        best = F.transform(F.array(F.array_min(tried)), lambda b: F.struct(F.greatest(F.lit(0.01), b["sigma"] - step).alias("low"), F.least(F.lit(5.0), b["sigma"] + step).alias("high"), b["sigma"].alias("sigma")))
        return F.get(best, F.lit(0))

    start = F.struct(F.lit(0.01).alias("low"), F.lit(5.0).alias("high"), F.lit(None).cast("double").alias("sigma"))
    found = F.aggregate(F.array(F.lit(161), *[F.lit(41)] * (rounds - 1)), start, closer, lambda s: s["sigma"])
    return packed.select(*keys, found.alias("sigma"), F.size("quotes").alias("n_quotes"))


def atm_window(quotes: DataFrame, keys: list[str], each_side: int = 6) -> DataFrame:
    """Strikes up to `each_side` places from the one nearest to spot, or, without spot, from the mid nearest to a half."""
    w = Window.partitionBy(*keys)
    far = F.coalesce(F.abs(F.col("strike") - F.col("spot")), F.abs((F.col("bid") + F.col("ask")) / 2 - 0.5))
    ranked = quotes.withColumn("rank", F.row_number().over(w.orderBy("strike"))).withColumn("far", far)
    return ranked.withColumn("atm", F.min_by("rank", F.struct("far", "rank")).over(w)).where(F.abs(F.col("rank") - F.col("atm")) <= each_side).drop("far")


def price_contracts(tickers: DataFrame, metadata: DataFrame, curve: DataFrame, now: Column, stale: int = 60) -> DataFrame:
    """One row a contract: probability and edges, or one reason why not. A stale quote is priced without edges.

    tickers: event_ticker, market_ticker, bid, ask, quoted_at, spot; metadata: event_ticker, market_ticker, strike, expiry, status.
    curve: one row, or a row for each `feature_at` (epoch seconds), of which the last one at or before now counts. Several
    rows without times are an error.
    """
    rows = tickers.join(metadata, ["event_ticker", "market_ticker"], "left").withColumn("__now", now)
    knots = valid_curve(curve)
    if "feature_at" in curve.columns:
        names = [c for c in knots.columns if c != "feature_at"]
        rows = asof(rows, knots.withColumn("__now", F.col("feature_at")), [], "__now", names, chunk=CURVE_CHUNK).drop("matched_at")
    else:
        one = knots.agg(*[F.any_value(c).alias(c) for c in knots.columns], F.count(F.lit(1)).alias("__n"))
        rows = rows.join(F.broadcast(one)).where(F.when(F.col("__n") > 1, F.raise_error(F.lit("the curve has several rows without feature_at"))).otherwise(F.lit("")).isNotNull()).drop("__n")
    return priced(rows, stale)


def priced(rows: DataFrame, stale: int, failure: Column | None = None) -> DataFrame:
    """Adds tau, sigma, reason, model, mid and edges to rows that hold a contract's quote, its metadata, spot and curve at
    `__now`, which goes. failure: why spot or curve can't be used, where that is told already.
    """
    rows = rows if "valid" in rows.columns else valid_curve(rows)
    tau = F.col("expiry") - F.col("__now")
    rows = rows.withColumn("tau", tau).withColumn("sigma", interpolate_vol(F.col("tau")))
    reason = F.when(F.col("strike").isNull(), "no_metadata").when(~F.col("status").isin("open", "active"), "not_open")
    reason = reason.when(failure.isNotNull(), failure) if failure is not None else reason.when(F.col("spot").isNull(), "no_spot").when(~F.col("valid"), "bad_curve")
    reason = reason.when(F.col("tau") <= 0, "expired").when(F.col("sigma").isNull(), "beyond_curve")
    rows = rows.withColumn("reason", reason)
    rows = rows.withColumn("model", F.when(F.col("reason").isNull(), above_strike(F.col("spot"), F.col("strike"), deviation(F.col("sigma"), F.col("tau")))))
    rows = with_edges(rows)
    late = F.col("__now") - F.col("quoted_at") > stale
    return rows.withColumns({c: F.when(~late, F.col(c)) for c in ("edge", "buy_edge", "sell_edge")}).drop("__now")


def expire_contracts(contracts: DataFrame, events: DataFrame, now: Column | int) -> DataFrame:
    """Adds reason: expired (the expiry is `now` or before), unknown_event (events are known, and this one is not among
    them), or null for contracts that stay. Without any known event none is unknown.
    """
    known = events.select("event_ticker").distinct().withColumn("__known", F.lit(True))
    some = known.agg((F.count(F.lit(1)) > 0).alias("__some"))  # one row
    rows = contracts.join(known, "event_ticker", "left").join(F.broadcast(some))
    reason = F.when(F.col("expiry") <= now, "expired").when(F.col("__some") & F.col("__known").isNull(), "unknown_event")
    return rows.select(*contracts.columns, reason.alias("reason"))


def last_distinct_trade(rows: DataFrame, key: str, at: str, fingerprint: list[str]) -> DataFrame:
    """Since when the newest fingerprint has stood unchanged; `at` in microseconds."""
    before = previous(rows, at, [key], {f"__was_{c}": F.col(c) for c in fingerprint} | {"__was": F.lit(True)}, unit=1_000_000)
    same = F.col("__was").isNotNull()
    for c in fingerprint:
        same = same & F.col(c).eqNullSafe(F.col(f"__was_{c}"))
    return before.where(~same).groupBy(key).agg(F.max(at).alias("since"))


def contract_monitor(tickers: DataFrame, trades: DataFrame, books: DataFrame, now_ms: int, most_ms: int = 300_000) -> DataFrame:
    """A row a market of the active event, from what arrived in the last `most_ms` milliseconds.

    The active event is that of the newest arrival. Prices are cents; the last trade is the newest, and stands since its
    price, quantity and side were first seen in a row; activity is counted from that, or without a trade from the newest
    quote or book. Columns beside the market: strike (from its name), bid, ask, spread, last, volume, open_interest,
    last_trade, last_trade_qty, last_trade_side, activity_ms, has_trade, place (by strike, those without last).
    """
    fresh = lambda df: df.where(F.col("received_ts_ms").isNotNull() & (now_ms - F.col("received_ts_ms") <= most_ms) & (F.coalesce("market_ticker", F.lit("")) != ""))
    tickers, trades, books = fresh(tickers), fresh(trades), fresh(books)
    arrivals = [df.select("event_ticker", "received_ts_ms") for df in (tickers, trades, books)]
    active = arrivals[0].unionByName(arrivals[1]).unionByName(arrivals[2]).agg(F.max_by("event_ticker", "received_ts_ms").alias("event_ticker"))
    ours = lambda df: df.join(F.broadcast(active), "event_ticker", "left_semi")  # noqa: E731  one row
    newest = ours(tickers).groupBy("event_ticker", "market_ticker").agg(F.max_by(F.struct("yes_bid_dollars", "yes_ask_dollars", "last_price_dollars", "volume", "open_interest", "received_ts_ms"), "received_ts_ms").alias("t"))
    whole = ours(trades).where("yes_price_dollars IS NOT NULL AND count IS NOT NULL AND taker_side IS NOT NULL")
    mark = F.struct("yes_price_dollars", "count", "taker_side")
    begins = previous(whole, "received_ts_ms", ["market_ticker"], {"__was": mark}, unit=1000)
    last = begins.where(F.coalesce(F.col("__was") != mark, F.lit(True))).groupBy("market_ticker").agg(F.max_by(F.struct("yes_price_dollars", "count", "taker_side", "received_ts_ms"), "received_ts_ms").alias("x"))
    book = ours(books).groupBy("market_ticker").agg(F.max("received_ts_ms").alias("booked"))
    cents = lambda c: F.round(100 * c.try_cast("double"), 6)
    out = newest.join(last, "market_ticker", "left").join(book, "market_ticker", "left")
    out = out.select(
        "event_ticker", "market_ticker", F.expr(r"try_cast(nullif(regexp_extract(market_ticker, '-T(\\d+(?:\\.\\d+)?)$', 1), '') AS DOUBLE)").alias("strike"),
        cents(F.col("t.yes_bid_dollars")).alias("bid"), cents(F.col("t.yes_ask_dollars")).alias("ask"), cents(F.col("t.yes_ask_dollars").try_cast("double") - F.col("t.yes_bid_dollars").try_cast("double")).alias("spread"), cents(F.col("t.last_price_dollars")).alias("last"),
        F.col("t.volume").try_cast("double").alias("volume"), F.col("t.open_interest").try_cast("double").alias("open_interest"),
        cents(F.col("x.yes_price_dollars")).alias("last_trade"), F.col("x.count").try_cast("double").alias("last_trade_qty"), F.upper("x.taker_side").alias("last_trade_side"),
        (now_ms - F.coalesce("x.received_ts_ms", F.greatest("t.received_ts_ms", "booked"))).alias("activity_ms"), F.col("x").isNotNull().alias("has_trade"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("event_ticker").orderBy(F.col("strike").asc_nulls_last(), "market_ticker")))


def rollover(staged: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages (series, event_ticker, at) with accepted, switches and generation, by the rule of a staged change of events.

    staged: series, event_ticker, at. A staged event waits until its first message, which makes it the active one and ends
    the one before; meanwhile messages of both are accepted. A later candidate takes the waiting one's place; staging the
    event that is active already is ignored. Times of a series differ; messages at the time of a staging come after it.
    """
    series = Window.partitionBy("series").orderBy("at")
    # an event is confirmed by its first message while it waits: the last staging at or before that message is its own
    waits = staged.select("series", "at", F.col("event_ticker").alias("candidate"), F.col("at").alias("from"))
    hit = asof(messages, waits, ["series"], "at", ["candidate", "from"]).where("event_ticker = candidate")
    turns = hit.groupBy("series", F.col("candidate").alias("event_ticker"), "from").agg(F.min("at").alias("at"))
    # of turns in a row to the same event the first counts: the others staged what was active
    turns = turns.withColumn("again", F.coalesce(F.lag("event_ticker").over(series) == F.col("event_ticker"), F.lit(False))).where("NOT again")
    turns = turns.withColumn("generation", F.row_number().over(series)).select("series", "at", F.col("event_ticker").alias("active"), "generation")
    rows = asof(messages, turns, ["series"], "at", ["active", "generation"]).drop("matched_at")
    rows = asof(rows, staged.select("series", "at", F.col("event_ticker").alias("pending")), ["series"], "at", ["pending"]).drop("matched_at")
    own = F.coalesce(F.col("event_ticker") == F.col("active"), F.lit(False))
    waiting = F.coalesce(F.col("event_ticker") == F.col("pending"), F.lit(False))
    return rows.select("series", "event_ticker", "at", (own | waiting).alias("accepted"), F.coalesce("active", F.lit("")).alias("active"), F.coalesce("generation", F.lit(0)).alias("generation"))
