"""Queries over consolidated books, contract pricing, models and quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltide.functions.columns import ERF_A, ERF_P
from voltide.operators import bars as B
from voltide.operators import book as K
from voltide.operators import features as X
from voltide.operators import joins as J
from voltide.operators import models as M
from voltide.operators import pricing as P
from voltide.operators import quality as Q
from voltide.operators import running_book as R
from voltide.sources.adapters import book_levels, quotes, trades

from .bars import clean, flat, hourly
from .base import BARS, HOUR, SYNTHETIC, TRADE_BARS, query
from .features import EWMA, FEATURES, LABELS, YEAR, features, returns

# -- books: the latest venue books of each hour, consolidated by hour

LATEST = "latest"


def latest(spark, d):
    return flat(B.latest_book(book_levels(spark, d), HOUR)).drop("instrument")


RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY bucket, venue, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS rank FROM latest)"


@query("normalize_levels", "SELECT bucket, venue, side, price, quantity, rank FROM r WHERE rank <= 5", TRADE_BARS + "," + RANKED)
def normalize_levels(spark, d):
    return K.normalize_levels(latest(spark, d), ["bucket", "venue"], 5).select("bucket", "venue", "side", "price", "quantity", "rank")


@query("venue_book", "SELECT bucket, side, price, quantity, rank FROM r WHERE rank <= 3 AND venue = 'view'", TRADE_BARS + "," + RANKED)
def venue_book(spark, d):
    return K.normalize_levels(latest(spark, d).where("venue = 'view'"), ["bucket", "venue"], 3).select("bucket", "side", "price", "quantity", "rank")


@query("fresh_books", """SELECT asof_us, venue, event_id, asof_us - us <= 600000000 AS fresh FROM
  (SELECT a.asof_us, v.venue FROM (SELECT DISTINCT (bucket + 3600) * 1000000 AS asof_us FROM latest) a, (SELECT DISTINCT venue FROM latest) v) g
  ASOF JOIN (SELECT epoch_us(received_timestamp) AS us, venue, event_id FROM book_levels WHERE side = 'bid' AND level = 1) b ON g.venue = b.venue AND g.asof_us >= b.us""".replace("SELECT asof_us, venue, event_id,", "SELECT asof_us, g.venue, event_id,"), TRADE_BARS)
def fresh_books(spark, d):
    quoted_on = latest(spark, d).select(((F.col("bucket") + HOUR) * 1_000_000).alias("asof_us")).distinct()
    return K.fresh_books(book_levels(spark, d), quoted_on, 600_000_000)


FEES = {"click": 0.01, "view": 0.002}


def fees(spark):
    return spark.createDataFrame(list(FEES.items()), "venue string, fee double")


FEE_SQL = "CASE venue WHEN 'click' THEN 0.01::DOUBLE WHEN 'view' THEN 0.002::DOUBLE ELSE 0 END"


@query("effective_price", f"SELECT bucket, venue, side, level, price * CASE side WHEN 'bid' THEN 1 - {FEE_SQL} ELSE 1 + {FEE_SQL} END AS price FROM latest", TRADE_BARS)
def effective_price(spark, d):
    return K.effective_price(latest(spark, d), fees(spark)).select("bucket", "venue", "side", "level", "price")


TICK = "(CASE side WHEN 'bid' THEN floor(round(price, 9)::DECIMAL(28, 9)::DECIMAL(28, 9) / 0.5) ELSE ceil(round(price, 9)::DECIMAL(28, 9) / 0.5) END * 0.5)::DOUBLE"
TICKED = f"ticked AS (SELECT bucket, venue, side, level, {TICK} AS price, quantity FROM latest)"


def ticked(spark, d):
    return K.tick_bucket(latest(spark, d), 0.5)


@query("tick_bucket", "SELECT bucket, venue, side, level, price FROM ticked", TRADE_BARS + "," + TICKED)
def tick_bucket(spark, d):
    return ticked(spark, d).select("bucket", "venue", "side", "level", "price")


@query("tick_inferred", """SELECT venue, side, bucket, level, CASE side WHEN 'bid' THEN floor(round(price / tick, 6)) ELSE ceil(round(price / tick, 6)) END * tick AS price
  FROM (SELECT * REPLACE (round(price, places) AS price) FROM coarse) JOIN (SELECT venue, pow(10.0::DOUBLE, -max(places)) AS tick FROM coarse GROUP BY venue) USING (venue)""",
       TRADE_BARS + ", coarse AS (SELECT *, CASE venue WHEN 'click' THEN 0 WHEN 'view' THEN 2 ELSE 1 END AS places FROM (SELECT bucket, venue, side, level, CASE venue WHEN 'click' THEN floor(price) WHEN 'view' THEN floor(price) + 0.25 ELSE floor(price) + 0.5 END AS price FROM latest))")
def tick_inferred(spark, d):
    """Prices on a grid of their venue's own: whole, quarter or half numbers; the finest decimal place in use is the tick."""
    rest = F.when(F.col("venue") == "click", 0.0).when(F.col("venue") == "view", 0.25).otherwise(0.5)
    rows = latest(spark, d).withColumn("price", F.floor("price") + rest)
    return K.tick_bucket(rows, by=["venue"]).select("bucket", "venue", "side", "level", "price")


@query("consolidate_book", """SELECT bucket, side, price, sum(q) AS quantity, string_agg(venue || ':' || q::INT, ',' ORDER BY venue) AS venues FROM (SELECT bucket, side, price, venue, sum(quantity) AS q FROM ticked GROUP BY ALL) GROUP BY ALL""", TRADE_BARS + "," + TICKED)
def consolidate_book(spark, d):
    out = K.consolidate(ticked(spark, d), ["bucket"])
    return out.withColumn("venues", F.array_join(F.transform(F.map_entries("venues"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("int").cast("string"))), ","))


UNCROSS = """
lv AS (SELECT bucket, side, price, sum(quantity) AS q FROM ticked GROUP BY ALL),
li AS (SELECT *, sum(q) OVER w AS stop, sum(q) OVER w - q AS start FROM lv WINDOW w AS (PARTITION BY bucket, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END ROWS UNBOUNDED PRECEDING)),
mt AS (SELECT b.bucket, max(least(b.stop, a.stop)) AS matched FROM li b JOIN li a ON a.bucket = b.bucket AND b.side = 'bid' AND a.side = 'ask' AND b.price >= a.price AND least(b.stop, a.stop) > greatest(b.start, a.start) GROUP BY b.bucket),
fv AS (SELECT bucket, side, price, venue, sum(quantity) AS q FROM ticked GROUP BY ALL),
fi AS (SELECT *, sum(q) OVER (PARTITION BY bucket, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END, venue ROWS UNBOUNDED PRECEDING) AS stop FROM fv),
uncrossed AS (SELECT bucket, side, price, venue, greatest(0, stop - greatest(stop - q, coalesce(matched, 0))) AS quantity FROM fi LEFT JOIN mt USING (bucket))"""


@query("uncross_book", "SELECT * FROM uncrossed WHERE quantity > 1e-12", TRADE_BARS + "," + TICKED + "," + UNCROSS)
def uncross_book(spark, d):
    return K.uncross(ticked(spark, d), ["bucket"])


@query("book_summary", """SELECT bucket, venue, max(price) FILTER (side = 'bid') AS best_bid, min(price) FILTER (side = 'ask') AS best_ask, sum(quantity) FILTER (side = 'bid') AS bid_depth, sum(quantity) FILTER (side = 'ask') AS ask_depth,
  (max(price) FILTER (side = 'bid') + min(price) FILTER (side = 'ask')) / 2 AS mid, min(price) FILTER (side = 'ask') - max(price) FILTER (side = 'bid') AS spread,
  (sum(quantity) FILTER (side = 'bid') - sum(quantity) FILTER (side = 'ask')) / sum(quantity) AS imbalance FROM r WHERE rank <= 5 GROUP BY ALL""", TRADE_BARS + "," + RANKED)
def book_summary(spark, d):
    return K.book_summary(latest(spark, d), ["bucket", "venue"], 5)


@query("ladder_rows", "SELECT bucket, venue, CASE side WHEN 'ask' THEN 6 - rank ELSE 6 + rank END AS place, side, price, quantity, 100 * quantity / max(quantity) OVER (PARTITION BY bucket, venue) AS percent FROM r WHERE rank <= 5", TRADE_BARS + "," + RANKED)
def ladder_rows(spark, d):
    return K.ladder(latest(spark, d), ["bucket", "venue"], 5)


def updates(spark, d):
    """Updates of a book a venue: every hundredth event's book is a snapshot, others change a level by their sequence."""
    b = book_levels(spark, d).withColumn("price", F.col("level").cast("double"))
    snap = b.where("event_id % 100 = 0").select("venue", F.col("event_id").alias("seq"), F.lit("snapshot").alias("kind"), "side", "price", "quantity")
    delta = b.where("event_id % 100 <> 0 AND level = event_id % 10 + 1").select("venue", F.col("event_id").alias("seq"), F.lit("delta").alias("kind"), "side", "price", (F.col("quantity") - 3).alias("quantity"))
    return snap.unionByName(delta)


UPDATES = """
upd AS (SELECT venue, event_id AS seq, 'snapshot' AS kind, side, level::DOUBLE AS price, quantity FROM book_levels WHERE event_id % 100 = 0
  UNION ALL SELECT venue, event_id, 'delta', side, level::DOUBLE, quantity - 3 FROM book_levels WHERE event_id % 100 <> 0 AND level = event_id % 10 + 1),
live AS (SELECT upd.*, epoch FROM upd JOIN (SELECT venue, max(seq) AS epoch FROM upd WHERE kind = 'snapshot' GROUP BY venue) USING (venue) WHERE seq >= epoch)"""


@query("apply_level_updates", "SELECT * FROM (SELECT venue, side, price, arg_max(quantity, seq) AS quantity FROM live GROUP BY ALL) WHERE quantity > 0", UPDATES)
def apply_level_updates(spark, d):
    return K.apply_level_updates(updates(spark, d), ["venue"])


@query("apply_book_deltas", """SELECT venue, side, price, coalesce(book[place], 0) AS quantity, rejected > 0 AS rejected FROM (SELECT venue, side, price, any_value(place) AS place, count(reason) AS rejected FROM (SELECT venue, side, price, side || price AS place, NULL AS reason FROM live
    UNION ALL SELECT d.venue, side, price, d.place, reason FROM d JOIN r USING (venue, n)) GROUP BY ALL) JOIN (SELECT venue, arg_max(book, n) AS book FROM r GROUP BY venue) USING (venue) WHERE coalesce(book[place], 0) > 0 OR rejected > 0""", UPDATES + """,
d AS (SELECT *, side || price AS place, row_number() OVER (PARTITION BY venue ORDER BY seq, side, price) AS n FROM live WHERE kind = 'delta'),
r AS (WITH RECURSIVE v AS (SELECT venue, 0::BIGINT AS n, any_value(seq) AS last, map_from_entries(list((side || price, quantity))) AS book, NULL::VARCHAR AS reason FROM live WHERE kind = 'snapshot' AND seq = epoch GROUP BY venue
  UNION ALL SELECT venue, n, CASE WHEN reason IS NULL THEN seq ELSE last END, CASE WHEN reason IS NULL THEN map_concat(book, map([place], [coalesce(book[place], 0) + quantity])) ELSE book END, reason
  FROM (SELECT d.*, v.last, v.book, CASE WHEN d.seq <= v.last THEN 'stale' WHEN coalesce(v.book[d.place], 0) + d.quantity < 0 THEN 'negative' END AS reason FROM v JOIN d ON d.venue = v.venue AND d.n = v.n + 1)) SELECT * FROM v)""")
def apply_book_deltas(spark, d):
    """Every sequence comes with a delta of either side; of two that fit, the book takes the first."""
    return K.apply_book_deltas(updates(spark, d), ["venue"]).withColumn("rejected", F.col("rejected") > 0)


def book_messages(spark, d, quantity):
    """Messages of a book a venue, by event: every hundredth event's book is a snapshot, others change one level."""
    b = book_levels(spark, d)
    level = F.struct("side", F.col("level").cast("string").alias("price"), quantity.cast("long").cast("string").alias("quantity"))
    rows = b.where("event_id % 100 = 0 OR level = event_id % 10 + 1").groupBy("venue", "event_id").agg(F.array_sort(F.collect_list(level)).alias("levels"))
    kind = F.when(F.col("event_id") % 100 == 0, "snapshot").otherwise("delta")
    return rows.select("venue", (F.col("event_id") * 4).alias("at"), F.col("event_id").alias("sequence"), kind.alias("kind"), "levels", "event_id")


#: SQL of the book of each venue after each message.
BOOK_AFTER_MESSAGES = ("""SELECT m.venue, m.event_id AS sequence, count(*) FILTER (s.side = 'bid' AND u.q > 0)::INT AS n_bids, count(*) FILTER (s.side = 'ask' AND u.q > 0)::INT AS n_asks, max(CASE WHEN s.side = 'bid' AND u.q > 0 THEN s.level END)::DOUBLE AS best_bid,
  min(CASE WHEN s.side = 'ask' AND u.q > 0 THEN s.level END)::DOUBLE AS best_ask, sum(CASE WHEN u.q > 0 THEN u.q ELSE 0 END)::DOUBLE AS total
  FROM msg m CROSS JOIN (SELECT side, unnest(range(1, 11)) AS level FROM (VALUES ('bid'), ('ask')) x(side)) s
  ASOF LEFT JOIN upd u ON u.venue = m.venue AND u.side = s.side AND u.level = s.level AND u.epoch = m.epoch AND u.event_id <= m.event_id GROUP BY ALL""",
       """upd0 AS (SELECT venue, event_id, side, level, greatest(quantity - 3, 0) AS q FROM book_levels WHERE event_id % 100 = 0 OR level = event_id % 10 + 1),
msg AS (SELECT *, max(CASE WHEN event_id % 100 = 0 THEN event_id ELSE -1 END) OVER (PARTITION BY venue ORDER BY event_id) AS epoch FROM (SELECT DISTINCT venue, event_id FROM upd0)),
upd AS (SELECT upd0.*, epoch FROM upd0 JOIN msg USING (venue, event_id))""")


@query("running_books", *BOOK_AFTER_MESSAGES)
def running_books(spark, d):
    """The book of each venue after each of its messages, which name quantities; 0 takes a level out."""
    messages = book_messages(spark, d, F.greatest(F.col("quantity") - 3, F.lit(0)))
    books = R.running_books(messages, ["venue"], "at", signed=False)
    price = lambda side: F.get(side, F.lit(0))["price"].cast("double")
    both = F.concat("bid", "ask")
    return books.select("venue", "sequence", F.size("bid").alias("n_bids"), F.size("ask").alias("n_asks"), price("bid").alias("best_bid"), price("ask").alias("best_ask"), F.aggregate(both, F.lit(0.0), lambda t, x: t + x["quantity"].cast("double")).alias("total"))


@query("contract_books", """SELECT venue, n AS place, sequence, reason, len(map_keys(book))::INT AS n_levels, list_sum(map_values(book))::DOUBLE AS total FROM r WHERE n > 0""",
       """flow AS (SELECT venue, event_id * 4 AS "at", event_id AS sequence, false AS fresh, side, level, (quantity - 3)::BIGINT AS q FROM book_levels WHERE event_id % 100 <> 0 AND level = event_id % 10 + 1 AND side = 'bid'
  UNION ALL SELECT venue, event_id * 4 + 1, event_id, false, side, level, (quantity - 3)::BIGINT FROM book_levels WHERE event_id % 100 <> 0 AND event_id % 6 = 0 AND level = (event_id + 1) % 10 + 1 AND side = 'ask'
  UNION ALL SELECT venue, event_id * 4 + 2, event_id - 8, false, side, level, 1 FROM book_levels WHERE event_id % 100 <> 0 AND event_id % 14 = 0 AND level = 1 AND side = 'ask'),
snap AS (SELECT venue, event_id * 4 AS "at", event_id AS sequence, map_from_entries(list((side || level, (quantity - CASE WHEN event_id % 300 = 0 THEN 13 ELSE 0 END)::BIGINT))) AS levels, min(quantity - CASE WHEN event_id % 300 = 0 THEN 13 ELSE 0 END) < 0 AS bad FROM book_levels WHERE event_id % 100 = 0 GROUP BY venue, event_id),
msg AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY "at") AS n FROM (SELECT venue, "at", sequence, false AS fresh, NULL AS levels, false AS bad, side || level AS place, q FROM flow UNION ALL SELECT venue, "at", sequence, true, levels, bad, NULL, NULL FROM snap)),
r AS (WITH RECURSIVE v AS (SELECT DISTINCT venue, 0::BIGINT AS n, 0::BIGINT AS sequence, NULL::BIGINT AS last, map_from_entries([]::STRUCT(k VARCHAR, v BIGINT)[]) AS book, NULL::VARCHAR AS reason FROM msg
  UNION ALL SELECT venue, n, sequence, CASE WHEN reason IS NULL THEN sequence ELSE last END, CASE WHEN reason IS NOT NULL THEN book ELSE map_from_entries(list_filter(map_entries(CASE WHEN fresh THEN levels ELSE map_concat(book, map([place], [have + q])) END), lambda e: e.value <> 0)) END, reason
  FROM (SELECT m.*, v.last, v.book, coalesce(v.book[m.place], 0) AS have,
    CASE WHEN m.fresh THEN CASE WHEN m.bad THEN 'negative' END WHEN v.last IS NULL THEN 'before_snapshot' WHEN m.sequence <= v.last THEN 'stale' WHEN coalesce(v.book[m.place], 0) + m.q < 0 THEN 'negative' END AS reason
    FROM v JOIN msg m ON m.venue = v.venue AND m.n = v.n + 1)) SELECT * FROM v)""")
def contract_books(spark, d):
    """Signed deltas behind snapshots, in order of arrival: a second level at a sequence, sequences that come late, deltas
    and snapshots below 0, each with the reason why it is refused, and what the book holds after every message.
    """
    b = book_levels(spark, d).withColumn("id", F.col("event_id"))
    less = F.when(F.col("id") % 300 == 0, 13).otherwise(0)
    of = lambda q: F.struct("side", F.col("level").cast("string").alias("price"), q.cast("long").cast("string").alias("quantity"))
    snap = b.where("id % 100 = 0").groupBy("venue", "id").agg(F.collect_list(of(F.col("quantity") - less)).alias("levels")).select("venue", (F.col("id") * 4).alias("at"), F.col("id").alias("sequence"), F.lit("snapshot").alias("kind"), "levels")
    deltas = b.where("id % 100 <> 0")
    flow = lambda rows, later, behind, q: rows.select("venue", (F.col("id") * 4 + later).alias("at"), (F.col("id") - behind).alias("sequence"), F.lit("delta").alias("kind"), F.array(of(q)).alias("levels"))
    first = flow(deltas.where("level = id % 10 + 1 AND side = 'bid'"), 0, 0, F.col("quantity") - 3)
    second = flow(deltas.where("id % 6 = 0 AND level = (id + 1) % 10 + 1 AND side = 'ask'"), 1, 0, F.col("quantity") - 3)
    late = flow(deltas.where("id % 14 = 0 AND level = 1 AND side = 'ask'"), 2, 8, F.lit(1))
    messages = snap.unionByName(first).unionByName(second).unionByName(late)
    place = F.row_number().over(Window.partitionBy("venue").orderBy("at"))
    books = R.running_books(messages, ["venue"], "at", signed=True)
    both = F.concat("bid", "ask")
    total = F.when(F.size(both) > 0, F.aggregate(both, F.lit(0.0), lambda t, x: t + x["quantity"].cast("double")))
    return books.select("venue", place.cast("long").alias("place"), "sequence", "reason", F.size(both).alias("n_levels"), total.alias("total"))


# -- contracts

CURVE = (0.3, 0.35, 0.5, 0.45)
CURVE_SQL = "curve AS (SELECT 0.3::DOUBLE AS sigma_300, 0.35::DOUBLE AS sigma_900, 0.5::DOUBLE AS sigma_1800, 0.45::DOUBLE AS sigma_3600)"


def curve(spark):
    return spark.createDataFrame([CURVE], ", ".join(f"sigma_{h} double" for h in P.HORIZONS))


def cdf(x):
    """The normal distribution function as SQL text."""
    z, t = f"(abs({x}) / sqrt(2))", f"(1 / (1 + {ERF_P}::DOUBLE * abs({x}) / sqrt(2)))"
    series = "0"
    for a in reversed(ERF_A):
        series = f"(({series} + {a}::DOUBLE) * {t})"
    return f"(CASE WHEN {x} >= 0 THEN 1 - 0.5::DOUBLE * {series} * exp(-{z} * {z}) ELSE 0.5::DOUBLE * {series} * exp(-{z} * {z}) END)"


def interpolated(tau):
    parts = " ".join(f"WHEN {tau} > {a} AND {tau} <= {b} THEN sigma_{a} + (sigma_{b} - sigma_{a}) * ({tau} - {a}) / {b - a}.0::DOUBLE" for a, b in zip(P.HORIZONS, P.HORIZONS[1:]))
    return f"CASE WHEN {tau} > 0 AND {tau} <= 300 THEN sigma_300 {parts} END"


@query("validate_curve", "SELECT h, h % 7 <> 0 AND h % 5 <> 0 AS valid FROM (SELECT DISTINCT hour // 3600 AS h FROM quotes)")
def validate_curve(spark, d):
    rows = quotes(spark, d).select(F.floor(F.col("hour") / 3600).alias("h")).distinct()
    rows = rows.withColumns({"sigma_300": F.lit(0.3), "sigma_900": F.when(F.col("h") % 7 != 0, 0.4), "sigma_1800": F.when(F.col("h") % 5 == 0, -1.0).otherwise(0.5), "sigma_3600": F.lit(0.5)})
    return P.valid_curve(rows).select("h", "valid")


@query("interpolate_vol", f"SELECT DISTINCT tau, {interpolated('tau')} AS sigma FROM (SELECT hour // 3600 % 40 * 100 AS tau FROM quotes), curve", CURVE_SQL)
def interpolate_vol(spark, d):
    tau = quotes(spark, d).select((F.floor(F.col("hour") / 3600) % 40 * 100).alias("tau")).distinct()
    return tau.join(F.broadcast(curve(spark))).select("tau", P.interpolate_vol(F.col("tau")).alias("sigma"))


V = f"(0.4::DOUBLE * sqrt(1800 / {YEAR}))"


def _priced(spark, d, f):
    return quotes(spark, d).withColumn("v", P.deviation(F.lit(0.4), F.lit(1800))).select("market_ticker", f(F.col("spot"), F.col("strike"), F.col("v")).alias("probability"))


query("above_strike_probability", f"SELECT market_ticker, {cdf('x')} AS probability FROM (SELECT market_ticker, ln(spot / strike) / {V} AS x FROM quotes)")(lambda spark, d: _priced(spark, d, P.above_strike))
query("black_digital", f"SELECT market_ticker, {cdf('x')} AS probability FROM (SELECT market_ticker, ln(spot / strike) / {V} - {V} / 2 AS x FROM quotes)")(lambda spark, d: _priced(spark, d, P.black_digital))


@query("quote_edges", "SELECT market_ticker, (bid + ask) / 2 AS mid, 0.5::DOUBLE - (bid + ask) / 2 AS edge, 0.5::DOUBLE - ask AS buy_edge, bid - 0.5::DOUBLE AS sell_edge FROM quotes")
def quote_edges(spark, d):
    return P.with_edges(quotes(spark, d).withColumn("model", F.lit(0.5))).select("market_ticker", "mid", "edge", "buy_edge", "sell_edge")


def _implied_rounds(rounds=6):
    """The grid search as a chain of tables: each round's points, their losses, and the best point's neighbours."""
    out, before = [f"""nearest AS (SELECT event_ticker, (bid + ask) / 2 AS mid, ln(spot / strike) AS m, sqrt((expiry - quoted_on) / {YEAR}) AS s, open_interest + 1 AS oi FROM quotes
  WHERE bid > 0 AND bid <= ask AND ask < 1 AND (bid + ask) / 2 BETWEEN 0.01 AND 0.99 QUALIFY row_number() OVER (PARTITION BY event_ticker ORDER BY abs(ln(spot / strike)), strike) <= 7),
weighed AS (SELECT *, oi / sum(oi) OVER (PARTITION BY event_ticker) AS w FROM nearest QUALIFY count(*) OVER (PARTITION BY event_ticker) >= 5),
r0 AS (SELECT event_ticker, 0.01::DOUBLE AS low, 5.0::DOUBLE AS high FROM weighed GROUP BY event_ticker)"""], "r0"
    for k in range(1, rounds + 1):
        n = 160 if k == 1 else 40
        out.append(f"""p{k} AS (SELECT event_ticker, i, (high - low) / {n} AS step, low + i * (high - low) / {n} AS sigma FROM {before}, (SELECT unnest(range({n + 1})) AS i)),
x{k} AS (SELECT p.*, w, mid, m / (sigma * s) - sigma * s / 2 AS x FROM p{k} p JOIN weighed USING (event_ticker)),
e{k} AS (SELECT *, abs({cdf('x')} - mid) AS e FROM x{k}),
l{k} AS (SELECT event_ticker, i, step, sigma, sum(w * CASE WHEN e <= 0.02 THEN 0.5::DOUBLE * e * e ELSE 0.02::DOUBLE * (e - 0.01) END) AS loss FROM e{k} GROUP BY ALL),
r{k} AS (SELECT event_ticker, greatest(0.01, sigma - step) AS low, least(5.0, sigma + step) AS high, sigma FROM l{k} QUALIFY row_number() OVER (PARTITION BY event_ticker ORDER BY loss, i) = 1)""")
        before = f"r{k}"
    return ",\n".join(out)


@query("implied_vol", "SELECT event_ticker, round(sigma, 3) AS sigma, n_quotes FROM r6 JOIN (SELECT event_ticker, count(*)::INT AS n_quotes FROM weighed GROUP BY 1) USING (event_ticker)", _implied_rounds())
def implied_vol(spark, d):
    """To three digits: the last rounds' points differ by less than sums of seven losses can tell."""
    out = P.implied_vol(quotes(spark, d).withColumn("tau", F.col("expiry") - F.col("quoted_on")), ["event_ticker"])
    return out.withColumn("sigma", F.round("sigma", 3))


@query("active_event", "SELECT first(event_ticker ORDER BY quoted_on DESC) AS event_ticker FROM quotes")
def active_event(spark, d):
    return quotes(spark, d).agg(F.max_by("event_ticker", "quoted_on").alias("event_ticker"))


@query("atm_window", "SELECT event_ticker, market_ticker, j FROM quotes WHERE abs(j) <= 6")
def atm_window(spark, d):
    return P.atm_window(quotes(spark, d), ["event_ticker"]).select("event_ticker", "market_ticker", "j")


META = "meta AS (SELECT event_ticker, market_ticker, strike, hour + (j + 8) * 400 AS expiry, CASE WHEN j = 5 THEN 'settled' ELSE 'active' END AS status FROM quotes WHERE j <> -7)"


def metadata(spark, d):
    q = quotes(spark, d).where("j <> -7")
    return q.select("event_ticker", "market_ticker", "strike", (F.col("hour") + (F.col("j") + 8) * 400).alias("expiry"), F.when(F.col("j") == 5, "settled").otherwise("active").alias("status"))


@query("ticker_metadata_join", "SELECT market_ticker, m.strike, status, CASE WHEN m.strike IS NULL THEN 'no_metadata' WHEN status <> 'active' THEN 'not_open' END AS reason FROM quotes LEFT JOIN meta m USING (event_ticker, market_ticker)", META)
def ticker_metadata_join(spark, d):
    rows = J.with_metadata(quotes(spark, d).drop("strike", "expiry"), metadata(spark, d))
    return rows.select("market_ticker", "strike", "status", F.col("metadata_reason").alias("reason"))


PRICED = f"""
pr AS (SELECT q.*, m.strike AS k, status, m.expiry - quoted_on AS tau FROM quotes q LEFT JOIN meta m USING (event_ticker, market_ticker)),
ps AS (SELECT pr.*, {interpolated('tau')} AS sigma FROM pr, curve),
pq AS (SELECT *, CASE WHEN k IS NULL THEN 'no_metadata' WHEN status <> 'active' THEN 'not_open' WHEN tau <= 0 THEN 'expired' WHEN sigma IS NULL THEN 'beyond_curve' END AS reason,
  ln(spot / k) / (sigma * sqrt(tau / {YEAR})) AS x FROM ps),
priced AS (SELECT market_ticker, reason, CASE WHEN reason IS NULL THEN {cdf('x')} END AS model, bid, ask, quoted_on, j FROM pq)"""


@query("price_contracts", "SELECT market_ticker, reason, model, CASE WHEN j % 4 <> 0 THEN model - (bid + ask) / 2 END AS edge FROM priced", META + "," + CURVE_SQL + "," + PRICED)
def price_contracts(spark, d):
    tickers = quotes(spark, d).withColumn("quoted_at", F.col("quoted_on") - F.when(F.col("j") % 4 == 0, 100).otherwise(10)).drop("strike", "expiry")
    return P.price_contracts(tickers, metadata(spark, d), curve(spark), F.col("quoted_on")).select("market_ticker", "reason", "model", "edge")


@query("expire_contracts", "SELECT market_ticker, CASE WHEN expiry <= 1705000000 THEN 'expired' WHEN hour // 3600 % 3 = 0 THEN 'unknown_event' END AS reason FROM quotes")
def expire_contracts(spark, d):
    q = quotes(spark, d)
    return P.expire_contracts(q, q.where(F.floor(F.col("hour") / 3600) % 3 != 0), 1705000000).select("market_ticker", "reason")


@query("ticker_latest", "SELECT j, first(market_ticker ORDER BY quoted_on DESC) AS market_ticker, first(bid ORDER BY quoted_on DESC) AS bid FROM quotes GROUP BY j")
def ticker_latest(spark, d):
    return quotes(spark, d).groupBy("j").agg(F.max_by(F.struct("market_ticker", "bid"), "quoted_on").alias("x")).select("j", "x.*")


@query("latest_state_join", """SELECT q.j, q.market_ticker, CASE WHEN age BETWEEN -2 AND 60 THEN p.price END AS price FROM (SELECT j, first(market_ticker ORDER BY quoted_on DESC) AS market_ticker, max(quoted_on) AS quoted_on FROM quotes GROUP BY j) q,
  (SELECT last(price ORDER BY event_timestamp) AS price, max(epoch_us(event_timestamp) // 1000000) AS tm FROM deduped) p, LATERAL (SELECT q.quoted_on + j * 60 - tm AS age) a""")
def latest_state_join(spark, d):
    q = quotes(spark, d).groupBy("j").agg(F.max_by("market_ticker", "quoted_on").alias("market_ticker"), F.max("quoted_on").alias("quoted_on")).withColumn("at", F.col("quoted_on") + F.col("j") * 60)
    spots = clean(spark, d).select("price", "event_timestamp", F.unix_seconds("event_timestamp").alias("second"), F.unix_micros("event_timestamp").alias("us"))
    newest = spots.groupBy("second").agg(F.max_by("price", "us").alias("price"))
    return J.latest_state(q, newest, "at", "second", ["price"]).select("j", "market_ticker", "price")


@query("last_distinct_trade", "SELECT venue, max(tm) AS since FROM (SELECT venue, epoch_us(event_timestamp) AS tm, (round(price), taker_side) IS DISTINCT FROM lag((round(price), taker_side)) OVER (PARTITION BY venue ORDER BY event_timestamp) AS new FROM deduped) WHERE new GROUP BY venue")
def last_distinct_trade(spark, d):
    rows = clean(spark, d).select("venue", F.unix_micros("event_timestamp").alias("at"), F.round("price").alias("p"), "taker_side")
    return P.last_distinct_trade(rows, "venue", "at", ["p", "taker_side"])


MONITOR = "(SELECT * FROM quotes QUALIFY event_ticker = first(event_ticker) OVER (ORDER BY quoted_on DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


def monitored(spark, d):
    q = quotes(spark, d)
    return q.join(F.broadcast(q.agg(F.max_by("event_ticker", "quoted_on").alias("event_ticker"))), "event_ticker")


NOW = "(SELECT max(quoted_on) * 1000 AS now FROM quotes)"


@query("contract_monitor", f"""SELECT event_ticker, market_ticker, j + 8.0::DOUBLE AS strike, round(100 * bid, 6) AS bid, round(100 * ask, 6) AS ask, round(100 * (ask - bid), 6) AS spread, open_interest::DOUBLE AS open_interest,
  CASE WHEN j % 2 = 0 THEN 30.0::DOUBLE END AS last_trade, CASE WHEN j % 2 = 0 THEN 2.0::DOUBLE END AS last_trade_qty, CASE WHEN j % 2 = 0 THEN 'YES' END AS last_trade_side,
  CASE WHEN j % 2 = 0 THEN 200000 WHEN j % 3 = 0 THEN 500 ELSE 1000 + (j + 8) * 10 END AS activity_ms, j % 2 = 0 AS has_trade, row_number() OVER (ORDER BY j) AS place
  FROM {MONITOR}, {NOW} WHERE j <> -8""")
def contract_monitor(spark, d):
    """Tickers (one of them stale), runs of trades of the even markets, and books of every third."""
    q = quotes(spark, d)
    now = q.agg(F.max(F.col("quoted_on") * 1000)).first()[0]
    at, text = F.col("quoted_on") * 1000, F.lit(None).cast("string")
    tickers = q.select("event_ticker", "market_ticker", F.col("bid").cast("string").alias("yes_bid_dollars"), F.col("ask").cast("string").alias("yes_ask_dollars"), text.alias("last_price_dollars"), text.alias("volume"), F.col("open_interest").cast("string").alias("open_interest"),
                       (at - F.when(F.col("j") == -8, 400_000).otherwise(1000 + (F.col("j") + 8) * 10)).alias("received_ts_ms"))
    runs = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(ago).alias("ago")) for p, ago in (("0.3", 290_000), ("0.4", 250_000), ("0.3", 200_000), ("0.3", 100_000), ("0.3", 7_000))]))
    trades = q.where("j % 2 = 0").select("event_ticker", "market_ticker", "quoted_on", runs.alias("x")).select("event_ticker", "market_ticker", F.col("x.p").alias("yes_price_dollars"), F.lit("2").alias("count"), F.lit("yes").alias("taker_side"), (at - F.col("x.ago")).alias("received_ts_ms"))
    books = q.where("j % 3 = 0").select("event_ticker", "market_ticker", (at - 500).alias("received_ts_ms"))
    return P.contract_monitor(tickers, trades, books, now).drop("last", "volume")


@query("monitor_summary", f"SELECT arg_min(market_ticker, abs(strike - spot)) AS atm, arg_min((bid + ask) / 2, abs(strike - spot)) AS atm_mid, max(bid) AS best_bid, min(ask) AS best_ask FROM {MONITOR}")
def monitor_summary(spark, d):
    far = F.abs(F.col("strike") - F.col("spot"))
    return monitored(spark, d).agg(F.min_by("market_ticker", far).alias("atm"), F.min_by((F.col("bid") + F.col("ask")) / 2, far).alias("atm_mid"), F.max("bid").alias("best_bid"), F.min("ask").alias("best_ask"))


# -- models

INPUTS = ["realized_vol_10800s", "log_buy_volume_10800s"]
TRAINING = f"training AS (SELECT f.bucket, f.realized_vol_10800s, f.log_buy_volume_10800s, l.target_rv_3600s AS target FROM ({FEATURES}) f JOIN ({LABELS}) l USING (asset, bucket) WHERE f.realized_vol_10800s IS NOT NULL AND f.log_buy_volume_10800s IS NOT NULL AND l.target_rv_3600s IS NOT NULL)"
SPLIT = TRAINING + ", split AS (SELECT *, row_number() OVER (ORDER BY bucket) - 1 AS place, CASE WHEN row_number() OVER (ORDER BY bucket) - 1 < floor(count(*) OVER () * 0.7) THEN 'train' WHEN row_number() OVER (ORDER BY bucket) - 1 < floor(count(*) OVER () * 0.85) THEN 'valid' ELSE 'test' END AS part FROM training)"


def matrix(spark, d):
    from .features import labels

    both = features(spark, d).join(labels(spark, d), ["asset", "bucket"])
    return M.model_matrix(both, INPUTS, "target_rv_3600s")


@query("model_matrix", "SELECT * FROM training", SYNTHETIC + "," + TRAINING)
def model_matrix(spark, d):
    return matrix(spark, d)


@query("chronological_split", "SELECT bucket, place, part FROM split", SYNTHETIC + "," + SPLIT)
def chronological_split(spark, d):
    return M.chronological_split(matrix(spark, d)).select("bucket", "place", "part")


@query("purged_split", "SELECT bucket, part FROM split WHERE part = 'test' OR bucket + 3600 < (SELECT min(bucket) FROM split s WHERE s.part = CASE split.part WHEN 'train' THEN 'valid' ELSE 'test' END)", SYNTHETIC + "," + SPLIT)
def purged_split(spark, d):
    return M.purged(M.chronological_split(matrix(spark, d)), 3600).select("bucket", "part")


#: Least squares with coefficients of 0 or more, from sums over the training part: the best of the four sets of inputs.
HAR = """hm AS (SELECT count(*)::DOUBLE AS n, sum(realized_vol_10800s) AS a, sum(log_buy_volume_10800s) AS b, sum(target) AS y, sum(realized_vol_10800s * realized_vol_10800s) AS aa, sum(realized_vol_10800s * log_buy_volume_10800s) AS ab,
  sum(log_buy_volume_10800s * log_buy_volume_10800s) AS bb, sum(realized_vol_10800s * target) AS ay, sum(log_buy_volume_10800s * target) AS by_, sum(target * target) AS yy FROM split WHERE part = 'train'),
hc AS (SELECT *, aa - a * a / n AS caa, bb - b * b / n AS cbb, ab - a * b / n AS cab, ay - a * y / n AS cay, by_ - b * y / n AS cby, yy - y * y / n AS cyy FROM hm),
hs AS (SELECT unnest([0, cay / caa, 0, (cay * cbb - cby * cab) / (caa * cbb - cab * cab)]) AS wa, unnest([0, 0, cby / cbb, (cby * caa - cay * cab) / (caa * cbb - cab * cab)]) AS wb, hc.* FROM hc),
hw AS (SELECT wa, wb, (y - wa * a - wb * b) / n AS w0, cyy - 2 * wa * cay - 2 * wb * cby + wa * wa * caa + 2 * wa * wb * cab + wb * wb * cbb AS loss FROM hs WHERE wa >= 0 AND wb >= 0),
har AS (SELECT arg_min(w0, loss) AS w0, arg_min(wa, loss) AS wa, arg_min(wb, loss) AS wb FROM hw)"""


@query("train_har", "SELECT bucket, part, target, greatest(w0 + wa * realized_vol_10800s + wb * log_buy_volume_10800s, 0) AS forecast FROM split, har", SYNTHETIC + "," + SPLIT + "," + HAR)
def train_har(spark, d):
    rows = M.chronological_split(matrix(spark, d))
    model = M.train_har(rows.where("part = 'train'"), INPUTS)
    return rows.select("bucket", "part", "target", M.predict(model).alias("forecast"))


@query("train_boosted")
def train_boosted(spark, d):
    """Fewer, shallower trees than the defaults, so that the query ends in seconds."""
    model, data = M.train_boosted(matrix(spark, d), INPUTS, trees=20, depth=3)
    return model.transform(data).select("bucket", "target", F.col("prediction").alias("forecast"))


SCORES = """avg(ln(greatest(f * f, 1e-18::DOUBLE)) + greatest(a * a, 1e-18::DOUBLE) / greatest(f * f, 1e-18::DOUBLE)) AS qlike, sqrt(avg((a - f) * (a - f))) AS rmse, avg(abs(a - f)) AS mae,
  1 - sum((a - f) * (a - f)) / (var_pop(a) * count(a)) AS r2, sqrt(avg(((a - f) / nullif(a, 0)) * ((a - f) / nullif(a, 0)))) AS rmspe"""


@query("score_metrics", f"SELECT part, {SCORES} FROM (SELECT part, target AS a, realized_vol_10800s AS f FROM split) GROUP BY part", SYNTHETIC + "," + SPLIT)
def score_metrics(spark, d):
    return M.chronological_split(matrix(spark, d)).groupBy("part").agg(*M.metrics(F.col("target"), F.col("realized_vol_10800s")))


query("rmspe", "SELECT sqrt(avg(((target - realized_vol_10800s) / nullif(target, 0)) * ((target - realized_vol_10800s) / nullif(target, 0)))) AS rmspe FROM training", SYNTHETIC + "," + TRAINING)(lambda spark, d: matrix(spark, d).agg(M.metrics(F.col("target"), F.col("realized_vol_10800s"))[-1]))

BENCH = f"""bench AS (SELECT s.part, s.target AS a, sqrt(greatest(e.forecast * 1 * {YEAR} / 3600, 1e-18::DOUBLE)) AS f FROM split s JOIN e USING (bucket))"""


@query("ewma_benchmark", f"SELECT {SCORES} FROM bench WHERE part = 'test'", SYNTHETIC + EWMA + "," + SPLIT + "," + BENCH)
def ewma_benchmark(spark, d):
    return benched(spark, d).where("part = 'test'").agg(*M.metrics(F.col("target"), F.col("ewma")))


def benched(spark, d):
    e = X.ewma_variance(returns(spark, d)).select("bucket", X.annualized(F.col("forecast"), HOUR, HOUR).alias("ewma"))
    return M.chronological_split(matrix(spark, d)).join(e, "bucket")


@query("evaluate_model", f"SELECT kind, {SCORES} FROM (SELECT a, unnest(['model', 'benchmark']) AS kind, unnest([m, f]) AS f FROM (SELECT s.bucket, s.target AS a, greatest(w0 + wa * realized_vol_10800s + wb * log_buy_volume_10800s, 0) AS m, sqrt(greatest(e.forecast * {YEAR} / 3600, 1e-18::DOUBLE)) AS f FROM split s JOIN e USING (bucket), har ORDER BY s.bucket DESC LIMIT 120)) GROUP BY kind", SYNTHETIC + EWMA + "," + SPLIT + "," + HAR)
def evaluate_model(spark, d):
    rows = benched(spark, d)
    model = M.train_har(rows.where("part = 'train'"), INPUTS)
    return M.evaluate(rows.withColumns({"model": M.predict(model), "benchmark": F.col("ewma")}), ["model", "benchmark"], 120)


DECIDE = """dm AS (SELECT venue, stddev_samp(price) AS rmse, 25.0::DOUBLE AS champion_rmse, 28.0::DOUBLE AS benchmark_rmse, count(*) % 2 AS failed_before, 30000 AS since_training FROM deduped GROUP BY venue),
dd AS (SELECT *, (rmse - champion_rmse) / champion_rmse AS change FROM dm)"""


def decided(spark, d):
    rows = clean(spark, d).groupBy("venue").agg(F.stddev_samp("price").alias("rmse"), (F.count(F.lit(1)) % 2).alias("failed_before"))
    return M.retrain_decision(rows.withColumns({"champion_rmse": F.lit(25.0), "benchmark_rmse": F.lit(28.0), "since_training": F.lit(30000)}))


query("retrain_decision", "SELECT venue, change, change >= 0.05 AS degraded, CASE WHEN change >= 0.05 THEN failed_before + 1 ELSE 0 END AS failed, (CASE WHEN change >= 0.05 THEN failed_before + 1 ELSE 0 END) >= 2 AS trigger FROM dd", DECIDE)(lambda spark, d: decided(spark, d).select("venue", "change", "degraded", "failed", "trigger"))
query("promotion_gate", "SELECT venue, (rmse - 28) / 28 <= -0.02 AND NOT change >= 0.05 AS promote FROM dd", DECIDE)(lambda spark, d: decided(spark, d).select("venue", "promote"))


CURVED = """cv AS (SELECT t.bucket, realized_vol_10800s AS rv, log_buy_volume_10800s AS vb, CASE WHEN t.bucket // 3600 % 5 <> 0 THEN variance END AS v3, CASE WHEN t.bucket // 3600 % 10 <> 0 THEN variance ELSE -1 END AS old, variance AS v FROM training t JOIN e USING (bucket)),
cs AS (SELECT bucket, CASE WHEN v3 IS NULL THEN l ELSE sqrt(v * 31536000 / 300) END AS sigma_300, greatest(0.01::DOUBLE + 0.5::DOUBLE * rv + 0.001::DOUBLE * vb, 0) AS sigma_900, CASE WHEN v3 IS NULL THEN l ELSE sqrt(v3 * 31536000 / 1800) END AS sigma_1800
  FROM (SELECT *, CASE WHEN old > 0 THEN sqrt(old * 31536000 / 3600) END AS l FROM cv))"""


@query("score_curve", "SELECT *, sigma_1800 AS sigma_3600, CASE WHEN sigma_300 IS NULL THEN 'variance_300' END AS error FROM cs", SYNTHETIC + EWMA + "," + TRAINING + "," + CURVED)
def score_curve(spark, d):
    """A model for one horizon, variances for the others; some rows lack one of these and fall back, and some have nothing to fall back on."""
    h = F.floor(F.col("bucket") / 3600)
    e = X.ewma_variance(returns(spark, d)).select("bucket", "variance")
    rows = matrix(spark, d).join(e, "bucket").withColumns({"v30": F.when(h % 5 != 0, F.col("variance")), "old": F.when(h % 10 != 0, F.col("variance")).otherwise(-1.0)})
    out = M.score_curve(rows, {900: {"intercept": 0.01, INPUTS[0]: 0.5, INPUTS[1]: 0.001}}, {300: "variance", 900: "variance", 1800: "v30"}, ("old", HOUR))
    return out.select("bucket", *[f"sigma_{k}" for k in M.HORIZONS], "error")


# -- quality

CONS = "raw AS (SELECT count(*) FILTER (quantity > 0)::DOUBLE AS cnt_trade, sum(quantity) AS v_trade, sum(quantity) FILTER (taker_side = 'buy') AS v_buy, sum(quantity) FILTER (taker_side = 'sell') AS v_sell FROM deduped), own AS (SELECT sum(cnt_trade)::DOUBLE AS cnt_trade, sum(v_trade) AS v_trade, sum(v_buy) AS v_buy, sum(v_sell) AS v_sell FROM bars)"


@query("conservation_check", " UNION ALL ".join(f"SELECT '{m}' AS measure, raw.{m} AS raw, own.{m} AS bars, abs(raw.{m} - own.{m}) <= 1e-3 + 1e-7 * abs(own.{m}) AS equal FROM raw, own" for m in ("cnt_trade", "v_trade", "v_buy", "v_sell")), BARS + "," + CONS)
def conservation_check(spark, d):
    return Q.conservation(clean(spark, d), hourly(spark, d))


@query("bar_invariants", "SELECT unnest(['high', 'low', 'book', 'fill', 'cadence', 'volume']) AS violation, unnest([count(*) FILTER (p_high < p_close OR p_high < p_open), count(*) FILTER (p_low > p_close OR p_low > p_open), count(*) FILTER (p_bid_1 > p_ask_1), count(*) FILTER (dt_fill_min_ms > dt_fill_mean_ms + 1e-6 OR dt_fill_mean_ms > dt_fill_max_ms + 1e-6), count(*) FILTER (gap <> 3600), count(*) FILTER (abs(v_buy + v_sell - v_trade) > 1e-6)]) AS n FROM (SELECT *, bucket - lag(bucket) OVER (PARTITION BY venue, instrument ORDER BY bucket) AS gap FROM bars)", BARS)
def bar_invariants(spark, d):
    return Q.invariants(flat(hourly(spark, d)), HOUR)


@query("hourly_comparison", "SELECT bucket, coalesce(r.v, 0) - coalesce(b.v, 0) AS delta, r.n AS n_raw FROM (SELECT epoch_us(event_timestamp) // 3600000000 * 3600 AS bucket, sum(quantity) AS v, count(*) AS n FROM trades GROUP BY 1) r FULL JOIN (SELECT bucket, sum(v_trade) AS v FROM bars GROUP BY bucket) b USING (bucket)", BARS)
def hourly_comparison(spark, d):
    raw = flat(trades(spark, d).withColumn("bucket", B.time_bucket("event_timestamp", HOUR)))
    return Q.compare_buckets(raw, flat(hourly(spark, d)), ["bucket"]).select("bucket", "delta", "n_raw")


@query("coverage_report", "SELECT venue, count(DISTINCT day) AS n_days, count(*) AS n_rows, min(day) AS first_day, max(day) AS last_day, max(day) - min(day) + 1 - count(DISTINCT day) AS n_missing FROM (SELECT venue, epoch_us(event_timestamp) // 86400000000 AS day FROM trades WHERE event_id % 3 = 0 AND epoch_us(event_timestamp) // 86400000000 % 5 <> 1) GROUP BY venue")
def coverage_report(spark, d):
    rows = trades(spark, d).where("event_id % 3 = 0").select("venue", F.floor(F.unix_seconds("event_timestamp") / 86400).alias("day")).where("day % 5 <> 1")
    return Q.coverage(rows)


ONLINE = "online AS (SELECT bucket, CASE WHEN bucket // 3600 % 9 = 0 THEN synthetic_price + 1 ELSE synthetic_price END AS p, log_return AS r, venue_count AS n FROM returns WHERE bucket // 3600 % 7 <> 0)"


def online(spark, d):
    h = F.floor(F.col("bucket") / 3600)
    return returns(spark, d).where(h % 7 != 0).withColumn("synthetic_price", F.when(h % 9 == 0, F.col("synthetic_price") + 1).otherwise(F.col("synthetic_price")))


@query("feature_parity", """SELECT *, missing = 0 AND mismatched = 0 AND 30 - missing >= 12 AND NOT stale_online AND NOT stale_offline AS passed FROM (SELECT count(*) FILTER (o.bucket IS NULL) AS missing, count(*) FILTER (p <> synthetic_price) AS mismatched, count(*) FILTER (p = synthetic_price) AS matched,
  any_value(now - last_online > 180) AS stale_online, any_value(now - 100 - last_offline > 10800) AS stale_offline FROM (SELECT *, max(bucket) OVER () + 100 AS now, max(bucket) OVER () AS last_offline FROM returns WHERE synthetic_price IS NOT NULL ORDER BY bucket DESC LIMIT 30) r
  LEFT JOIN online o USING (bucket), (SELECT max(bucket) AS last_online FROM online))""", SYNTHETIC + "," + ONLINE)
def feature_parity(spark, d):
    offline = returns(spark, d)
    now = offline.agg(F.max("bucket")).first()[0] + 100
    return Q.parity(offline, online(spark, d), now=now)


@query("parity_left_join", "SELECT bucket, CASE WHEN p IS NULL THEN 'missing' WHEN abs(p - synthetic_price) > 1e-9 * p THEN 'mismatched' ELSE 'matched' END AS state FROM returns LEFT JOIN online USING (bucket)", SYNTHETIC + "," + ONLINE)
def parity_left_join(spark, d):
    b = online(spark, d).select("bucket", F.col("synthetic_price").alias("p"))
    return returns(spark, d).join(b, "bucket", "left").select("bucket", F.when(F.col("p").isNull(), "missing").when(~Q.close_to(F.col("p"), F.col("synthetic_price"), 1e-9, 1e-10), "mismatched").otherwise("matched").alias("state"))


@query("dataset_profile", "SELECT venue, epoch_us(event_timestamp) // 86400000000 AS day, count(*) AS n, min(price) AS low, max(price) AS high FROM trades GROUP BY ALL")
def dataset_profile(spark, d):
    rows = trades(spark, d).withColumn("day", F.floor(F.unix_seconds("event_timestamp") / 86400))
    return Q.profile(rows, ["venue", "day"], ["price"]).select("venue", "day", "n", F.col("price_min").alias("low"), F.col("price_max").alias("high"))


RUNS = """hs AS (SELECT DISTINCT hour // 3600 AS h, hour FROM quotes),
pl AS (SELECT h, hour, 'resample' AS phase, CASE WHEN h % 2 = 0 THEN 'complete' WHEN h % 9 = 0 THEN 'failed' ELSE 'pending' END AS state FROM hs
  UNION ALL SELECT h, hour, 'features', CASE WHEN h % 4 = 0 THEN 'complete' WHEN h % 2 <> 0 AND h % 9 = 0 THEN 'blocked' ELSE 'pending' END FROM hs
  UNION ALL SELECT h, hour, 'targets', CASE WHEN h % 2 <> 0 AND h % 9 = 0 THEN 'blocked' ELSE 'pending' END FROM hs),
pr AS (SELECT phase, hour, hour // 86400 AS day, hour - 3600 * row_number() OVER (PARTITION BY phase, hour // 86400 ORDER BY hour) AS run FROM pl WHERE state = 'pending')"""


@query("backfill_ranges", "SELECT phase, 'pending' AS state, min(hour) AS start, max(hour) + 3600 AS \"end\", count(*) AS n FROM pr GROUP BY phase, day, run UNION ALL SELECT phase, state, hour, hour + 3600, 1 FROM pl WHERE state IN ('failed', 'blocked')", RUNS)
def backfill_ranges(spark, d):
    """A resumed backfill: ranges of hours that are left, phase by phase, after every ninth hour's first phase has failed."""
    hours = quotes(spark, d).select("hour").distinct()
    h = F.floor(F.col("hour") / 3600)
    done = hours.where(h % 2 == 0).select("hour", F.lit("resample").alias("phase"), F.lit("complete").alias("state")).unionByName(hours.where(h % 4 == 0).select("hour", F.lit("features").alias("phase"), F.lit("complete").alias("state")))
    plan = Q.blocked(Q.backfill_plan(hours, done), hours.where((h % 2 != 0) & (h % 9 == 0)).select("hour", F.lit("resample").alias("phase")))
    rest = plan.where("state IN ('failed', 'blocked')").select("phase", "state", F.col("hour").alias("start"), (F.col("hour") + 3600).alias("end"), F.lit(1).cast("long").alias("n"))
    return Q.ranges(plan).select("phase", F.lit("pending").alias("state"), "start", "end", "n").unionByName(rest)
