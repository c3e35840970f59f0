"""Golden cases of bars, features, books, pricing and models, and a few registered queries against their SQL."""

import glob
import math
import os
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voltide.functions.columns import normal_cdf
from voltide.operators import bars, book, ingest, joins, models, pricing
from voltide.operators.timeseries import carry_scan, halo_window
from voltide.plans import registry


def trades(spark, rows):
    schema = "event_timestamp timestamp, price double, quantity double, taker_side string, venue string, instrument string, trade_id string, received_timestamp timestamp, ingested_at timestamp, source_object string"
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    return spark.createDataFrame([(at(s), p, q, side, "v", "I", str(i), at(s), at(s), None) for i, (s, p, q, side) in enumerate(rows)], schema)


def test_bar_of_two_trades(spark):
    r = bars.trade_bars(trades(spark, [(0, 100.0, 2.0, "buy"), (1, 110.0, 1.0, "sell")]), 10).first()
    assert (r.p_open, r.p_close, r.p_trade_mean, r.v_trade, r.v_buy, r.v_sell, r.cnt_trade, r.dt_fill_mean_ms) == (100, 110, 105, 3, 2, 1, 2, 1000)


def test_empty_bucket_repeats_the_price(spark):
    t = trades(spark, [(0, 100.0, 1.0, "buy"), (2, 102.0, 2.0, "buy")])
    grid = bars.time_grid(t.select(*bars.KEYS).distinct(), bars.bounds_of(t, 1), 1)
    out = bars.forward_fill_bars(grid.join(bars.trade_bars(t, 1), ["bucket", *bars.KEYS], "left")).orderBy("bucket").collect()
    assert [r.p_close for r in out] == [100, 100, 102] and [r.v_trade for r in out] == [1, 0, 2]


def test_repeated_trades_go(spark):
    t = trades(spark, [(0, 1.0, 1.0, "buy")])
    assert bars.dedupe_trades(t.unionByName(t)).count() == 1
    none = t.withColumn("trade_id", F.lit(None).cast("string"))
    assert bars.dedupe_trades(none.unionByName(none)).count() == 2


def test_halo_window_equals_a_global_window(spark):
    df = spark.range(3000).select(F.lit("a").alias("k"), (F.col("id") * 60).alias("t"), F.rand(1).alias("x"))
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("t")
    f = lambda s: F.count("x").over(s.rangeBetween(-3540, 0))
    g = lambda s: F.max("x").over(s.rangeBetween(1, 1800))
    want = {tuple(r) for r in df.select("t", f(w), g(w)).collect()}
    got = {tuple(r) for r in halo_window(df, "t", ["k"], {"f": f, "g": g}, back=3600, ahead=1800, chunk=7200).select("t", "f", "g").collect()}
    assert got == want


@pytest.mark.parametrize("levels", [0, 1])
def test_carry_scan_is_the_recurrence(spark, levels):
    x = np.random.default_rng(2).normal(size=500)
    df = spark.createDataFrame([("a", i * 10, float(v)) for i, v in enumerate(x)], "k string, t long, x double")
    got = [r.y for r in carry_scan(df, "t", ["k"], F.lit(0.9), F.col("x"), "y", chunk=100, levels=levels).orderBy("t").collect()]
    y, want = 0.0, []
    for v in x:
        y = 0.9 * y + v
        want.append(y)
    assert np.allclose(got, want, rtol=1e-12)


def test_normal_cdf(spark):
    xs = [-4, -1.5, -0.1, 0.0, 0.3, 1.0, 3.0]
    got = [r.p for r in spark.createDataFrame([(float(x),) for x in xs], "x double").select(normal_cdf("x").alias("p")).collect()]
    assert np.allclose(got, [0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], atol=2e-7)


def test_ticks_move_away_from_the_mid(spark):
    df = spark.createDataFrame([("bid", 99.9), ("ask", 100.01), ("ask", 100.0)], "side string, price double")
    assert [r.price for r in book.tick_bucket(df, 1.0).collect()] == [99, 101, 100]


def sequential_uncross(bids, asks):
    bids, asks = sorted(([p, q] for p, q in bids), reverse=True), sorted([p, q] for p, q in asks)
    while bids and asks and bids[0][0] >= asks[0][0]:
        q = min(bids[0][1], asks[0][1])
        for side in (bids, asks):
            side[0][1] -= q
            if side[0][1] <= 1e-12:
                side.pop(0)
    return bids, asks


def test_uncross_equals_sequential_netting(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for k in range(60):
        sides = [{float(p): float(rng.integers(1, 6)) for p in rng.choice(range(95, 106), 4, replace=False)} for _ in range(2)]
        rows += [(k, s, p, q, "v") for s, d in zip(("bid", "ask"), sides) for p, q in d.items()]
        b, a = sequential_uncross(sides[0].items(), sides[1].items())
        want[k] = {("bid", p): q for p, q in b} | {("ask", p): q for p, q in a}
    got = {}
    for r in book.uncross(spark.createDataFrame(rows, "k int, side string, price double, quantity double, venue string"), ["k"]).collect():
        got.setdefault(r.k, {})[r.side, r.price] = r.quantity
    assert got == {k: v for k, v in want.items() if v}


def test_fees(spark):
    levels = spark.createDataFrame([("v", "bid", 100.0), ("v", "ask", 100.0)], "venue string, side string, price double")
    assert [r.price for r in book.effective_price(levels, spark.createDataFrame([("v", 0.01)], "venue string, fee double")).collect()] == [99, 101]


def test_quote_edges(spark):
    r = pricing.with_edges(spark.createDataFrame([(0.4, 0.5, 0.6)], "bid double, ask double, model double")).first()
    assert [round(x, 9) for x in (r.mid, r.buy_edge, r.sell_edge)] == [0.45, 0.1, -0.2]


def test_implied_vol_finds_the_volatility(spark):
    tau, sigma, rows = 1800, 0.42, []
    v = sigma * math.sqrt(tau / (365 * 86400))
    for i in range(-3, 4):
        strike = 100 * math.exp(i * 0.001)
        p = 0.5 * math.erfc(-(math.log(100 / strike) / v - v / 2) / math.sqrt(2))
        rows.append(("e", 100.0, strike, p, p, 10, tau))
    quotes = spark.createDataFrame(rows, "e string, spot double, strike double, bid double, ask double, open_interest int, tau int")
    assert abs(pricing.implied_vol(quotes, ["e"]).first().sigma - sigma) < 0.002
    assert pricing.implied_vol(quotes.limit(4), ["e"]).count() == 0


def test_asof_never_sees_the_future(spark):
    left = spark.createDataFrame([("v", 10)], "venue string, at int")
    right = spark.createDataFrame([("v", 9, 99.0), ("v", 10, 100.0), ("v", 11, 101.0)], "venue string, at int, price double")
    assert joins.asof(left, right, ["venue"], "at", ["price"], strict=True).first().price == 99
    assert joins.asof(left, right, ["venue"], "at", ["price"]).first().price == 100


def test_retrain_needs_two_failures(spark):
    rows = spark.createDataFrame([(1.2, 1.0, 1.0, 0, 30000), (1.2, 1.0, 1.0, 1, 30000)], "rmse double, champion_rmse double, benchmark_rmse double, failed_before int, since_training int")
    assert [r.trigger for r in models.retrain_decision(rows).collect()] == [False, True]


def test_har_coefficients_are_not_negative(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    rows = [(*map(float, r), float(0.5 + 2 * r[0] - 1 * r[1])) for r in x]
    w = models.train_har(spark.createDataFrame(rows, "a double, b double, c double, target double"), ["a", "b", "c"])
    assert w["b"] == 0 and w["a"] == pytest.approx(2, abs=0.2)


def test_deltas_rebuild_the_book(spark):
    rows = [("m", 1, "snapshot", "yes", 0.4, 10.0), ("m", 78, "delta", "yes", 0.4, -10.0), ("m", 189, "delta", "yes", 0.5, 3.0), ("m", 189, "delta", "yes", 0.5, 3.0)]
    out = book.apply_book_deltas(spark.createDataFrame(rows, "m string, seq int, kind string, side string, price double, quantity double"), ["m"]).collect()
    assert [(r.price, r.quantity) for r in out] == [(0.5, 3.0)]


def test_a_delta_below_zero_is_refused(spark):
    rows = [("m", 1, "snapshot", "yes", 0.4, 10.0), ("m", 2, "delta", "yes", 0.4, -11.0), ("m", 3, "delta", "yes", 0.4, -4.0), ("m", 4, "delta", "no", 0.2, -1.0)]
    out = book.apply_book_deltas(spark.createDataFrame(rows, "m string, seq int, kind string, side string, price double, quantity double"), ["m"]).collect()
    assert {(r.side, r.quantity, r.rejected) for r in out} == {("yes", 6.0, 1), ("no", 0.0, 1)}


def test_inferred_tick(spark):
    levels = spark.createDataFrame([("a", "bid", 100.25), ("a", "ask", 101.5), ("b", "bid", 7.0)], "venue string, side string, price double")
    assert {r.venue: float(r.tick) for r in book.finest_tick(levels, ["venue"]).collect()} == {"a": 0.01, "b": 1.0}


def test_upsert_and_slices(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in ingest.upsert(a, b, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in ingest.replace_slice(a, b, F.col("k") >= 3).collect()} == {(1, "a"), (2, "b"), (3, "d")}
    assert {tuple(r) for r in ingest.append_dedup(a, b, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_archive_order_across_a_million_ids(spark):
    at = 1_704_067_200_000_000  # microseconds; every other row in milliseconds
    times = {999_998: 5000, 999_999: 9000, 1_000_000: 8000, 1_000_001: 8000, 4_000_000: 7000, 4_000_001: 9000, 5_000_000: 9000}
    rows = [(i, 1.0, 1.0, at + t if i % 2 else (at + t) // 1000, i % 3 == 0) for i, t in times.items()]
    out = ingest.archive_trade_csv(spark.createDataFrame(rows, "id long, price double, qty double, time long, is_buyer_maker boolean"), "V", "I")
    got = {int(r.trade_id): (r.us - at, r.in_order) for r in out.withColumn("us", F.unix_micros("event_timestamp")).collect()}
    late = {1_000_000, 4_000_000}
    assert got == {i: (t, i not in late) for i, t in times.items()}


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def alike(a, b):
    """Equal rows, numbers to one in a million."""
    return len(a) == len(b) and all(math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-9) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b))


def in_order(rows):
    """Rows sorted by what isn't a float first, so that small differences don't move them."""
    return sorted(([normal(v) for v in r] for r in rows), key=lambda r: (str([v for v in r if not isinstance(v, float)]), [v for v in r if isinstance(v, float)]))


@pytest.mark.parametrize("name", ["resample_bars", "asof_book_join", "features_v4", "future_rv", "ewma_variance", "uncross_book", "fresh_venue_spot", "stream_bars"])
def test_queries_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = in_order(df.select(columns).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = in_order(con.sql(f"SELECT {quoted} FROM ({registry.ORACLE_SQL[name]})").fetchall())
    assert len(got) == len(want)
    assert all(alike(a, b) for a, b in zip(got, want)), [p for p in zip(got, want) if not alike(*p)][:3]


def test_means_that_tie_are_rounded_as_exact_numbers(spark, tmp_path):
    from fractions import Fraction

    rng, start = np.random.default_rng(4), 1704067200
    # sixteen prices of three decimals an hour and venue: every eighth mean or so ends in a half of the sixth decimal
    values = [(h, v, int(x)) for h in range(40) for v in ("a", "b") for x in rng.integers(0, 50_000, 16)]
    values += [(40, "a", None), (41, "a", -300_000), (41, "a", -150_001), (42, None, 5), (42, "b", 7), (43, "a", None), (43, "b", "inf"), (43, "c", 9)]
    rows = [(i, start + 3600 * h + i % 3600, v, float(x) if isinstance(x, str) else None if x is None else x / 100) for i, (h, v, x) in enumerate(values)]
    events = spark.createDataFrame(rows, "event_id long, s long, event_type string, value double").orderBy(F.xxhash64("event_id"))
    events.select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), F.lit(2).cast("long").alias("user_id"), "event_type", "value", F.lit('{"k": 1}').alias("props")).coalesce(1).write.parquet(str(tmp_path / "x"))
    os.rename(glob.glob(f"{tmp_path}/x/*.parquet")[0], tmp_path / "events.parquet")
    got = {r.bucket: r.venue_prices for r in registry.QUERIES["venue_prices_map"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert got == dict(con.sql(registry.ORACLE_SQL["venue_prices_map"]).fetchall())
    want = {}
    for h in range(40):
        of = {v: Fraction(sum(100_000 + x for hour, venue, x in values if (hour, venue) == (h, v)), 16_000) for v in ("a", "b")}
        want[start + 3600 * h] = ",".join(f"{v}={(Decimal(m.numerator) / m.denominator).quantize(Decimal('0.000001'), ROUND_HALF_UP)}" for v, m in of.items())
    late = {start + 3600 * h: shown for h, shown in ((40, None), (41, "a=-125.000500"), (42, "b=100.007000"), (43, "c=100.009000"))}
    assert got == want | late


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_staged_events_switch_on_their_first_message(spark):
    staged = spark.createDataFrame([("s", "A", 0), ("s", "B", 10), ("s", "C", 30), ("s", "D", 35)], "series string, event_ticker string, at int")
    messages = [("s", "A", 5), ("s", "A", 12), ("s", "B", 15), ("s", "A", 16), ("s", "B", 31), ("s", "C", 36), ("s", "D", 40), ("s", "B", 41), ("s", "X", 42)]
    out = pricing.rollover(staged, spark.createDataFrame(messages, "series string, event_ticker string, at int")).orderBy("at").collect()
    # A stays accepted while B waits; C was replaced by D before it said anything
    assert [r.accepted for r in out] == [True, True, True, False, True, False, True, False, False]
    assert [r.active for r in out] == ["A", "A", "B", "B", "B", "B", "D", "D", "D"] and out[-1].generation == 3


def test_several_curves_need_their_times(spark):
    tickers = spark.createDataFrame([("e", "m", 0.4, 0.5, 100, 50.0)], "event_ticker string, market_ticker string, bid double, ask double, quoted_at long, spot double")
    meta = spark.createDataFrame([("e", "m", 50.0, 400, "active")], "event_ticker string, market_ticker string, strike double, expiry long, status string")
    curves = spark.createDataFrame([(0, 0.3, 0.3, 0.3, 0.3), (90, 0.6, 0.6, 0.6, 0.6), (200, 0.9, 0.9, 0.9, 0.9)], "feature_at long, sigma_300 double, sigma_900 double, sigma_1800 double, sigma_3600 double")
    assert pricing.price_contracts(tickers, meta, curves, F.lit(100)).first().sigma == 0.6
    with pytest.raises(Exception, match="several rows"):
        pricing.price_contracts(tickers, meta, curves.drop("feature_at"), F.lit(100)).collect()


def test_asof_looks_back_over_chunks(spark):
    left = spark.createDataFrame([("v", 10 * 86_400 + 5), ("w", 5)], "venue string, at long")
    right = spark.createDataFrame([("v", 3, 1.0), ("v", 86_400 + 1, 2.0), ("v", 11 * 86_400, 3.0)], "venue string, at long, price double")
    assert {r.venue: r.price for r in joins.asof(left, right, ["venue"], "at", ["price"]).collect()} == {"v": 2.0, "w": None}


def test_frames_of_several_trades(spark):
    from voltide.operators import frames

    rows = [("bybit", 1, '{"topic":"publicTrade.X","data":[{"s":"x","i":"1","p":"2","v":"3","T":4,"S":"Buy"},{"s":"x","i":"2","p":"2","v":"3","T":5,"S":"Sell"}]}'), ("kraken", 1, '{"channel":"trade","data":[]}'), ("other", 1, "{}"), ("gemini", 1, '{"s":"X","t":7,"p":"1","q":"1","E":1700000000000000000}')]
    out = frames.normalize_trade_frames(spark.createDataFrame(rows, "venue string, received_ts_ms long, raw string")).collect()
    assert sorted((r.venue, r.trade_id, r.taker_side, r.error) for r in out if r.venue == "bybit") == [("bybit", "1", "buy", None), ("bybit", "2", "sell", None)]
    assert {r.venue for r in out} == {"bybit", "gemini"}
    assert [r.exchange_ts_ms for r in out if r.venue == "gemini"] == [1_700_000_000_000]
