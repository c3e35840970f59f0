"""State carried over time: scans, lakes with versions, books message by message, live features, pricing and archives."""

import datetime
import glob
import math
import os
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from voltide.operators import book, frames, ingest, joins, pricing, quality, running_book
from voltide.operators.running_book import CONTRACT_SIDES, VENUE_SIDES, Book, StreamingBook, running_books, stream_books
from voltide.operators.timeseries import affine, carry_scan, previous
from voltide.plans import streams
from voltide.plans.streams import in_runs
from voltide.sources import lake
from voltide.streaming import bars as S
from voltide.streaming.features import live_bar_errors, stream_features
from voltide.streaming.pricing import stream_pricing, stream_rollover

# scans


def test_affine_equals_the_loop():
    rng = np.random.default_rng(1)
    a, b, y, want = rng.uniform(0, 1.1, 777), rng.normal(size=777), 3.0, []
    a[[0, 100, 500]] = 0.0
    for x, z in zip(a, b):
        y = x * y + z
        want.append(y)
    assert np.allclose(affine(a, b, 3.0), want, rtol=1e-12)


def test_carry_scan_over_keys_ranges_and_nulls(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("k"), (F.col("id") * 10).alias("t"), F.randn(3).alias("x"), F.lit("kept").alias("y_")).repartition(5).cache()
    got = carry_scan(df, "t", ["k"], F.lit(0.9), F.col("x"), "y", first=F.lit(100.0), before="was").collect()
    assert len(got) == 3000
    for k in (None, "1", "2"):
        y = None
        for r in sorted((r for r in got if r.k == k), key=lambda r: r.t):
            assert (r.was is None) if y is None else math.isclose(r.was, y, rel_tol=1e-9)
            y = 100.0 if y is None else 0.9 * y + r.x
            assert math.isclose(r.y, y, rel_tol=1e-9) and r.y_ == "kept"
    assert carry_scan(df.limit(0), "t", ["k"], F.lit(1.0), F.col("x"), "y").count() == 0


def test_carry_scan_reads_its_input_once(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("t"), F.lit("a").alias("k"), F.rand().alias("x")).write.parquet(str(tmp_path / "in"))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.read.parquet(str(tmp_path / "in"))
    assert carry_scan(rows.mapInArrow(counted, rows.schema), "t", ["k"], F.lit(1.0), F.col("x"), "y").count() == 100
    assert seen.value <= 200  # once to choose the ranges, once for the rows


def test_previous_crosses_chunks_and_keeps_nulls(spark):
    df = spark.createDataFrame([("a", 5, 1), ("a", 90_000, None), ("a", 90_000, 3), ("a", 500_000, 4), ("b", 7, 9)], "k string, t long, v long")
    got = previous(df, "t", ["k"], {"was": F.col("v"), "at": F.col("t")}, ties=("v",)).collect()
    assert sorted((r.k, r.t, r.v or 0, r.was, r["at"]) for r in got) == [("a", 5, 1, None, None), ("a", 90_000, 0, 1, 5), ("a", 90_000, 3, None, 90_000), ("a", 500_000, 4, 3, 90_000), ("b", 7, 9, None, None)]


# the lake


def hours(spark, rows):
    return spark.createDataFrame(rows, "date string, hour string, venue string, price double")


def test_scan_of_one_hour_is_that_hour(spark, tmp_path):
    rows = hours(spark, [(f"2024-01-0{1 + h // 24}", f"{h % 24:02}", "v", float(h)) for h in range(48)])
    lake.write_hive(rows, str(tmp_path / "lake"), ["date", "hour"])
    of = lambda a, b: sorted(r.price for r in lake.scan_partitioned(spark, str(tmp_path / "lake"), a, b).collect())
    assert of("2024-01-01 20", "2024-01-01 20") == [20.0]
    assert of("2024-01-01 22", "2024-01-02 01") == [22.0, 23.0, 24.0, 25.0] and of("2024-01-02", "2024-01-02") == [float(h) for h in range(24, 48)]
    with pytest.raises(ValueError):
        lake.scan_partitioned(spark, str(tmp_path / "lake"), "2025-01-01", "2025-01-01")


def test_touched_keeps_rows_of_null_keys(spark):
    old = spark.createDataFrame([("d1", "v", 1.0), ("d1", None, 2.0), (None, "v", 3.0), ("d2", "v", 4.0)], "date string, venue string, price double")
    new = spark.createDataFrame([("d1", "v", 9.0)], old.schema)
    got = lake.touched(new, old, ["date"], (F.col("date") == "d1") & (F.col("venue") == "v"))
    assert sorted((r.venue or "", r.price) for r in got.collect()) == [("", 2.0), ("v", 9.0)]


def test_a_failed_replacement_leaves_the_old_rows(spark, tmp_path):
    table = lake.AtomicTable(spark, str(tmp_path / "t"), ["date"], ["price"])
    first = hours(spark, [("d1", "0", "v", 1.0), ("d2", "0", "v", 2.0)])
    assert table.replace_partitions(first) == 1
    prices = lambda t: sorted(r.price for r in t.read().collect())
    # the write ends, the switch never comes
    version, folders = table.stage(hours(spark, [("d1", "0", "v", 10.0)]))
    assert prices(table) == [1.0, 2.0] and version == 2
    # the write itself fails
    broken = hours(spark, [("d1", "0", "v", 10.0)]).withColumn("price", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception):
        table.replace_partitions(broken)
    assert prices(table) == [1.0, 2.0]
    # another writer is first
    assert table.replace_partitions(hours(spark, [("d1", "0", "v", 20.0)])) == 2
    with pytest.raises(RuntimeError):
        table.switch(version, folders, first.schema)
    assert prices(table) == [2.0, 20.0] and sorted(r.price for r in table.read(1).collect()) == [1.0, 2.0]
    assert table.vacuum() >= 2 and prices(table) == [2.0, 20.0]


def test_a_slice_is_replaced_in_one_step(spark, tmp_path):
    table = lake.AtomicTable(spark, str(tmp_path / "t"), ["date", "hour"])
    table.replace_partitions(hours(spark, [("d1", "0", "v", 1.0), ("d1", "0", "w", 2.0), ("d1", "1", "v", 3.0), ("d2", "0", None, 4.0)]))
    kept = [f for f in table.manifest()["folders"] if "date=d2" in f]
    table.replace_slice(hours(spark, [("d1", "0", "v", 9.0), ("d2", "0", "x", 8.0)]), F.col("venue") == "v")
    assert sorted((r.date, r.hour, r.venue or "", r.price) for r in table.read().collect()) == [("d1", "0", "v", 9.0), ("d1", "0", "w", 2.0), ("d2", "0", "", 4.0)]
    assert [f for f in table.manifest()["folders"] if "date=d2" in f] == kept  # not rewritten


# books


def messages(spark, rows, key="m"):
    schema = "key string, at long, sequence long, kind string, levels array<struct<side: string, price: string, quantity: string>>"
    return spark.createDataFrame([(key, i, *r) for i, r in enumerate(rows)], schema)


GOLDEN = [
    ("delta", 5, [("yes", "0.4", "1")]), ("snapshot", 78, [("yes", "0.40", "10"), ("no", "0.55", "3")]), ("delta", 189, [("yes", "0.4", "-10")]),
    ("delta", 188, [("yes", "0.4", "5")]), ("delta", 189, [("no", "0.55", "5")]), ("delta", 190, [("no", "0.55", "-4")]), ("delta", 190, [("no", "0.55", "2")]), ("delta", 191, None),
    ("delta", 192, [("no", "x", "2")]), ("snapshot", 10, [("yes", "0.1", "-1")]), ("delta", 193, [("up", "0.5", "2")]), ("snapshot", 3, [("yes", "0.2", "7"), ("yes", "0.30", "0")]), ("delta", 4, [("yes", "0.2", "0.5")]),
]
REASONS = ["before_snapshot", None, None, "stale", "stale", "negative", None, "incomplete", "number", "negative", "incomplete", None, None]


def test_contract_book_golden_case(spark):
    rows = messages(spark, [(sequence, kind, levels) for kind, sequence, levels in GOLDEN])
    got = sorted(running_books(rows, ["key"], "at", True, CONTRACT_SIDES).collect(), key=lambda r: r["at"])
    assert [r.reason for r in got] == REASONS
    assert [[(x.price, x.quantity) for x in r.yes] for r in got[1:3]] == [[("0.40", "10")], []]
    assert [(x.price, x.quantity) for x in got[9].no] == [("0.55", "5")]  # a refused snapshot leaves the book
    assert [(x.price, x.quantity) for x in got[12].yes] == [("0.2", "7.5")] and got[12].no == []


def replay(rows, depth):
    """The book after each message by plain dictionaries."""
    sides, out = {"bid": {}, "ask": {}}, []
    for _, kind, levels in rows:
        if kind == "snapshot":
            sides = {"bid": {}, "ask": {}}
        for side, p, q in levels:
            sides[side][Decimal(p)] = Decimal(q)
            if not Decimal(q):
                del sides[side][Decimal(p)]
        out.append((sorted(sides["bid"].items(), reverse=True)[:depth], sorted(sides["ask"].items())[:depth]))
    return out


def random_messages(n, seed):
    rng = np.random.default_rng(seed)
    level = lambda: (["bid", "ask"][rng.integers(2)], str(rng.integers(90, 110) / 10), str(rng.integers(0, 4)))
    return [(i + 1, "snapshot" if rng.random() < 0.03 else "delta", [level() for _ in range(rng.integers(0, 5))]) for i in range(n)]


def books_of(rows):
    side = lambda levels: [(Decimal(x.price), Decimal(x.quantity)) for x in levels]
    return {(r.key, r["at"]): (side(r.bid), side(r.ask)) for r in rows}


def test_running_books_equal_a_replay(spark):
    sent = {f"k{s}": random_messages(300, s) for s in range(3)}
    rows = None
    for key, m in sent.items():
        part = messages(spark, m, key)
        rows = part if rows is None else rows.unionByName(part)
    got = books_of(running_books(rows.repartition(5), ["key"], "at", False, depth=4).collect())
    assert got == {(key, i): book for key, m in sent.items() for i, book in enumerate(replay(m, 4))}


def test_books_of_a_stream_equal_those_of_a_table(spark):
    rows = messages(spark, random_messages(120, 7))
    parts = [rows.where("at < 50"), rows.where("at >= 50")]
    got = in_runs(spark, "test-books", parts, lambda r: stream_books(r, ["key"], "at", False))
    assert books_of(got.collect()) == books_of(running_books(rows, ["key"], "at", False).collect())


def test_books_of_a_stream_in_portions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "folder", lambda spark, name: str(tmp_path))
    rows = messages(spark, random_messages(90, 8), "a").unionByName(messages(spark, random_messages(120, 9), "b")).repartition(7)
    parts = [rows.where("at < 50"), rows.where("at >= 50"), rows.where("at < 0")]
    got = in_runs(spark, "test-portions", parts, lambda r: stream_books(r, ["key"], "at", False), order="at", portion=20).collect()
    assert len(got) == 210 and books_of(got) == books_of(running_books(rows, ["key"], "at", False).collect())
    seen = [[r["at"] for r in spark.read.parquet(f).collect()] for f in sorted(glob.glob(f"{tmp_path}/in/*/*/*.parquet"))]
    assert max(map(len, seen)) <= 30 and sum(map(len, seen)) == 210
    # a number lies in one file, files follow in order, and each is a micro-batch of its own
    filled = [s for s in seen if s]
    assert all(max(a) < min(b) for a, b in zip(filled, filled[1:]))
    assert len(glob.glob(f"{tmp_path}/state/commits/[0-9]*")) >= len(filled) >= 10


def test_a_book_of_a_stream_goes_out_in_frames():
    import pandas as pd

    class State:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    sent = random_messages(2500, 10)
    levels = lambda m: [dict(zip(("side", "price", "quantity"), x)) for x in m[2]]
    frame = pd.DataFrame({"at": range(2500), "sequence": [m[0] for m in sent], "kind": [m[1] for m in sent], "levels": [levels(m) for m in sent]})
    step = StreamingBook("at", False, VENUE_SIDES, 3, ["key", "at", "sequence", "reason", "bid", "ask"])
    step.state = State()
    out = list(step.handleInputRows(("k",), iter([frame[1700:], frame[:1700]]), None))
    assert [len(f) for f in out] == [1000, 1000, 500]
    number = lambda side: [(Decimal(x["price"]), Decimal(x["quantity"])) for x in side]
    assert [(number(r.bid), number(r.ask)) for f in out for r in f.itertuples()] == replay(sent, 3) and step.state.value[0] == 2500


def test_one_book_of_a_stream_is_made_in_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "folder", lambda spark, name: str(tmp_path))
    monkeypatch.setattr(running_book, "BLOCK", 20, raising=False)
    rows = messages(spark, random_messages(400, 11)).repartition(3)
    got = in_runs(spark, "test-tasks", [rows.where("at < 300"), rows.where("at >= 300")], lambda r: stream_books(r, ["key"], "at", False)).collect()
    assert len(got) == 400 and books_of(got) == books_of(running_books(rows, ["key"], "at", False).collect())
    tasks = [spark.read.parquet(f).count() for f in glob.glob(f"{tmp_path}/out/*.parquet")]
    assert sum(tasks) == 400 and max(tasks) <= 200 and len([n for n in tasks if n]) > 2  # of two micro-batches


@pytest.mark.parametrize("signed", [False, True])
def test_books_of_a_stream_in_blocks_equal_a_plain_loop(spark, monkeypatch, signed):
    monkeypatch.setattr(running_book, "BLOCK", 5, raising=False)
    rng, sent = np.random.default_rng(12), {}
    text = lambda x: {0: None, 1: "x", 2: "-1", 3: "0.0", 4: "1e1"}.get(x, f"{x / 10}")
    for key in (("a", 1), ("a", None), ("b", 1)):
        level = lambda: None if rng.random() < 0.02 else (["bid", "ask", "up", None][rng.choice(4, p=[0.49, 0.49, 0.01, 0.01])], text(rng.integers(20, 30)), text(rng.integers(0, 60)))
        sequence = lambda i: [None, 2**53 + i, i - 3][rng.choice(3, p=[0.1, 0.8, 0.1])]
        sent[key] = [(sequence(i), [None, "snapshot", "delta"][rng.choice(3, p=[0.02, 0.08, 0.9])], None if rng.random() < 0.03 else [level() for _ in range(rng.integers(0, 4))]) for i in range(150)]
    schema = "key string, k2 int, at int, sequence long, kind string, levels array<struct<side: string, price: string, quantity: string>>"
    rows = spark.createDataFrame([(*key, 3 * i, *m) for key, own in sent.items() for i, m in enumerate(own)], schema).repartition(3)
    parts = [rows.where("at < 200"), rows.where("at >= 200")]
    got = in_runs(spark, "test-blocks", parts, lambda r: stream_books(r, ["key", "k2"], "at", signed, depth=2), order="at", portion=200).collect()
    want = {}
    for key, own in sent.items():
        held = Book(signed, VENUE_SIDES)
        for i, (n, kind, levels) in enumerate(own):
            reason = held.apply(kind, n, None if levels is None else [x or (None, None, None) for x in levels])
            want[(*key, 3 * i)] = (n, reason, *[list(zip(*side)) for side in held.best(2)])
    assert len(got) == 450 and {(r.key, r.k2, r["at"]): (r.sequence, r.reason, [tuple(x) for x in r.bid], [tuple(x) for x in r.ask]) for r in got} == want
    assert len({x[1] for x in want.values()}) >= 4


def test_levels_are_in_order_of_price_and_keep_their_first_text():
    held = Book(True, VENUE_SIDES)
    assert held.apply("snapshot", 1, [("bid", "1.50", "2"), ("bid", "0.9", "1"), ("ask", "3", "1e1"), ("ask", "2", "0"), ("bid", "10", "4.0")]) is None
    assert held.best(2) == [[["10", "1.50"], ["4.0", "2"]], [["3"], ["10"]]] and held.best(0) == [[[], []], [[], []]]
    assert held.apply("delta", 2, [("bid", "1.5", "-0.5"), ("ask", "3.0", "-10"), ("bid", "1.500", "0.25")]) is None
    assert held.best(9) == [[["10", "1.50", "0.9"], ["4.0", "1.75", "1"]], [[], []]]
    again = Book(True, VENUE_SIDES, *held.whole())
    assert again.best(9) == held.best(9) and again.last == 2 and again.apply("delta", 2, [("bid", "1", "1")]) == "stale"


def test_contract_books_of_a_stream_golden_case(spark):
    rows = messages(spark, [(sequence, kind, levels) for kind, sequence, levels in GOLDEN])
    got = in_runs(spark, "test-contract", [rows.where("at < 4"), rows.where("at >= 4")], lambda r: stream_books(r, ["key"], "at", True, CONTRACT_SIDES))
    assert [r.reason for r in sorted(got.collect(), key=lambda r: r["at"])] == REASONS


def test_of_two_deltas_of_one_sequence_the_first_counts(spark):
    rows = [("m", 1, "snapshot", "yes", 0.4, 5.0), ("m", 2, "delta", "yes", 0.4, 3.0), ("m", 2, "delta", "yes", 0.5, 3.0)]
    got = {(r.side, r.price): (r.quantity, r.rejected) for r in book.apply_book_deltas(spark.createDataFrame(rows, "key string, seq long, kind string, side string, price double, quantity double").replace({"yes": "bid"}, subset=["side"]), ["key"]).collect()}
    assert got == {("bid", 0.4): (8.0, 0), ("bid", 0.5): (0.0, 1)}


@pytest.mark.parametrize("level", ['["x", "1"]', '["1", "NaN"]', '["1", "-1"]', '["1"]', "null", '["1", "Infinity"]'])
def test_a_bad_level_refuses_its_book_alone(spark, level):
    raw = '{"s": "syn", "lastUpdateId": 7, "bids": [["1", "2"]], "asks": [["3", "1"], %s]}'
    rows = spark.createDataFrame([("gemini", 1, raw % level), ("gemini", 1, raw % '["4", "1"]')], "venue string, received_ts_ms long, raw string")
    assert sorted(r.error or "" for r in frames.normalize_book_frames(rows).collect()) == ["", "levels"]


# live features

BAR = 10


def live(spark, parts, **how):
    schema = "asset string, venue string, bucket long, price double, v_buy double"
    frames_ = [spark.createDataFrame([("A", v, b, p, q) for v, b, p, q in rows], schema) for rows in parts]
    out = in_runs(spark, "test-live", frames_, lambda rows: stream_features(rows, BAR, [30], [30], complete=False, **how))
    return sorted(out.collect(), key=lambda r: (r.bucket, r["venue"] or "" if "venue" in r else ""))


def test_windows_over_a_gap_are_null_until_it_is_behind(spark):
    buckets = [0, 10, 20, 30, 40, 1000, 1010, 1020, 1030, 1040]
    rows = live(spark, [[("v", b, 100.0 + k, 2.0) for k, b in enumerate(buckets[:5])], [("v", b, 105.0 + k, 2.0) for k, b in enumerate(buckets[5:])]])
    full = [b for b in (r.bucket for r in rows if r.realized_vol_30s is not None and not math.isnan(r.realized_vol_30s))]
    assert [r.bucket for r in rows] == buckets[:-1] and full == [30, 40, 1030]
    assert [r.bucket for r in rows if r.log_buy_volume_30s is not None and not math.isnan(r.log_buy_volume_30s)] == [20, 30, 40, 1020, 1030]
    assert math.isclose(rows[-1].log_return, math.log(108 / 107))


def test_late_venue_changes_nothing_and_is_told(spark):
    first = [("v", 0, 100.0, 1.0), ("w", 0, 102.0, 1.0), ("v", 10, 102.0, 1.0), ("v", 20, 103.0, 1.0)]
    late = [("w", 10, 999.0, 1.0), ("v", 25, 1.0, 1.0), ("w", 20, float("nan"), 1.0), ("w", 30, 104.0, -1.0), ("v", 30, 104.0, 1.0)]
    rows = live(spark, [first, late], refused=True)
    assert sorted((r.bucket, r.venue, r.refused) for r in rows if r.refused) == [(10, "w", "out_of_order"), (20, "w", "price"), (25, "v", "misaligned"), (30, "w", "volume")]
    kept = [r for r in rows if not r.refused]
    assert [(r.bucket, r.synthetic_price, r.venue_count) for r in kept] == [(0, 101.0, 2), (10, 102.0, 1), (20, 103.0, 1)]
    assert math.isclose(kept[1].log_return, math.log(102 / 101))


def test_sampled_variance_by_horizon_is_the_one_before(spark):
    prices = [100.0, 101.0, 103.0, 102.0, 99.0, 100.0, 104.0, 105.0, 103.0]
    rows = live(spark, [[("v", 10 * k, p, 1.0) for k, p in enumerate(prices[:4])], [("v", 10 * (k + 4), p, 1.0) for k, p in enumerate(prices[4:])]], horizons=(20,))
    want, price, variance = [], None, None
    for k, p in enumerate(prices[:-1]):
        want.append(variance)
        if (10 * k + 10) % 20 == 0:
            if price:
                r = math.log(p / price) ** 2
                variance = r if variance is None else 0.96 * variance + 0.04 * r
            price = p
    assert all((w is None and (r.variance_20s is None or math.isnan(r.variance_20s))) or math.isclose(w, r.variance_20s) for w, r in zip(want, rows))


def test_bars_that_cannot_be_live_have_a_reason(spark):
    rows = [("v", 100, "1.5", "2"), (" ", 100, "1", "1"), ("v", 105, "1", "1"), ("v", 20, "1", "1"), ("v", 100, "abc", "1"), ("v", 100, "0", "1"), ("v", 100, "1", None)]
    got = live_bar_errors(spark.createDataFrame(rows, "venue string, bucket long, price string, v_buy string"), 10, 60, F.lit(120)).collect()
    assert [r.error for r in got] == [None, "venue", "misaligned", "stale", "price", "price", "volume"] and got[0].price == 1.5


# pricing and rollover on streams


def priced(spark, parts, **how):
    kinds = {"series": "string", "kind": "string", "at": "long", "market_ticker": "string", "event_ticker": "string", "bid": "double", "ask": "double", "quoted_at": "long", "strike": "double", "expiry": "long", "status": "string", "spot": "double", "feature_at": "long", "sigma_300": "double", "sigma_900": "double", "sigma_1800": "double", "sigma_3600": "double"}
    rows = [spark.createDataFrame([tuple(r.get(k) for k in kinds) for r in part], ", ".join(f"{k} {t}" for k, t in kinds.items())) for part in parts]
    return in_runs(spark, "test-pricing", rows, lambda r: stream_pricing(r, **how)).collect()


def ticker(at, market="M1", **more):
    return {"series": "S", "kind": "ticker", "at": at, "market_ticker": market, "event_ticker": "E", "bid": 0.4, "ask": 0.5, "quoted_at": at, "strike": 100.0, "expiry": 3000, "status": "active"} | more


def spot(at, value):
    return {"series": "S", "kind": "spot", "at": at, "spot": value}


def curve(at, feature_at, sigma=0.4):
    return {"series": "S", "kind": "curve", "at": at, "feature_at": feature_at} | {f"sigma_{h}": sigma for h in (300, 900, 1800, 3600)}


def test_late_curve_lost_spot_and_expiry_take_prices_back(spark):
    rows = priced(spark, [
        [ticker(1000), ticker(1000, "M2", strike=None), spot(1000, 100.0), curve(1000, 990)],
        [curve(1001, 980, 9.0)],  # of an earlier time: it changes nothing, and the cycle prices again
        [ticker(1100, "M3")],  # the spot is too old by now
        [spot(1101, 101.0), curve(1101, 1100)],
        [curve(1102, 1102, None), spot(1102, 101.0)],
        [spot(3000, 101.0), curve(3000, 2990)],
        [spot(3001, 101.0)],
    ])
    by = {}
    for r in sorted(rows, key=lambda r: (r["at"], r.market_ticker)):
        by.setdefault(r["at"], {})[r.market_ticker] = (r.reason, r.sigma, r.model)
    assert by[1000]["M1"][0] is None and by[1000]["M2"][0] == "no_metadata" and abs(by[1000]["M1"][2] - 0.5) < 1e-6
    assert by[1001]["M1"][:2] == (None, 0.4) and "M2" not in by[1001]
    assert {m: x[0] for m, x in by[1100].items()} == {"M1": "stale_spot", "M3": "stale_spot"} and by[1100]["M1"][2] is None
    assert {m: x[0] for m, x in by[1101].items()} == {"M1": None, "M3": None}
    assert {m: x[0] for m, x in by[1102].items()} == {"M1": "bad_curve", "M3": "bad_curve"}
    assert 3000 not in by and 3001 not in by  # expired, with no price out


def test_a_published_contract_that_expires_is_taken_back_once(spark):
    rows = priced(spark, [[ticker(2999), spot(2999, 100.0), curve(2999, 2990)], [spot(3000, 100.0)], [spot(3001, 100.0)]], curve_age=None)
    assert sorted((r["at"], r.reason) for r in rows if r["at"] > 2999) == [(3000, "expired")]


def test_rollover_of_a_stream_golden_case(spark):
    rows = [("message", "E1", 0), ("staged", "E1", 1), ("message", "E1", 2), ("staged", "E2", 3), ("message", "E1", 4), ("message", "E2", 5), ("message", "E1", 6), ("staged", "E2", 7), ("staged", "E3", 8), ("staged", "E4", 9), ("message", "E3", 10), ("message", "E4", 11)]
    df = spark.createDataFrame([("S", e, at, kind) for kind, e, at in rows], "series string, event_ticker string, at long, kind string")
    got = in_runs(spark, "test-roll", [df.where("at < 5"), df.where("at >= 5")], stream_rollover).collect()
    seen = [(r["at"], r.event_ticker, r.accepted, r.active, r.generation, r.ended) for r in sorted(got, key=lambda r: (r["at"], r.event_ticker))]
    assert seen == [(0, "E1", False, "", 0, None), (2, "E1", True, "E1", 1, None), (4, "E1", True, "E1", 1, None), (5, "E2", True, "E2", 2, "E1"), (6, "E1", False, "E2", 2, None), (10, "E3", False, "E2", 2, None), (11, "E4", True, "E4", 3, "E2")]
    # the same by the batch form
    batch = pricing.rollover(df.where("kind = 'staged'").drop("kind"), df.where("kind = 'message' AND at <> 4").drop("kind")).collect()
    assert {(r["at"], r.event_ticker): (r.accepted, r.active, r.generation) for r in batch} == {(a, e): (x, y, z) for a, e, x, y, z, _ in seen if a != 4}


def test_a_replayed_archive_batch_leaves_its_files(spark, tmp_path):
    columns = sorted({c for own, path in S.KINDS.values() for c in (*own, *path)} - {"event_id", "received_ts_ms", "exchange_ts_ms"})
    rows = spark.range(40).select(F.get(F.array(*map(F.lit, [*S.KINDS, "other"])), (F.col("id") % 6).cast("int")).alias("kind"), F.col("id").alias("event_id"), F.lit(None).cast("long").alias("exchange_ts_ms"), (F.col("id") * 1000).alias("received_ts_ms"), F.when(F.col("id") == 0, "price").alias("error"), *[F.lit("a b").alias(c) for c in columns])
    root = str(tmp_path / "archive")
    files = lambda: sorted(glob.glob(f"{root}/**/*.parquet", recursive=True))
    S.archive_batch(rows, root, "q", 0, most=3)
    first = files()
    S.archive_batch(rows, root, "q", 0, most=3)
    assert files() == first and any("/venue=a_b/instrument=a_b/date=1970-01-01/hour=00/" in f for f in first)
    counts = {kind: spark.read.parquet(f"{root}/{kind}").count() for kind in (*S.KINDS, "dead")}
    assert counts == {"trade": 6, "book": 7, "contract_ticker": 7, "contract_trade": 7, "contract_book": 6, "dead": 7}
    assert all(spark.read.parquet(f).count() <= 3 for f in first if "/dead/" not in f)
    # a part that broke off is written again
    os.remove(f"{root}/trade/batch=q-0/_SUCCESS")
    S.archive_batch(rows, root, "q", 0, most=3)
    assert spark.read.parquet(f"{root}/trade").count() == 6 and [f for f in files() if "/trade/" not in f] == [f for f in first if "/trade/" not in f]


# operators that were plans before


def test_training_sets_are_refused_with_a_reason(spark):
    rows = spark.createDataFrame([(1, 1.0, None, "10s"), (2, float("nan"), 2.0, "10s")], "bucket long, a double, b double, frequency string")
    assert ingest.validate_training(rows, ["a", "b"], frequencies=["10s"]) is rows
    for bad, targets, frequencies, text in (
            (rows, ["a", "c"], None, "no c"), (rows.limit(0), ["a"], None, "empty"), (rows.withColumn("bucket", F.when(F.col("bucket") > 1, F.col("bucket"))), ["a"], None, "without a time"),
            (rows.where("bucket = 2"), ["a"], None, "usable row of a"), (rows, ["a"], ["1m"], "lacks 1m"), (rows.drop("frequency"), ["a"], ["10s"], "no frequency")):
        with pytest.raises(ValueError, match=text):
            ingest.validate_training(bad, targets, frequencies=frequencies)


def test_envelopes_both_ways(spark):
    fields = {"log_return": "double", "venue_count": "long"}
    rows = spark.createDataFrame([("A", 1000, 1010, 0.5, 3), ("A", 2000, 2010, None, 4)], "asset string, bucket long, available long, log_return double, venue_count long")
    text = ingest.envelope(rows, fields, "v4")
    got = [tuple(r) for r in ingest.flatten_envelope(text, fields, "v4").orderBy("bucket").collect()]
    assert got == [("A", 1000, 1010, 1010, 0.5, 3, None), ("A", 2000, 2010, 2010, None, 4, None)]
    iso = text.withColumn("envelope", F.regexp_replace("envelope", '"event_timestamp_ms":[0-9]+,', ""))
    assert [r.bucket for r in ingest.flatten_envelope(iso, fields, "v4").orderBy("bucket").collect()] == [1000, 2000]
    bad = spark.createDataFrame([("{",), (None,), ('{"feature_set": "x"}',), ('{"feature_set": "market_features", "feature_version": "v4", "event_timestamp_ms": 5, "asset": "A", "values": {"log_return": "x", "venue_count": 1}}',), ('{"feature_set": "market_features", "feature_version": "v4", "event_timestamp_ms": 5, "entity": {"asset": "A"}, "values": {"log_return": 1}}',)], "envelope string")
    assert [r.error for r in ingest.flatten_envelope(bad, fields, "v4").collect()] == ["json", "json", "feature_set", "type:log_return", "missing:venue_count"]


def test_state_and_metadata_joins(spark):
    rows = spark.createDataFrame([("a", 100), ("b", 200), ("c", 97)], "market_ticker string, at long")
    state = spark.createDataFrame([(90, 1.0), (99, 2.0)], "t long, price double")
    assert [r.price for r in joins.latest_state(rows, state, "at", "t", ["price"]).orderBy("market_ticker").collect()] == [2.0, None, 2.0]
    assert [r.price for r in joins.latest_state(rows, state.limit(0), "at", "t", ["price"]).collect()] == [None] * 3
    meta = spark.createDataFrame([("E", "a", 1.0, "active", 1), ("E", "a", 2.0, "settled", 2), ("E", "b", 3.0, "open", 1)], "event_ticker string, market_ticker string, strike double, status string, updated_at long")
    got = joins.with_metadata(rows.withColumn("event_ticker", F.lit("E")), meta).orderBy("market_ticker").collect()
    assert [(r.strike, r.metadata_reason) for r in got] == [(2.0, "not_open"), (3.0, None), (None, "no_metadata")]
    contracts = spark.createDataFrame([("E", 10), ("E", 99), ("X", 99)], "event_ticker string, expiry long")
    events = spark.createDataFrame([("E",)], "event_ticker string")
    assert [r.reason for r in pricing.expire_contracts(contracts, events, 10).orderBy("event_ticker", "expiry").collect()] == ["expired", None, "unknown_event"]
    assert [r.reason for r in pricing.expire_contracts(contracts, events.limit(0), 10).orderBy("event_ticker", "expiry").collect()] == ["expired", None, None]


def test_point_in_time_training_table(spark):
    features = spark.createDataFrame([("A", 1, 0.1), ("A", 2, 0.2), ("A", 3, 0.3)], "asset string, bucket long, x double")
    labels = spark.createDataFrame([("A", 1, 5, 1.0), ("A", 2, 6, None), ("A", 3, 7, 3.0)], "asset string, bucket long, label_window_end long, y double")
    assert [(r.bucket, r.x, r.y) for r in joins.training_table(features, labels, 6, ["y"]).collect()] == [(1, 0.1, 1.0)]


def test_comparison_and_profile(spark):
    raw = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 5.0)], "bucket long, quantity double")
    bars = spark.createDataFrame([(0, 3.0), (2, 4.0)], "bucket long, v_trade double")
    got = {r.bucket: (r.n_raw, r.delta, r.equal) for r in quality.compare_buckets(raw, bars, ["bucket"]).collect()}
    assert got == {0: (2, 0.0, True), 1: (1, 5.0, False), 2: (None, -4.0, False)}
    r = quality.profile(spark.createDataFrame([("v", 1.0), ("v", None), ("v", float("nan")), ("v", 3.0)], "venue string, price double"), ["venue"], ["price"]).first()
    assert (r.n, r.price_min, r.price_max, r.price_mean, r.price_nulls, r.price_odd) == (4, 1.0, 3.0, 2.0, 1, 1)


def test_appended_rows_take_the_last_of_their_key(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, x double")
    new = spark.createDataFrame([("a", 5.0, 1), ("a", 4.0, 2), ("c", 7.0, 1), ("c", 7.0, 1)], "k string, x double, n long")
    assert sorted(tuple(r) for r in ingest.append_dedup(old, new, ["k"], "n").collect()) == [("a", 4.0), ("b", 2.0), ("c", 7.0)]


def test_clustered_tables_are_windowed_and_joined_without_a_shuffle(spark):
    rows = spark.range(2000).select(F.concat(F.lit("v"), F.col("id") % 3).alias("venue"), F.timestamp_seconds(F.col("id") * 500).alias("at"), F.col("id").alias("k"))
    for name in ("test_left", "test_right"):
        lake.write_clustered(rows, name, ["venue"], "at", 4, "overwrite")
    a, b = spark.table("test_left"), spark.table("test_right")
    w = Window.partitionBy("venue", "day").orderBy("at")
    for conf, value in (("adaptive.enabled", "false"), ("autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(f"spark.sql.{conf}", value)
    try:
        for df in (a.withColumn("before", F.lag("k").over(w)), a.join(b.select("venue", "day", F.col("at").alias("at2")).groupBy("venue", "day").agg(F.max("at2").alias("end")), ["venue", "day"])):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for conf in ("adaptive.enabled", "autoBroadcastJoinThreshold"):
            spark.conf.unset(f"spark.sql.{conf}")
    assert a.count() == 2000 and a.where("day = 3").agg(F.max(F.to_date("at")).cast("string")).first()[0] == "1970-01-04"
    assert a.select("venue", "day").distinct().count() > 30  # a key's days lie in buckets of their own
    for name in ("test_left", "test_right"):
        spark.sql(f"DROP TABLE {name}")


def test_boosted_trees_come_near_a_curve(spark):
    """Of a target that a line misses: the trees' error, with the default step and depth, is under a seventh of the line's."""
    from voltide.operators import models

    rng = np.random.default_rng(11)
    x = rng.uniform(-3, 3, 600)
    rows = spark.createDataFrame([(float(a), float(np.sin(2 * a) + 2)) for a in x], "x double, target double").repartition(2)
    model, data = models.train_boosted(rows, ["x"], trees=60)
    error = model.transform(data).agg(F.sqrt(F.avg((F.col("prediction") - F.col("target")) ** 2))).first()[0]
    line = np.polyfit(x, np.sin(2 * x) + 2, 1)
    assert error < np.sqrt(np.mean((np.polyval(line, x) - np.sin(2 * x) - 2) ** 2)) / 7
