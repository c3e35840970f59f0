"""Contract pricing and event rollover on streams: state by series that survives restarts."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from voltide.operators.pricing import HORIZONS, priced

KNOTS = [f"sigma_{h}" for h in HORIZONS]
TICKER = {"event_ticker": "string", "bid": "double", "ask": "double", "quoted_at": "long", "strike": "double", "expiry": "long", "status": "string"}
MARKET = {"market_ticker": "string"} | TICKER | {"published": "boolean"}
HELD = {"spot": "double", "spot_at": "long", "feature_at": "long"} | {k: "double" for k in KNOTS}


def _given(x):
    """A cell of a frame, with None for what is missing."""
    return None if x is None or x != x or x is pd.NaT else x


class PricingCycle(StatefulProcessor):
    """One cycle a micro-batch and series: the newest ticker of each market against the newest spot and forecast curve.

    Rows in (kind ticker, spot or curve) change the state where they are newer than what it holds, so a curve that comes
    late, or twice, changes nothing. The moment of a cycle is the newest arrival of the series so far. Each market that is
    held is put out with all that its price needs; if spot or curve is missing, bad or too old, only markets that have a
    ticker in this batch or a price out there are, with the reason, which takes the price back. So are, once, markets that
    have expired, whose event isn't known any more or isn't open; they leave the state when they have expired.
    """

    def __init__(self, spot_age: int | None, curve_age: int | None, names: list[str]):
        self.spot_age, self.curve_age, self.names = spot_age, curve_age, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one value holds a series whole: its markets are as many as an event has strikes
        fields = HELD | {"now": "long"} | {n: f"array<{t}>" for n, t in MARKET.items()}
        self.state = handle.getValueState("series", ", ".join(f"{n} {t}" for n, t in fields.items()))

    def failure(self, held: dict, now: int) -> str | None:
        if held["spot"] is None:
            return "no_spot"
        if self.spot_age is not None and now - held["spot_at"] > self.spot_age:
            return "stale_spot"
        if held["feature_at"] is None:
            return "no_curve"
        if not all(held[k] is not None and math.isfinite(held[k]) and held[k] > 0 for k in KNOTS):
            return "bad_curve"
        if self.curve_age is not None and now - held["feature_at"] > self.curve_age:
            return "stale_curve"
        return None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else [*[None] * (len(HELD) + 1), *[[] for _ in MARKET]]
        held = dict(zip([*HELD, "now"], state))
        markets = {name: dict(zip([*TICKER, "published"], m)) for name, *m in zip(*state[len(HELD) + 1 :])}
        arrived = set()
        for r in pd.concat(list(rows), ignore_index=True).sort_values("at", kind="stable").to_dict("records"):
            r = {k: _given(v) for k, v in r.items()}
            held["now"] = max(int(r["at"]), held["now"] or int(r["at"]))
            if r["kind"] == "spot" and (held["spot_at"] is None or r["at"] >= held["spot_at"]):
                held |= {"spot": r["spot"], "spot_at": int(r["at"])}
            elif r["kind"] == "curve" and (held["feature_at"] is None or r["feature_at"] > held["feature_at"]):
                held |= {"feature_at": int(r["feature_at"])} | {k: r[k] for k in KNOTS}
            elif r["kind"] == "ticker":
                old = markets.get(r["market_ticker"])
                if old is None or r["quoted_at"] >= old["quoted_at"]:
                    markets[r["market_ticker"]] = {n: r[n] for n in TICKER} | {"published": bool(old and old["published"])}
                arrived.add(r["market_ticker"])
        now, reason = held["now"], self.failure(held, held["now"])
        out, gone = [], []
        for name, m in markets.items():
            left = None if m["expiry"] is None else m["expiry"] - now
            listed = m["strike"] is not None and m["status"] in ("open", "active")
            alive = listed and left > 0
            price = alive and reason is None and left <= HORIZONS[-1]
            if name in arrived or m["published"] or price:
                out.append([*key, name, now, *[m[n] for n in TICKER], *[held[n] for n in HELD], reason])
            m["published"] = price
            if left is not None and left <= 0:
                gone.append(name)
        kept = {name: m for name, m in markets.items() if name not in gone}
        whole = lambda n, x: int(x) if MARKET[n] == "long" and x is not None else x
        self.state.update((*held.values(), list(kept), *[[whole(n, m[n]) for m in kept.values()] for n in [*TICKER, "published"]]))
        frame = pd.DataFrame(out, columns=self.names)
        yield frame.astype({n: "Int64" for n in ("at", "quoted_at", "expiry", "spot_at", "feature_at")} | {n: float for n in ("bid", "ask", "strike", "spot", *KNOTS)})

    def close(self) -> None:
        pass


def stream_pricing(rows: DataFrame, stale: int = 60, spot_age: int | None = 5, curve_age: int | None = 60) -> DataFrame:
    """Prices of streaming rows by `PricingCycle`; needs the RocksDB state store.

    rows: series, kind, at (arrival in epoch seconds); of a ticker market_ticker, event_ticker, bid, ask, quoted_at, and
    from its contract's metadata strike, expiry, status (null: unknown); of a spot spot; of a curve feature_at and a
    column sigma_<h> a horizon. Out: a row a market and cycle, with reason (null: priced), model, mid, edge, buy_edge and
    sell_edge. A row with a reason takes back what was out.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # state workers need no installation of this module
    kinds = {"series": "string", "market_ticker": "string", "at": "long"} | TICKER | HELD | {"failure": "string"}
    wanted = ["series", "kind", "at", "market_ticker", *TICKER, "spot", "feature_at", *KNOTS]
    step = PricingCycle(spot_age, curve_age, list(kinds))
    out = rows.select(*wanted).groupBy("series").transformWithStateInPandas(step, ", ".join(f"{n} {t}" for n, t in kinds.items()), "append", "none")
    return priced(out.withColumn("__now", F.col("at")), stale, F.col("failure")).drop("failure", "spot_at")


class Rollover(StatefulProcessor):
    """A series' active event and the one that waits for its first message."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("events", "active string, pending string, generation int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        active, pending, generation = self.state.get() if self.state.exists() else (None, None, 0)
        out = []
        every = pd.concat(list(rows), ignore_index=True)
        # a staging comes before messages of its moment
        for r in every.assign(last=every["kind"] != "staged").sort_values(["at", "last"], kind="stable").itertuples(index=False):
            if r.kind == "staged":
                pending = pending if r.event_ticker == active else r.event_ticker
                continue
            ended = None
            if pending is not None and r.event_ticker == pending:
                ended, active, pending, generation = active, pending, None, generation + 1
            out.append([*key, r.event_ticker, r.at, r.event_ticker == active, active or "", generation, ended])
        self.state.update((active, pending, generation))
        yield pd.DataFrame(out, columns=["series", "event_ticker", "at", "accepted", "active", "generation", "ended"])

    def close(self) -> None:
        pass


def stream_rollover(rows: DataFrame) -> DataFrame:
    """The rule of `operators.pricing.rollover` on a stream of stagings and messages; needs the RocksDB state store.

    rows: series, event_ticker, at, kind (staged, else a message). Out: a row a message, with accepted, active, generation
    and ended (the event that this message's switch has ended).
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    schema = "series string, event_ticker string, at long, accepted boolean, active string, generation int, ended string"
    return rows.select("series", "event_ticker", "at", "kind").groupBy("series").transformWithStateInPandas(Rollover(), schema, "append", "none")
