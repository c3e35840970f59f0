"""Live features by asset from streaming bars of its venues, with state that survives restarts and can start warm."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

YEAR_SECONDS = 365 * 24 * 3600
FIELDS = {
    "last": "long", "price": "double", "variance": "double",
    "return_at": "array<long>", "returns": "array<double>", "volume_at": "array<long>", "volumes": "array<double>",
    "sampled": "array<double>", "variances": "array<double>",
    "venue": "array<string>", "seen": "array<long>",
    "open_bucket": "array<long>", "open_venue": "array<string>", "open_price": "array<double>", "open_volume": "array<double>",
}


class LiveFeatures(StatefulProcessor):
    """Bars of an asset (venue, bucket, price, v_buy) to features of each bucket that a later one has completed.

    State: the last completed bucket and its price; returns and buy volumes with their buckets, for as long as the longest
    windows reach back in time; the variance a bar, and for each horizon the price sampled last and the variance; each
    venue's newest bucket; and the bars of the bucket that may still grow. Windows are of time: one is null unless each of
    its buckets is there, and its returns are over one bar each, so rows after a gap have no windows until it is behind
    them. Bars of a bucket that is completed, or from before the venue's newest one, are refused; a venue's second bar of a
    bucket is ignored. A batch's bars are taken together, in order of time.
    """

    def __init__(self, bar: int, windows: list[int], volumes: list[int], decay: float, horizons: list[int]):
        self.bar, self.windows, self.volumes, self.decay, self.horizons = bar, windows, volumes, decay, horizons

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", ", ".join(f"{name} {kind}" for name, kind in FIELDS.items()))

    def columns(self) -> list[str]:
        return ["asset", "bucket", "synthetic_price", "venue_count", "log_return", "variance", *[f"variance_{h}s" for h in self.horizons], *[f"realized_vol_{w}s" for w in self.windows], *[f"log_buy_volume_{w}s" for w in self.volumes], "venue", "refused"]

    def averaged(self, before: float | None, r: float) -> float:
        return r * r if before is None else self.decay * before + (1 - self.decay) * r * r

    def advance(self, asset: str, bars: pd.DataFrame) -> pd.DataFrame:
        """Rows of completed buckets and of refused bars; the state moves on."""
        none = [None if kind in ("long", "double") else [] for kind in FIELDS.values()]
        s = dict(zip(FIELDS, self.state.get() if self.state.exists() else none))
        last, price, seen = -1 if s["last"] is None else s["last"], s["price"], dict(zip(s["venue"], s["seen"]))
        reason = np.where(bars["bucket"] <= last, "out_of_order", np.where(bars["bucket"] < bars["venue"].map(seen).fillna(-1), "out_of_order", ""))
        bad_price = ~((bars["price"] > 0) & np.isfinite(bars["price"].astype(float)))
        bad_volume = ~((bars["v_buy"] >= 0) & np.isfinite(bars["v_buy"].astype(float)))
        reason = np.where(bars["bucket"] % self.bar != 0, "misaligned", np.where(bad_price, "price", np.where(bad_volume, "volume", reason)))
        refused = bars[reason != ""].assign(refused=reason[reason != ""])
        taken = bars[reason == ""]
        seen |= {v: max(int(x), seen.get(v, -1)) for v, x in taken.groupby("venue")["bucket"].max().items()}
        held = pd.DataFrame({"bucket": s["open_bucket"], "venue": s["open_venue"], "price": s["open_price"], "v_buy": s["open_volume"]})
        both = pd.concat([held, taken[held.columns]], ignore_index=True) if len(held) else taken[held.columns]
        both = both.drop_duplicates(["bucket", "venue"])
        newest = both["bucket"].max() if len(both) else last
        done = both[both["bucket"] < newest].groupby("bucket").agg(price=("price", "mean"), n=("price", "size"), v_buy=("v_buy", "sum"))
        at, prices = done.index.to_numpy(dtype=np.int64), done["price"].to_numpy(dtype=float)
        moves = np.log(prices / np.r_[np.nan if price is None else price, prices[:-1]]) if len(done) else np.empty(0)
        one_bar = at - np.r_[last, at[:-1]] == self.bar
        variance, sampled, variances = s["variance"], dict(zip(self.horizons, s["sampled"] or [None] * len(self.horizons))), dict(zip(self.horizons, s["variances"] or [None] * len(self.horizons)))
        forecast, by_horizon = [], {h: [] for h in self.horizons}
        for bucket, p, r in zip(at.tolist(), prices.tolist(), moves.tolist()):  # one step a bucket
            forecast.append(variance)
            variance = variance if math.isnan(r) else self.averaged(variance, r)
            for h in self.horizons:
                by_horizon[h].append(variances[h])
                if (bucket + self.bar) % h == 0:
                    variances[h] = variances[h] if sampled[h] is None else self.averaged(variances[h], math.log(p / sampled[h]))
                    sampled[h] = p
        r_at, returns = np.r_[np.array(s["return_at"], dtype=np.int64), at[one_bar & ~np.isnan(moves)]], np.r_[np.array(s["returns"], dtype=float), moves[one_bar & ~np.isnan(moves)]]
        v_at, volumes = np.r_[np.array(s["volume_at"], dtype=np.int64), at], np.r_[np.array(s["volumes"], dtype=float), done["v_buy"].to_numpy(dtype=float)]
        number = lambda xs: np.array([np.nan if x is None else x for x in xs], dtype=float)
        out = {"asset": asset, "bucket": at, "synthetic_price": prices, "venue_count": done["n"].to_numpy(dtype=np.int64), "log_return": moves, "variance": number(forecast)} | {f"variance_{h}s": number(by_horizon[h]) for h in self.horizons}
        for w in self.windows:
            out[f"realized_vol_{w}s"] = np.sqrt(self.trailing(r_at, returns**2, at, w) * YEAR_SECONDS / w)
        for w in self.volumes:
            out[f"log_buy_volume_{w}s"] = np.log1p(self.trailing(v_at, volumes, at, w))
        if len(done):
            last, price = int(at[-1]), float(prices[-1])
        keep_r, keep_v = (x > last - max(w, default=0) for x, w in ((r_at, self.windows), (v_at, self.volumes)))
        rest = both[both["bucket"] == newest] if len(both) else both
        text = lambda xs, kind: list(map(kind, xs))
        self.state.update((
            last if last >= 0 else None, price, variance, text(r_at[keep_r], int), text(returns[keep_r], float), text(v_at[keep_v], int), text(volumes[keep_v], float),
            list(sampled.values()), list(variances.values()), list(seen), list(seen.values()), text(rest["bucket"], int), list(rest["venue"]), text(rest["price"], float), text(rest["v_buy"], float)))
        rows = pd.DataFrame(out).astype({"venue_count": "Int64"}).assign(venue=None, refused=None)
        return pd.concat([rows, refused[["bucket", "venue", "refused"]].assign(asset=asset)], ignore_index=True)[self.columns()] if len(refused) else rows[self.columns()]

    def trailing(self, at: np.ndarray, values: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
        """Sums of the values of the `window` seconds up to each end; not a number unless every bar of them has one."""
        low, high = np.searchsorted(at, ends - window, side="right"), np.searchsorted(at, ends, side="right")
        return np.array([values[i:j].sum() if j - i == window // self.bar else np.nan for i, j in zip(low, high)], dtype=float)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield self.advance(key[0], pd.concat(list(rows), ignore_index=True).sort_values(["bucket", "venue"], ignore_index=True))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        """History of the windows, as bars: it moves the state and puts nothing out."""
        self.advance(key[0], initialState.sort_values(["bucket", "venue"], ignore_index=True))

    def close(self) -> None:
        pass


def live_bar_errors(bars: DataFrame, bar: int, most_age: int | None = None, now: Column | None = None) -> DataFrame:
    """Adds error: the first reason why a bar as it arrived (venue, bucket in epoch seconds, price and v_buy as given) can't
    be a live bar: venue (blank), misaligned, stale (its end is more than `most_age` seconds before `now`), price, volume.
    Prices and volumes are numbers afterwards, null where they are none.
    """
    price, volume = F.col("price").try_cast("double"), F.col("v_buy").try_cast("double")
    bad = lambda x, low: F.coalesce(F.isnan(x) | ~low(x) | (x == float("inf")), F.lit(True))
    late = F.lit(False) if most_age is None else (F.unix_seconds(F.current_timestamp()) if now is None else now) - F.col("bucket") - bar > most_age
    rules = [("venue", F.coalesce(F.trim("venue") == "", F.lit(True))), ("misaligned", F.coalesce(F.col("bucket") % bar != 0, F.lit(True))), ("stale", late), ("price", bad(price, lambda x: x > 0)), ("volume", bad(volume, lambda x: x >= 0))]
    error = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        error = F.when(broken, name).otherwise(error)
    return bars.withColumns({"error": error, "price": price, "v_buy": volume})


def stream_features(bars: DataFrame, bar: int, windows: list[int], volumes: list[int], decay: float = 0.96, history: DataFrame | None = None, complete: bool = True, horizons: tuple[int, ...] = (), refused: bool = False) -> DataFrame:
    """Features of streaming bars (asset, venue, bucket in epoch seconds, price, v_buy); needs the RocksDB state store.

    variance is the exponential average of a bar's squared returns before the bucket's own, variance_<h>s that of returns
    between prices sampled where a bucket's end is a multiple of the horizon. Only rows whose longest windows are full come
    out if `complete`. history: bars of the time that the windows reach back, from which a new query's state starts. With
    `refused`, bars that were not taken come out too, with their venue and the reason: misaligned, price, volume or
    out_of_order; these have no other values.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # state workers need no installation of this module
    step = LiveFeatures(bar, windows, volumes, decay, list(horizons))
    kinds = {"asset": "string", "bucket": "long", "venue_count": "long", "venue": "string", "refused": "string"}
    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in step.columns())
    out = bars.groupBy("asset").transformWithStateInPandas(step, schema, "append", "none", history.groupBy("asset") if history is not None else None)
    is_refused = F.col("refused").isNotNull()
    full = F.lit(True)
    for c in [f"realized_vol_{max(windows)}s"] * bool(windows) + [f"log_buy_volume_{max(volumes)}s"] * bool(volumes):
        full = full & ~F.isnan(c) & F.col(c).isNotNull() if complete else full
    return out.where(is_refused | full) if refused else out.where(~is_refused & full).drop("venue", "refused")
