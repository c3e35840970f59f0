"""Queries over synthetic prices, volatility features, microstructure and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltide.functions.columns import exact_mean
from voltide.operators import bars as B
from voltide.operators import features as X
from voltide.operators import joins as J

from .bars import clean, flat, hourly
from .base import BARS, BUCKET, HOUR, SYNTHETIC, query

YEAR = "31536000.0::DOUBLE"


def bars_of(spark, d):
    return flat(hourly(spark, d))


def prices(spark, d):
    return X.synthetic(flat(B.zero_fill(_bars(spark, d))))


def _bars(spark, d):
    t = clean(spark, d)
    grid = B.time_grid(t.select(*B.KEYS).distinct(), B.bounds_of(t, HOUR), HOUR)
    return grid.join(B.trade_bars(t, HOUR), ["bucket", *B.KEYS], "left")


def returns(spark, d):
    return X.with_return(prices(spark, d), HOUR)


@query("synthetic_price", "SELECT asset, bucket, synthetic_price, venue_count FROM synthetic", SYNTHETIC)
def synthetic_price(spark, d):
    return prices(spark, d).drop("v_buy")


@query("cross_venue_buy_volume", "SELECT bucket, v_buy FROM synthetic", SYNTHETIC)
def cross_venue_buy_volume(spark, d):
    return prices(spark, d).select("bucket", "v_buy")


@query("log_return", "SELECT asset, bucket, log_return FROM returns", SYNTHETIC)
def log_return(spark, d):
    return returns(spark, d).select("asset", "bucket", "log_return")


def _rv(w, frame, test, scale, source="returns", name="realized_vol"):
    return f"CASE WHEN count(log_return) OVER ({frame}) {test} THEN sqrt(sum(log_return * log_return) OVER ({frame}) * {YEAR} / {scale}) END AS {name}_{w}s"


def _back(seconds):
    return f"ORDER BY bucket RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW"


RV = ", ".join(_rv(w, _back(w - HOUR), f"= {w // HOUR}", w) for w in (10800, 86400))
BUY = ", ".join(f"CASE WHEN count(*) OVER ({_back(w - HOUR)}) = {w // HOUR} THEN ln(1 + sum(v_buy) OVER ({_back(w - HOUR)})) END AS log_buy_volume_{w}s" for w in (10800, 21600))


@query("realized_vol", f"SELECT asset, bucket, {RV} FROM returns", SYNTHETIC)
def realized_vol(spark, d):
    return X.realized_vol(returns(spark, d), HOUR, [10800, 86400]).select("asset", "bucket", "realized_vol_10800s", "realized_vol_86400s")


@query("realized_vol_v1", f"SELECT asset, bucket, {', '.join(_rv(w, _back(w), f'>= {w // HOUR}', 1) for w in (10800, 86400))} FROM returns", SYNTHETIC)
def realized_vol_v1(spark, d):
    return X.realized_vol_v1(returns(spark, d), HOUR, [10800, 86400]).select("asset", "bucket", "realized_vol_10800s", "realized_vol_86400s")


@query("log_buy_volume", f"SELECT asset, bucket, {BUY} FROM synthetic", SYNTHETIC)
def log_buy_volume(spark, d):
    return X.log_buy_volume(prices(spark, d), HOUR, [10800, 21600]).select("asset", "bucket", "log_buy_volume_10800s", "log_buy_volume_21600s")


def _ahead(h):
    return f"ORDER BY bucket RANGE BETWEEN 1 FOLLOWING AND {h} FOLLOWING"


LABELS = f"SELECT asset, bucket, bucket + 21600 AS label_window_end, {', '.join(_rv(h, _ahead(h), f'= {h // HOUR}', h, name='target_rv') for h in (3600, 21600))} FROM returns"


def labels(spark, d):
    return X.future_rv(returns(spark, d), HOUR, [3600, 21600])


@query("future_rv", LABELS, SYNTHETIC)
def future_rv(spark, d):
    return labels(spark, d)


FEATURES = f"SELECT asset, bucket, synthetic_price, venue_count, log_return, {RV}, {BUY}, 'v4' AS feature_version FROM returns"


def features(spark, d, **how):
    return X.features(flat(B.zero_fill(_bars(spark, d))), HOUR, [10800, 86400], [10800, 21600], "v4", **how).drop("v_buy")


@query("features_v4", FEATURES, SYNTHETIC)
def features_v4(spark, d):
    return features(spark, d)


START = 1704067200 + 5 * 86400


@query("features_v3", f"SELECT asset, bucket, synthetic_price, log_return, {RV}, 'v3' AS feature_version FROM returns QUALIFY bucket >= {START}", SYNTHETIC)
def features_v3(spark, d):
    out = X.features(flat(B.zero_fill(_bars(spark, d))), HOUR, [10800, 86400], [], "v3", start=START)
    return out.drop("v_buy", "venue_count")


@query("features_v2", f"SELECT asset, bucket, log_return, {_rv(10800, _back(10800), '>= 3', 1)}, 'v2' AS feature_version FROM returns", SYNTHETIC)
def features_v2(spark, d):
    return X.realized_vol_v1(returns(spark, d), HOUR, [10800]).select("asset", "bucket", "log_return", "realized_vol_10800s", F.lit("v2").alias("feature_version"))


@query("flagship", f"SELECT f.bucket, f.synthetic_price, f.log_return, f.realized_vol_10800s, l.target_rv_3600s FROM ({FEATURES}) f JOIN ({LABELS}) l USING (asset, bucket) WHERE l.target_rv_3600s IS NOT NULL", SYNTHETIC)
def flagship(spark, d):
    both = features(spark, d).join(labels(spark, d).where("target_rv_3600s IS NOT NULL"), ["asset", "bucket"])
    return both.select("bucket", "synthetic_price", "log_return", "realized_vol_10800s", "target_rv_3600s")


NOW = 1704067200 + 25 * 86400


@query("pit_training_join", f"SELECT f.bucket, f.log_return, f.realized_vol_10800s, f.log_buy_volume_10800s, l.target_rv_3600s, l.target_rv_21600s FROM ({FEATURES}) f JOIN ({LABELS}) l USING (asset, bucket) WHERE l.label_window_end <= {NOW} AND l.target_rv_21600s IS NOT NULL", SYNTHETIC)
def pit_training_join(spark, d):
    return training(spark, d)


def training(spark, d):
    return J.training_table(features(spark, d), labels(spark, d), NOW, ["target_rv_21600s"]).select("bucket", "log_return", "realized_vol_10800s", "log_buy_volume_10800s", "target_rv_3600s", "target_rv_21600s")


EWMA = """,
e AS (WITH RECURSIVE o AS (SELECT asset, bucket, coalesce(log_return * log_return, 0) AS r2, row_number() OVER (ORDER BY bucket) AS n FROM returns),
  r AS (SELECT n, asset, bucket, r2, r2 AS variance, r2 AS forecast FROM o WHERE n = 1
    UNION ALL SELECT o.n, o.asset, o.bucket, o.r2, 0.96::DOUBLE * r.variance + 0.04::DOUBLE * o.r2, r.variance FROM r JOIN o ON o.n = r.n + 1)
  SELECT asset, bucket, variance, forecast FROM r)"""


@query("ewma_variance", "SELECT * FROM e", SYNTHETIC + EWMA)
def ewma_variance(spark, d):
    return X.ewma_variance(returns(spark, d)).select("asset", "bucket", "variance", "forecast")


@query("ewma_annualized", f"SELECT asset, bucket, sqrt(greatest(variance * 6 * {YEAR} / 21600, 1e-18::DOUBLE)) AS ewma_vol FROM e", SYNTHETIC + EWMA)
def ewma_annualized(spark, d):
    return X.ewma_variance(returns(spark, d)).select("asset", "bucket", X.annualized(F.col("variance"), HOUR, 21600).alias("ewma_vol"))


@query("sampled_ewma", """SELECT bucket, log_return, variance, lag(variance) OVER (ORDER BY bucket) AS published FROM (
  WITH RECURSIVE p AS (SELECT bucket, ln(synthetic_price / lag(synthetic_price) OVER (ORDER BY bucket)) AS log_return FROM synthetic WHERE (bucket + 3600) % 14400 = 0 AND synthetic_price IS NOT NULL),
  o AS (SELECT *, row_number() OVER (ORDER BY bucket) AS n FROM p WHERE log_return IS NOT NULL),
  r AS (SELECT n, bucket, log_return, log_return * log_return AS variance FROM o WHERE n = 1
    UNION ALL SELECT o.n, o.bucket, o.log_return, 0.9::DOUBLE * r.variance + 0.1::DOUBLE * o.log_return * o.log_return FROM r JOIN o ON o.n = r.n + 1) SELECT * FROM r)""", SYNTHETIC)
def sampled_ewma(spark, d):
    return X.sampled_ewma(prices(spark, d), 14400, HOUR, 0.9).drop("asset")


@query("latest_features", f"SELECT * FROM ({FEATURES}) WHERE bucket >= {NOW} - 2592000 AND bucket < {NOW} QUALIFY row_number() OVER (PARTITION BY asset ORDER BY bucket DESC) = 1", SYNTHETIC)
def latest_features(spark, d):
    f = features(spark, d).where((F.col("bucket") >= NOW - 30 * 86400) & (F.col("bucket") < NOW))
    return f.groupBy("asset").agg(F.max_by(F.struct(*[c for c in f.columns if c != "asset"]), "bucket").alias("x")).select("asset", "x.*")


FILLED = """,
fr AS (SELECT *, coalesce(ln(CASE WHEN p_close / lag(p_close) OVER w > 0 THEN p_close / lag(p_close) OVER w END), 0) AS log_return FROM bars WINDOW w AS (PARTITION BY venue, instrument ORDER BY bucket)),
fb AS (SELECT *, pi() / 2 * abs(log_return) * abs(lag(log_return) OVER (PARTITION BY venue, instrument ORDER BY bucket)) AS b2,
  greatest(0.5::DOUBLE * ln(p_high / p_low) * ln(p_high / p_low) - (2 * ln(2) - 1) * ln(p_close / p_open) * ln(p_close / p_open), 0) AS g2 FROM fr),
fo AS (SELECT *, CASE WHEN count(log_return) OVER w >= 4 THEN sqrt(sum(log_return * log_return) OVER w) END AS rv, CASE WHEN count(b2) OVER w >= 4 THEN sqrt(sum(b2) OVER w) END AS bv,
  CASE WHEN count(CASE WHEN p_open IS NOT NULL THEN g2 END) OVER w >= 4 THEN sqrt(avg(CASE WHEN p_open IS NOT NULL THEN g2 END) OVER w) END AS gk
  FROM fb WINDOW w AS (PARTITION BY venue, instrument ORDER BY bucket ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
rolled AS (SELECT *, CASE WHEN rv IS NOT NULL AND bv IS NOT NULL THEN greatest(rv * rv - bv * bv, 0) WHEN rv IS NOT NULL OR bv IS NOT NULL THEN 0.0::DOUBLE ELSE 0.0::DOUBLE END AS jump FROM fo)"""


def rolled(spark, d):
    return X.rolling(bars_of(spark, d), HOUR, 86400)


for _name, _cols in (("bars_return_filled", "log_return"), ("rolling_rv", "rv"), ("bipower_variation", "bv"), ("jump_component", "jump"), ("garman_klass", "gk")):
    query(_name, f"SELECT bucket, venue, {_cols} FROM rolled", BARS + FILLED)(lambda spark, d, c=_cols: rolled(spark, d).select("bucket", "venue", c))
query("jump_ratio", "SELECT bucket, venue, jump / (rv * rv + 1e-8::DOUBLE) AS jump_ratio FROM rolled", BARS + FILLED)(lambda spark, d: rolled(spark, d).select("bucket", "venue", "jump_ratio"))


@query("cvd", "SELECT bucket, venue, sum(v_buy - v_sell) OVER (PARTITION BY venue, instrument ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS cvd FROM bars", BARS)
def cvd(spark, d):
    from voltide.operators.timeseries import carry_scan

    bars = flat(B.zero_fill(_bars(spark, d))).select("bucket", *B.KEYS, "v_buy", "v_sell")
    return carry_scan(bars, "bucket", list(B.KEYS), F.lit(1.0), F.col("v_buy") - F.col("v_sell"), "cvd").select("bucket", "venue", "cvd")


def _wap(k):
    return f"(p_bid_{k} * q_ask_{k} + p_ask_{k} * q_bid_{k}) / nullif(q_bid_{k} + q_ask_{k}, 0)"


def _sum(side, n=10):
    return " + ".join(f"coalesce(q_{side}_{k}, 0)" for k in range(1, n + 1))


MICRO = {
    **{f"wap_{k}": _wap(k) for k in (1, 5, 10)}, **{f"microprice_{k}": _wap(k) for k in (1, 5, 10)},
    **{f"obi_{k}": f"(q_bid_{k} - q_ask_{k}) / nullif(q_bid_{k} + q_ask_{k}, 0)" for k in (1, 5, 10)},
    "spread": "p_ask_1 - p_bid_1", "relative_spread": f"(p_ask_1 - p_bid_1) / nullif({_wap(1)}, 0)",
    **{f"{s}_slope": f"({_sum(s)}) / nullif(p_{s}_1 - p_{s}_10, 0)" for s in ("bid", "ask")},
    "liquidity_consumption": "v_trade / nullif(q_bid_1 + q_ask_1, 0)", "aggressor_imbalance": "(v_buy - v_sell) / nullif(v_buy + v_sell, 0)",
}


def micro(spark, d):
    return X.microstructure(bars_of(spark, d), HOUR)


for _name, _cols in (("wap", ["wap_1", "wap_5", "wap_10", "microprice_1"]), ("obi", ["obi_1", "obi_5", "obi_10"]), ("spread", ["spread", "relative_spread"]), ("book_slope", ["bid_slope", "ask_slope"]), ("liquidity_consumption", ["liquidity_consumption"]), ("aggressor_imbalance", ["aggressor_imbalance"])):
    query(_name, f"SELECT bucket, venue, {', '.join(f'{MICRO[c]} AS {c}' for c in _cols)} FROM bars", BARS)(lambda spark, d, c=_cols: micro(spark, d).select("bucket", "venue", *c))

OFI = """(CASE WHEN p_bid_1 - lag(p_bid_1) OVER w > 0 THEN q_bid_1 WHEN p_bid_1 - lag(p_bid_1) OVER w = 0 THEN q_bid_1 - lag(q_bid_1) OVER w ELSE 0 END)
  - (CASE WHEN p_ask_1 - lag(p_ask_1) OVER w > 0 THEN 0 WHEN p_ask_1 - lag(p_ask_1) OVER w = 0 THEN q_ask_1 - lag(q_ask_1) OVER w ELSE q_ask_1 END)"""


@query("ofi", f"SELECT bucket, venue, {OFI} AS ofi FROM bars WINDOW w AS (PARTITION BY venue, instrument ORDER BY bucket)", BARS)
def ofi(spark, d):
    return micro(spark, d).select("bucket", "venue", "ofi")


@query("features_v1", f"""SELECT bucket, {', '.join(f'avg({c}) AS {c}' for c in X.FEATURES_V1)} FROM (SELECT *, {', '.join(f'{e} AS {c}' for c, e in MICRO.items())}, {OFI} AS ofi
  FROM rolled WINDOW w AS (PARTITION BY venue, instrument ORDER BY bucket)) GROUP BY bucket""", BARS + FILLED)
def features_v1(spark, d):
    return X.features_v1(bars_of(spark, d), HOUR, 86400)


@query("venue_mean_features", "SELECT bucket, avg(p_close) AS p_close, avg(v_trade) AS v_trade, avg(dt_fill_mean_ms) AS dt_fill_mean_ms FROM bars GROUP BY bucket", BARS)
def venue_mean_features(spark, d):
    return X.venue_means(bars_of(spark, d), ["p_close", "v_trade", "dt_fill_mean_ms"])


#: Prices in billionths, summed as whole numbers: a mean of doubles, and with it a rounded tie, depends on the order of rows.
EXACT = f"""exact AS (SELECT {BUCKET} AS bucket, venue, instrument, price, TRY_CAST(floor(price) AS BIGINT)::HUGEINT * 1000000000 + TRY_CAST(round((price - floor(price)) * 1e9::DOUBLE) AS BIGINT)::HUGEINT AS billionths FROM deduped),
sums AS (SELECT bucket, venue, sum(billionths)::HUGEINT AS total, count(price)::HUGEINT AS n, count(billionths) = count(price) AS fine FROM exact GROUP BY bucket, venue, instrument),
means AS (SELECT bucket, venue, CASE WHEN fine AND n > 0 THEN ((sign(total) * ((abs(total) * 2 + n * 1000) // (n * 2000)))::DECIMAL(24, 0) * 0.000001::DECIMAL(7, 6))::DECIMAL(18, 6) END AS mean FROM sums)"""


@query("venue_prices_map", "SELECT bucket, string_agg(venue || '=' || mean, ',' ORDER BY venue) AS venue_prices FROM means GROUP BY bucket", EXACT)
def venue_prices_map(spark, d):
    means = flat(clean(spark, d).groupBy(B.time_bucket("event_timestamp", HOUR).alias("bucket"), *B.KEYS).agg(exact_mean("price").alias("mean")))
    known = F.when(F.col("venue").isNotNull() & F.col("mean").isNotNull(), F.struct("venue", "mean"))
    out = means.groupBy("bucket").agg(F.map_from_entries(F.array_sort(F.collect_list(known))).alias("m"))
    shown = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("bucket", F.nullif(F.array_join(shown, ","), F.lit("")).alias("venue_prices"))


@query("union_frequencies", "SELECT 3600 AS seconds, bucket, venue, p_close FROM trade_bars UNION ALL SELECT 600, epoch_us(event_timestamp) // 600000000 * 600, venue, last(price ORDER BY event_timestamp) FROM timed GROUP BY ALL", BARS)
def union_frequencies(spark, d):
    each = [flat(B.ohlc(clean(spark, d), n)).select(F.lit(n).alias("seconds"), "bucket", "venue", "p_close") for n in (HOUR, 600)]
    return each[0].unionByName(each[1])


@query("multi_level_microprice", f"SELECT bucket, venue, ({' + '.join(f'({_wap(k)}) / {k}' for k in range(1, 6))}) / ({' + '.join(f'1.0::DOUBLE / {k}' for k in range(1, 6))}) AS microprice FROM bars", BARS)
def multi_level_microprice(spark, d):
    return bars_of(spark, d).select("bucket", "venue", X.multi_level_microprice(5).alias("microprice"))


@query("cumulative_obi", f"SELECT bucket, venue, (({_sum('bid', 5)}) - ({_sum('ask', 5)})) / nullif(({_sum('bid', 5)}) + ({_sum('ask', 5)}), 0) AS obi FROM bars", BARS)
def cumulative_obi(spark, d):
    return bars_of(spark, d).select("bucket", "venue", X.cumulative_obi(5).alias("obi"))


@query("parkinson", "SELECT bucket, venue, sqrt(avg(ln(p_high / p_low) * ln(p_high / p_low)) OVER (PARTITION BY venue, instrument ORDER BY bucket ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) / (4 * ln(2))) AS parkinson FROM bars", BARS)
def parkinson(spark, d):
    return X.parkinson(bars_of(spark, d), HOUR, 86400).select("bucket", "venue", "parkinson")


WAPS = f"(SELECT bucket, venue, {_wap(1)} AS wap, q_bid_1 + q_ask_1 AS depth FROM bars)"


def waps(spark, d):
    return bars_of(spark, d).select("bucket", "venue", X.wap(1).alias("wap"), (F.col("q_bid_1") + F.col("q_ask_1")).alias("depth"))


@query("cross_venue_dispersion", f"SELECT bucket, stddev_samp(wap) AS dispersion FROM {WAPS} GROUP BY bucket", BARS)
def cross_venue_dispersion(spark, d):
    return waps(spark, d).groupBy("bucket").agg(F.stddev_samp("wap").alias("dispersion"))


@query("venue_hhi", f"SELECT bucket, sum(depth * depth) / nullif(sum(depth) * sum(depth), 0) AS hhi FROM {WAPS} GROUP BY bucket", BARS)
def venue_hhi(spark, d):
    return waps(spark, d).groupBy("bucket").agg((F.sum(F.col("depth") ** 2) / F.nullif(F.sum("depth") ** 2, F.lit(0.0))).alias("hhi"))


@query("venue_divergence", f"SELECT bucket, venue, wap - avg(wap) OVER (PARTITION BY bucket) AS divergence FROM {WAPS}", BARS)
def venue_divergence(spark, d):
    from pyspark.sql import Window

    return waps(spark, d).select("bucket", "venue", (F.col("wap") - F.avg("wap").over(Window.partitionBy("bucket"))).alias("divergence"))


@query("lead_lag_corr", "SELECT a.venue AS leader, b.venue AS follower, corr(a.log_return, b.log_return) AS correlation FROM rolled a JOIN rolled b ON b.bucket = a.bucket + 3600 AND a.venue <> b.venue GROUP BY ALL", BARS + FILLED)
def lead_lag_corr(spark, d):
    r = rolled(spark, d).select("bucket", "venue", "log_return")
    a = r.select((F.col("bucket") + HOUR).alias("bucket"), F.col("venue").alias("leader"), F.col("log_return").alias("x"))
    b = r.select("bucket", F.col("venue").alias("follower"), F.col("log_return").alias("y"))
    return a.join(b, "bucket").where("leader <> follower").groupBy("leader", "follower").agg(F.corr("x", "y").alias("correlation"))


@query("regime_features", f"""SELECT bucket, sin(2 * pi() * (bucket % 86400) / 86400) AS day_sin, cos(2 * pi() * (bucket % 86400) / 86400) AS day_cos, a / nullif(b, 0) AS rv_ratio, n_large FROM (
  SELECT bucket, sqrt(sum(log_return * log_return) OVER ({_back(10800)})) AS a, sqrt(sum(log_return * log_return) OVER ({_back(86400)})) AS b,
  count(CASE WHEN abs(log_return) > 0.01::DOUBLE THEN 1 END) OVER ({_back(86400)}) AS n_large FROM returns)""", SYNTHETIC)
def regime_features(spark, d):
    import math

    r2 = F.sum(F.col("log_return") ** 2)
    out = X.halo_window(returns(spark, d), "bucket", ["asset"], {
        "a": lambda w: F.sqrt(r2.over(w.rangeBetween(-10800, 0))), "b": lambda w: F.sqrt(r2.over(w.rangeBetween(-86400, 0))),
        "n_large": lambda w: F.count(F.when(F.abs("log_return") > 0.01, 1)).over(w.rangeBetween(-86400, 0))}, back=86400)
    turn = 2 * math.pi * (F.col("bucket") % 86400) / 86400
    return out.select("bucket", F.sin(turn).alias("day_sin"), F.cos(turn).alias("day_cos"), X.ratio("a", "b").alias("rv_ratio"), "n_large")


@query("fresh_venue_spot", """SELECT *, ln(spot / lag(spot) OVER (ORDER BY "end")) AS log_return FROM (SELECT "end", avg(price) FILTER (fresh) AS spot, count(*) FILTER (fresh) AS venue_count, coalesce(string_agg(venue, ',' ORDER BY venue) FILTER (fresh), '') AS used, coalesce(string_agg(venue, ',' ORDER BY venue) FILTER (NOT fresh), '') AS stale
  FROM (SELECT "end", g.venue, t.price, "end" * 1000000 - epoch_us(t.event_timestamp) <= 7200000000 AS fresh FROM
    (SELECT bucket + 3600 AS "end", venue FROM grid) g ASOF JOIN deduped t ON g.venue = t.venue AND make_timestamp(g."end" * 1000000) > t.event_timestamp) GROUP BY "end")""", BARS)
def fresh_venue_spot(spark, d):
    return X.fresh_venue_spot(clean(spark, d), HOUR, 7200)
