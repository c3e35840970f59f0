"""Loading, validating, normalising and upserting event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_trades(landing: DataFrame) -> DataFrame:
    """Landed trades (epoch milliseconds, ids under several names) to canonical raw trades."""
    at = F.timestamp_millis("exchange_ts_ms")
    return landing.select(
        at.alias("event_timestamp"), F.coalesce(F.timestamp_millis("received_ts_ms"), at).alias("received_timestamp"),
        F.lower("venue").alias("venue"), F.upper("instrument").alias("instrument"), F.coalesce("trade_id", "event_id", "redis_id").alias("trade_id"),
        F.expr("try_cast(price AS DOUBLE)").alias("price"), F.expr("try_cast(quantity AS DOUBLE)").alias("quantity"), "taker_side")


LEVELS = T.ArrayType(T.StructType([T.StructField("price", T.StringType()), T.StructField("quantity", T.StringType())]))


def load_book_levels(landing: DataFrame) -> DataFrame:
    """Books with a JSON array a side to a row a level."""
    keys = [c for c in landing.columns if c not in ("bids", "asks")]
    sides = [landing.select(*keys, F.lit(side).alias("side"), F.posexplode(F.from_json(column, LEVELS)).alias("pos", "x")) for side, column in (("bid", "bids"), ("ask", "asks"))]
    long = sides[0].unionByName(sides[1])
    return long.select(*keys, "side", (F.col("pos") + 1).alias("level"), F.expr("try_cast(x.price AS DOUBLE)").alias("price"), F.expr("try_cast(x.quantity AS DOUBLE)").alias("quantity"))


def archive_trade_csv(rows: DataFrame, venue: str, instrument: str) -> DataFrame:
    """Columns of a public trade archive (id, price, qty, quote_qty, time, is_buyer_maker) to canonical trades.

    Times of 1e14 or more are microseconds. `in_order` tells whether a row's time is no earlier than its predecessor's by
    id: within a million ids by a window, for the first row of these from the last row of the nearest million before.
    """
    us = F.when(F.col("time") >= 100_000_000_000_000, F.col("time")).otherwise(F.col("time") * 1000)
    rows = rows.withColumns({"__us": us, "__chunk": F.floor(F.col("id") / 1_000_000)})
    # the table of chunks has a row for each million ids
    ends = rows.groupBy("__chunk").agg(F.max_by("__us", "id").alias("__last"))
    ends = ends.select(F.col("__chunk").alias("__k"), F.lag("__last").over(Window.orderBy("__chunk")).alias("__carried"))
    by_id = Window.partitionBy("__chunk").orderBy("id")
    before = F.when(F.row_number().over(by_id) == 1, F.col("__carried")).otherwise(F.lag("__us").over(by_id))
    out = rows.join(ends, F.col("__chunk") == F.col("__k"), "left").select(
        F.timestamp_micros("__us").alias("event_timestamp"), F.lit(venue).alias("venue"), F.lit(instrument).alias("instrument"), F.col("id").cast("string").alias("trade_id"),
        F.concat_ws(":", F.lit(venue), F.lit(instrument), F.col("id")).alias("event_id"), F.col("price").cast("double").alias("price"), F.col("qty").cast("double").alias("quantity"),
        F.when(F.col("is_buyer_maker"), "sell").otherwise("buy").alias("taker_side"), F.coalesce(F.col("__us") >= before, F.lit(True)).alias("in_order"))
    return out


def text_missing(*columns: str) -> Column:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(F.trim(c) == "", F.lit(True))
    return bad


def number_bad(c: str) -> Column:
    """Not a finite number of 0 or more."""
    x = F.expr(f"try_cast({c} AS DOUBLE)")
    return F.coalesce(F.isnan(x) | (x < 0) | (x == float("inf")), F.lit(True))


def first_error(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that a row breaks, else null."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(broken, name).otherwise(out)
    return out


def validate_trades(raw: DataFrame) -> DataFrame:
    """Adds error: the first rule that a trade breaks; lower-cases the venue, upper-cases the instrument."""
    return raw.withColumns({"venue": F.lower("venue"), "instrument": F.upper("instrument"), "error": first_error(
        ("schema_version", F.coalesce(F.col("schema_version") != 1, F.lit(True))),
        ("text", text_missing("event_id", "venue", "instrument", "trade_id")),
        ("price", number_bad("price")), ("quantity", number_bad("quantity")),
        ("timestamp", F.coalesce(F.col("exchange_ts_ms") <= 0, F.lit(True)) | F.coalesce(F.col("received_ts_ms") <= 0, F.lit(True))),
        ("taker_side", ~F.coalesce(F.col("taker_side").isin("buy", "sell"), F.lit(False))))})


def validate_books(books: DataFrame, depth: int = 15) -> DataFrame:
    """Books (arrays of price, quantity structs, best first): capped, crossed or one-sided ones told by error."""
    cut = books.withColumns({"bids": F.slice("bids", 1, depth), "asks": F.slice("asks", 1, depth), "exchange_ts_ms": F.coalesce("exchange_ts_ms", "received_ts_ms")})
    empty = (F.coalesce(F.size("bids"), F.lit(0)) < 1) | (F.coalesce(F.size("asks"), F.lit(0)) < 1)
    return cut.withColumns({"depth": F.least(F.greatest(F.size("bids"), F.size("asks")), F.lit(depth)), "error": first_error(("empty", empty), ("crossed", F.get("bids", F.lit(0))["price"] >= F.get("asks", F.lit(0))["price"]))})


def uncross_asks(books: DataFrame) -> DataFrame:
    """Asks at or below the best bid go; a book without asks left is told by error."""
    out = books.withColumn("asks", F.filter("asks", lambda a: a["price"] > F.get("bids", F.lit(0))["price"]))
    return out.withColumn("error", F.when(F.size("asks") == 0, "crossed"))


def partition_keys(rows: DataFrame, *names: str) -> DataFrame:
    """Path-safe keys, date and hour of the event time, or of the arrival where there is none."""
    at = F.coalesce("event_timestamp", "received_timestamp")
    safe = {n: F.regexp_replace(n, "[^A-Za-z0-9_.-]+", "_") for n in names}
    return rows.withColumns(safe | {"date": F.date_format(at, "yyyy-MM-dd"), "hour": F.date_format(at, "HH")})


def split_dead(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL")


def latest_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the last in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Matched rows are the source's, the rest of both stays. Source keys are unique."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source)


def replace_slice(target: DataFrame, new: DataFrame, inside: Column) -> DataFrame:
    """Target rows of the slice go, new rows of the slice come; new rows outside it are left out."""
    return target.where(~F.coalesce(inside, F.lit(False))).unionByName(new.where(inside))


def append_dedup(existing: DataFrame, new: DataFrame, keys: list[str], ordinal: str | None = None) -> DataFrame:
    """Existing rows and new ones, of each key the last: a new row before an existing one, and of new rows of a key the one
    with the largest `ordinal` (a column of `new`, which goes unless `existing` has it); without one, the largest by all
    other columns, so that the choice is the same on every run.
    """
    place = F.col(ordinal) if ordinal else F.struct(*[c for c in sorted(new.columns) if c not in keys])
    late = new.withColumn("__at", F.struct(F.lit(1), F.rank().over(Window.partitionBy(*keys).orderBy(place))))
    late = late.drop(ordinal) if ordinal and ordinal not in existing.columns else late
    both = existing.withColumn("__at", F.struct(F.lit(0), F.lit(0))).unionByName(late)
    return latest_by(both, keys, F.desc("__at")).drop("__at")


def prepare_bars(raw: DataFrame, numeric: list[str]) -> DataFrame:
    """Rows without a timestamp go, of equal ones the last stays, numbers are parsed or null."""
    if missing := [c for c in ("timestamp", "venue", *numeric) if c not in raw.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rows = raw.withColumn("timestamp", F.expr("try_cast(timestamp AS TIMESTAMP)")).where("timestamp IS NOT NULL")
    return latest_by(rows, ["venue", "timestamp"], F.desc("ordinal")).withColumns({c: F.expr(f"try_cast({c} AS DOUBLE)") for c in numeric})


def fresh(at: Column, now: Column, most: int, skew: int) -> Column:
    """Reason why a time isn't usable now (seconds), else null."""
    age = now - at
    return F.when(at.isNull(), "missing").when(age > most, "stale").when(age < -skew, "future")


def validate_features(rows: DataFrame, required: list[str], as_of: int) -> DataFrame:
    """Violations by kind, in one pass."""
    kinds = {"blank_asset": text_missing("asset"), "after_as_of": F.col("bucket") > as_of} | {f"null_{c}": F.col(c).isNull() for c in required}
    one = rows.agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*kinds))).alias("violation", "n"))


def training_violations(rows: DataFrame, targets: list[str], at: str = "bucket", frequencies: list[str] | None = None) -> DataFrame:
    """One row with what is wrong with a training set, in one pass: n_rows, n_null_time, a count of usable rows for each
    target (usable_<target>), and missing_frequencies (of those asked for).
    """
    has = [F.count_if(F.col(c).isNotNull() & ~F.isnan(c)).alias(f"usable_{c}") for c in targets]
    wanted = F.array(*map(F.lit, frequencies or [])).cast("array<string>")
    seen = F.collect_set(F.when(F.col("frequency").isin(frequencies), F.col("frequency"))) if frequencies else F.first(wanted)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(at).isNull()).alias("n_null_time"), *has, F.array_except(wanted, F.coalesce(seen, F.array().cast("array<string>"))).alias("missing_frequencies"))


def validate_training(rows: DataFrame, targets: list[str], at: str = "bucket", frequencies: list[str] | None = None) -> DataFrame:
    """The rows, if they can be trained on; else an error that says why not: a target column that isn't there, no rows, a
    null time, a target without a usable row, a frequency (column frequency) without a row.
    """
    if missing := sorted(set(targets) - set(rows.columns)):
        raise ValueError(f"training data has no {', '.join(missing)}")
    if frequencies and "frequency" not in rows.columns:
        raise ValueError("training data has no frequency")
    found = training_violations(rows, targets, at, frequencies).first()
    if not found.n_rows:
        raise ValueError("training data is empty")
    if found.n_null_time:
        raise ValueError(f"training data has {found.n_null_time} rows without a time")
    if empty := [c for c in targets if not found[f"usable_{c}"]]:
        raise ValueError(f"training data has no usable row of {', '.join(empty)}")
    if found.missing_frequencies:
        raise ValueError(f"training data lacks {', '.join(sorted(found.missing_frequencies))}")
    return rows


def envelope(rows: DataFrame, fields: dict[str, str], version: str, feature_set: str = "market_features", created: Column | None = None) -> DataFrame:
    """Feature rows (asset, bucket in epoch seconds, available in epoch seconds, the fields) as JSON in a column envelope."""
    stamp = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    made = F.col("available") if created is None else created
    head = [F.lit(feature_set).alias("feature_set"), F.lit(version).alias("feature_version"), F.col("asset").alias("asset")]
    times = [x for name, c in (("event", F.col("bucket")), ("available", F.col("available")), ("created", made)) for x in (stamp(c).alias(f"{name}_timestamp"), (c * 1000).alias(f"{name}_timestamp_ms"))]
    values = F.struct(*[F.col(name).cast(kind).alias(name) for name, kind in fields.items()])
    return rows.select(F.to_json(F.struct(*head, *times, values.alias("values")), {"ignoreNullFields": "false"}).alias("envelope"))


def flatten_envelope(rows: DataFrame, fields: dict[str, str], version: str, feature_set: str = "market_features", text: str = "envelope") -> DataFrame:
    """One typed row an envelope: asset, bucket, available and created (epoch seconds), the fields (name: type), and error.

    error is the first of: json (no object), feature_set, feature_version, asset, event_timestamp, values (no object), and
    missing:<field> or type:<field> for a field that isn't there or isn't of its type; a field given as null is null.
    Times count as milliseconds where these are given, else as ISO texts.
    """
    x = rows.withColumn("__e", F.from_json(text, "map<string,string>")).withColumn("__v", F.from_json(F.col("__e")["values"], "map<string,string>"))
    of = lambda name: F.try_element_at("__e", F.lit(name))
    seconds = lambda name: F.coalesce(F.floor(of(f"{name}_timestamp_ms").try_cast("long") / 1000), F.unix_seconds(F.try_to_timestamp(of(f"{name}_timestamp"))))
    asset = F.coalesce(of("asset"), F.get_json_object(of("entity"), "$.asset"), F.try_element_at("__v", F.lit("asset")))
    rules = [("json", F.col("__e").isNull()), ("feature_set", F.coalesce(of("feature_set") != feature_set, F.lit(True))), ("feature_version", F.coalesce(of("feature_version") != version, F.lit(True))),
             ("asset", F.coalesce(F.trim(asset) == "", F.lit(True))), ("event_timestamp", seconds("event").isNull()), ("values", F.col("__v").isNull())]
    out = {}
    for name, kind in fields.items():
        given = F.try_element_at("__v", F.lit(name))
        out[name] = given.try_cast(kind)
        rules += [(f"missing:{name}", ~F.coalesce(F.map_contains_key("__v", F.lit(name)), F.lit(False))), (f"type:{name}", given.isNotNull() & out[name].isNull())]
    return x.select(asset.alias("asset"), seconds("event").alias("bucket"), seconds("available").alias("available"), seconds("created").alias("created"), *[c.alias(n) for n, c in out.items()], first_error(*rules).alias("error"))


def contract_metadata(rows: DataFrame) -> DataFrame:
    """Strike from the first field that has one, checked against the ticker's suffix; only above-strike types."""
    strike = F.coalesce(*[F.expr(f"try_cast({c} AS DOUBLE)") for c in ("floor_strike", "functional_strike", "strike")])
    suffix = F.expr(r"try_cast(nullif(regexp_extract(market_ticker, '-T(\\d+(?:\\.\\d+)?)$', 1), '') AS DOUBLE)")
    return rows.withColumn("parsed", strike).withColumn("error", first_error(("strike", F.col("parsed").isNull() & suffix.isNull()), ("mismatch", F.col("parsed").isNotNull() & suffix.isNotNull() & (F.col("parsed") != suffix)), ("type", ~F.coalesce(F.col("strike_type").isin("above", "greater"), F.lit(False))))).withColumn("parsed", F.coalesce("parsed", suffix))


def choose_event(events: DataFrame, now: int, soon: int = 7200) -> DataFrame:
    """Of each series the nearest event that is to come and not closed, within `soon` seconds first."""
    left = F.col("when") - now
    open_ = events.where((left > 0) & (F.col("status") != "closed"))
    return open_.groupBy("series").agg(F.min_by("event_ticker", F.struct((left > soon).cast("int"), "when", "event_ticker")).alias("event_ticker"))
