"""Joins of time series: grids, as-of, alignment, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bars import KEYS, SIDES
from .timeseries import DAY, before_chunk


def book_grid(grid: DataFrame, book: DataFrame, depth: int = 10) -> DataFrame:
    """The grid by side and level, with the book's latest level where there is one."""
    long = grid.select("*", F.explode(F.array(*map(F.lit, SIDES))).alias("side")).select("*", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("level"))
    return long.join(book, ["bucket", *KEYS, "side", "level"], "left")


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], strict: bool = False, chunk: int = DAY) -> DataFrame:
    """Each left row with the values of the last right row at or before it (before it, if strict), and matched_at.

    One union, sorted in chunks of `chunk` units of `at` (seconds, for timestamps); a chunk begins with the last right row
    of those before it. Right rows sort before left rows of the same time, or after them if strict.
    """
    first, second = (1, 0) if strict else (0, 1)
    r = right.select(*by, at, F.lit(first).alias("__side"), F.struct(F.col(at).alias("matched_at"), *values).alias("__match"))
    l = left.withColumn("__row", F.struct(*left.columns)).select(*by, at, F.lit(second).alias("__side"), "__row")
    units = F.unix_seconds(at) if dict(left.dtypes)[at].startswith("timestamp") else F.col(at)
    both = r.unionByName(l, allowMissingColumns=True).withColumn("__chunk", F.floor(units / chunk))
    both = before_chunk(both, by, {"__before": F.max_by("__match", F.when(F.col("__side") == first, F.col(at)))})
    w = Window.partitionBy(*by, "__chunk").orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("__match", F.coalesce(F.last("__match", ignorenulls=True).over(w), "__before"))
    return both.where(F.col("__side") == second).select("__row.*", "__match.*")


def align_venues(bars: DataFrame, value: str, venues: list[str]) -> DataFrame:
    """One row a bucket, a column a venue, from the long form; no chain of outer joins."""
    return bars.groupBy("bucket").agg(*[F.max(F.when(F.col("venue") == v, F.col(value))).alias(v) for v in venues], F.count(value).alias("n_venues"))


def missing_days(seen: DataFrame) -> DataFrame:
    """Days between a venue's first and last seen day that aren't seen."""
    span = seen.groupBy("venue").agg(F.min("day").alias("low"), F.max("day").alias("high"))
    return span.select("venue", F.explode(F.sequence("low", "high")).alias("day")).join(seen, ["venue", "day"], "left_anti")


def chosen_venues(bars: DataFrame, venues: list[str]) -> DataFrame:
    """Rows of the venues; a venue without any is an error."""
    out = bars.where(F.col("venue").isin(venues))
    present = {r.venue for r in out.select("venue").distinct().limit(len(venues) + 1).collect()}
    if missing := sorted(set(venues) - present):
        raise ValueError(f"no bars of {', '.join(missing)}")
    return out


def training_table(features: DataFrame, labels: DataFrame, now: int, required: list[str], by: tuple[str, ...] = ("asset", "bucket")) -> DataFrame:
    """Features with the labels of their moment, point in time: only labels whose window has ended by `now` (epoch seconds)
    and that have every target of `required`.
    """
    full = F.lit(True)
    for c in required:
        full = full & F.col(c).isNotNull()
    return features.join(labels.where((F.col("label_window_end") <= now) & full), list(by))


def latest_state(rows: DataFrame, state: DataFrame, at: str, state_at: str, values: list[str], most: int = 60, skew: int = 2) -> DataFrame:
    """Rows with the newest state's values, null where the state is more than `most` seconds older than the row or more than
    `skew` seconds newer; `at` and `state_at` in epoch seconds. However many rows the state has, one is joined.
    """
    newest = state.agg(F.max_by(F.struct(*values), state_at).alias("__state"), F.max(state_at).alias("__state_at"))
    age = F.col(at) - F.col("__state_at")
    out = rows.join(F.broadcast(newest))  # one row
    return out.select(*rows.columns, *[F.when(age.between(-skew, most), F.col(f"__state.{c}")).alias(c) for c in values])


def with_metadata(tickers: DataFrame, metadata: DataFrame, by: tuple[str, ...] = ("event_ticker", "market_ticker")) -> DataFrame:
    """Tickers with their contract's metadata (strike, status and what else there is), and metadata_reason: no_metadata,
    not_open, or null. Of several rows of a contract the one with the latest `updated_at` counts, or any where there is none.
    """
    rest = [c for c in metadata.columns if c not in by]
    newest = F.max_by(F.struct(*rest), "updated_at") if "updated_at" in rest else F.any_value(F.struct(*rest))
    one = metadata.groupBy(*by).agg(newest.alias("__m")).select(*by, "__m.*")
    out = tickers.join(one, list(by), "left")
    return out.withColumn("metadata_reason", F.when(F.col("strike").isNull(), "no_metadata").when(~F.coalesce(F.col("status").isin("open", "active"), F.lit(False)), "not_open"))
