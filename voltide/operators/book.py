"""Consolidated order books: freshness, fees, ticks, netting of crossed levels, deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof
from .timeseries import DAY


def normalize_levels(levels: DataFrame, keys: list[str], depth: int = 15) -> DataFrame:
    """Best first, `depth` a side; negative or non-finite levels are left out."""
    good = levels.where("price >= 0 AND quantity >= 0 AND price < double('Infinity') AND quantity < double('Infinity')")
    best = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    return good.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "side").orderBy(best))).where(F.col("rank") <= depth)


def fresh_books(levels: DataFrame, asof_us: DataFrame, most_us: int) -> DataFrame:
    """For each moment of `asof_us` (one column of that name): each venue's latest book published by then, and whether it is fresh."""
    books = levels.select("venue", F.unix_micros("received_timestamp").alias("us"), "event_id").groupBy("venue", "us").agg(F.max("event_id").alias("event_id"))
    venues = books.agg(F.collect_set("venue").alias("venues"))  # one row
    moments = asof_us.join(F.broadcast(venues)).select(F.explode("venues").alias("venue"), F.col("asof_us").alias("us"))
    held = asof(moments, books, ["venue"], "us", ["event_id"], chunk=DAY * 1_000_000).where("matched_at IS NOT NULL")
    return held.select(F.col("us").alias("asof_us"), "venue", "event_id", (F.col("us") - F.col("matched_at") <= most_us).alias("fresh"))


def effective_price(levels: DataFrame, fees: DataFrame) -> DataFrame:
    """Prices after each venue's fee (below 1): asks dearer, bids cheaper. fees: venue, fee; a small table."""
    fee = F.coalesce("fee", F.lit(0.0))
    return levels.join(fees, "venue", "left").withColumn("price", F.col("price") * F.when(F.col("side") == "bid", 1 - fee).otherwise(1 + fee)).drop("fee")


def finest_tick(levels: DataFrame, by: list[str]) -> DataFrame:
    """tick of each group: one unit of the finest decimal place that its prices use, up to nine."""
    digits = F.length(F.rtrim(F.substring_index(F.round(F.col("price"), 9).cast("decimal(28,9)").cast("string"), ".", -1), F.lit("0")))
    return levels.groupBy(*by).agg(F.max(digits).alias("n")).select(*by, F.pow(F.lit(10.0), -F.col("n")).cast("decimal(18,9)").alias("tick"))


def tick_bucket(levels: DataFrame, tick: float | None = None, by: list[str] | None = None) -> DataFrame:
    """Bids down, asks up to the tick, in exact decimals; without a tick, to the finest one that each group `by` uses."""
    rows = levels.withColumn("__tick", F.lit(tick).cast("decimal(18,9)")) if tick else levels.join(finest_tick(levels, by).withColumnRenamed("tick", "__tick"), by)
    n = F.round(F.col("price"), 9).cast("decimal(28,9)") / F.col("__tick")
    return rows.withColumn("price", (F.when(F.col("side") == "bid", F.floor(n)).otherwise(F.ceil(n)) * F.col("__tick")).cast("double")).select(*levels.columns)


def consolidate(levels: DataFrame, asof: list[str]) -> DataFrame:
    """Quantity of each side and price over venues, and who brings how much."""
    by_venue = levels.groupBy(*asof, "side", "price", "venue").agg(F.sum("quantity").alias("q"))
    return by_venue.groupBy(*asof, "side", "price").agg(F.sum("q").alias("quantity"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("venue", "q")))).alias("venues"))


def uncross(levels: DataFrame, asof: list[str]) -> DataFrame:
    """What is left of crossed levels once bids and asks net best against best, at level and venue grain.

    Closed form: each side's quantities, best first and venues by name, are intervals of a running total; the matched
    quantity is where the last overlapping pair with bid >= ask ends; a level keeps what lies beyond it.
    """
    best = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    level = levels.groupBy(*asof, "side", "price").agg(F.sum("quantity").alias("q"))
    run = Window.partitionBy(*asof, "side").orderBy(best).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = level.withColumn("stop", F.sum("q").over(run)).withColumn("start", F.col("stop") - F.col("q"))
    bids = level.where("side = 'bid'").select(*asof, F.col("price").alias("bid"), F.col("start").alias("b0"), F.col("stop").alias("b1"))
    asks = level.where("side = 'ask'").select(*asof, F.col("price").alias("ask"), F.col("start").alias("a0"), F.col("stop").alias("a1"))
    crossed = bids.join(asks, asof).where("bid >= ask AND least(b1, a1) > greatest(b0, a0)")  # within one book, levels are few
    matched = crossed.groupBy(*asof).agg(F.max(F.least("b1", "a1")).alias("matched"))
    fine = Window.partitionBy(*asof, "side").orderBy(best, "venue").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = levels.groupBy(*asof, "side", "price", "venue").agg(F.sum("quantity").alias("q")).withColumn("stop", F.sum("q").over(fine))
    out = out.join(matched, asof, "left")
    left = F.greatest(F.lit(0.0), F.col("stop") - F.greatest(F.col("stop") - F.col("q"), F.coalesce("matched", F.lit(0.0))))
    return out.withColumn("quantity", left).where("quantity > 1e-12").select(*asof, "side", "price", "venue", "quantity")


def book_summary(levels: DataFrame, asof: list[str], depth: int) -> DataFrame:
    """Best prices, mid, spread, depth and imbalance of the best `depth` levels."""
    near = normalize_levels(levels, asof, depth)
    of = lambda side, c: F.when(F.col("side") == side, F.col(c))
    out = near.groupBy(*asof).agg(F.max(of("bid", "price")).alias("best_bid"), F.min(of("ask", "price")).alias("best_ask"), F.coalesce(F.sum(of("bid", "quantity")), F.lit(0.0)).alias("bid_depth"), F.coalesce(F.sum(of("ask", "quantity")), F.lit(0.0)).alias("ask_depth"))
    both = F.col("bid_depth") + F.col("ask_depth")
    return out.withColumns({"mid": (F.col("best_bid") + F.col("best_ask")) / 2, "spread": F.col("best_ask") - F.col("best_bid"), "imbalance": (F.col("bid_depth") - F.col("ask_depth")) / F.when(both != 0, both)})


def apply_level_updates(updates: DataFrame, key: list[str]) -> DataFrame:
    """The book after absolute updates: of each level the last quantity of the last snapshot epoch; 0 deletes.

    updates: key, seq, kind (snapshot or delta), side, price, quantity; a snapshot's levels share its seq.
    """
    epoch = updates.where("kind = 'snapshot'").groupBy(*key).agg(F.max("seq").alias("epoch"))
    last = updates.join(epoch, key).where("seq >= epoch").groupBy(*key, "side", "price").agg(F.max_by("quantity", "seq").alias("quantity"))
    return last.where("quantity > 0")


def apply_book_deltas(updates: DataFrame, key: list[str], at: str = "seq") -> DataFrame:
    """The book after the last snapshot and the signed deltas behind it, by the gate of the whole book: in order of arrival
    (`at`) each delta's sequence must be above the last one taken, gaps allowed. Empty levels go.

    updates: key, seq, kind (snapshot or delta), side, price, quantity, and `at` if arrivals differ from sequences; rows of a
    snapshot share its seq; sides are those of a venue's or a contract's book. A delta that comes twice, its sequence with it,
    counts once. A stale delta, or one that would take its level below 0, is refused, and the book stays as it
    was: `rejected` tells how many were. A snapshot with a level below 0 is refused whole.
    """
    from .running_book import CONTRACT_SIDES, VENUE_SIDES, running_books

    price = F.struct(F.col("side"), F.col("price").cast("string").alias("price"), F.col("quantity").cast("string").alias("quantity"))
    snapshots = updates.where("kind = 'snapshot'").groupBy(*key, at, "seq", "kind").agg(F.collect_list(price).alias("levels"))  # of one book
    deltas = updates.where("kind <> 'snapshot'").select(*key, at, "seq", "kind", F.array(price).alias("levels"), "side", "price", "quantity").dropDuplicates([*key, at, "seq", "side", "price"])
    # of deltas that arrive at once the first by side and price counts first
    order = Window.partitionBy(*key, at).orderBy("seq", "side", "price")
    deltas = deltas.withColumn("__nth", F.row_number().over(order))
    fine = ~F.exists("levels", lambda x: F.coalesce(x["quantity"].try_cast("double") < 0, F.lit(True)))
    epoch = snapshots.where(fine).groupBy(*key).agg(F.max(at).alias("__epoch"))
    start = snapshots.join(epoch, key).where(F.col(at) == F.col("__epoch"))
    live = deltas.join(epoch, key).where(F.col(at) >= F.col("__epoch"))
    messages = start.select(*key, F.struct(F.col(at), F.lit(0).alias("nth")).alias("__order"), F.col("seq").alias("sequence"), "kind", "levels").unionByName(
        live.select(*key, F.struct(F.col(at), F.col("__nth").alias("nth")).alias("__order"), F.col("seq").alias("sequence"), "kind", "levels"))
    place = Window.partitionBy(*key).orderBy("__order")  # messages since the last snapshot of a book
    messages = messages.withColumn("place", F.row_number().over(place))
    verdicts = running_books(messages.drop("__order"), key, "place", True, VENUE_SIDES + CONTRACT_SIDES, 0).select(*key, "place", "reason")
    taken = messages.join(verdicts, [*key, "place"]).select(*key, "reason", F.inline("levels"))
    amount = F.when(F.col("reason").isNull(), F.col("quantity").cast("double")).otherwise(0.0)
    out = taken.groupBy(*key, "side", F.col("price").cast("double").alias("price")).agg(F.sum(amount).alias("quantity"), F.count_if(F.col("reason").isNotNull()).cast("int").alias("rejected"))
    return out.where("quantity > 0 OR rejected > 0")


def ladder(levels: DataFrame, asof: list[str], depth: int = 10) -> DataFrame:
    """Asks from the farthest in, then bids from the best out, with depth as a share of the deepest."""
    near = normalize_levels(levels, asof, depth)
    place = F.when(F.col("side") == "ask", depth + 1 - F.col("rank")).otherwise(depth + 1 + F.col("rank"))
    return near.select(*asof, place.alias("place"), "side", "price", "quantity", (100 * F.col("quantity") / F.max("quantity").over(Window.partitionBy(*asof))).alias("percent"))
