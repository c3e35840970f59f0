"""Registration of queries: a Spark callable and, where SQL can say it, DuckDB SQL over the same tables."""

from __future__ import annotations

from voltide.sources import adapters

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None, tables: str = ""):
    """Registers a query. `tables` are common table expressions placed before `sql`, after those of the adapters."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {adapters.SQL}{',' + tables if tables else ''}\n{sql}"
        return f

    return put


def secs(column: str) -> str:
    """Epoch seconds of a DuckDB timestamp."""
    return f"(epoch_us({column}) // 1000000)"


HOUR = 3600
#: Hourly bars with their books on a full grid, as DuckDB expressions.
BUCKET = "(epoch_us(event_timestamp) // 3600000000 * 3600)"
_WIDE = ", ".join(f"max(CASE WHEN side = '{s}' AND level = {k} THEN {c} END) AS {x}_{s}_{k}" for s in ("bid", "ask") for k in range(1, 11) for x, c in (("p", "price"), ("q", "quantity")))
_BOOK = [f"{x}_{s}_{k}" for s in ("bid", "ask") for k in range(1, 11) for x in "pq"]
TRADE_BARS = f"""
timed AS (SELECT *, (epoch_us(event_timestamp) - lag(epoch_us(event_timestamp)) OVER (PARTITION BY venue, instrument ORDER BY event_timestamp, received_timestamp, trade_id NULLS FIRST)) / 1000.0::DOUBLE AS dt_ms FROM deduped),
trade_bars AS (SELECT {BUCKET} AS bucket, venue, instrument,
  first(price ORDER BY event_timestamp, received_timestamp, trade_id NULLS FIRST) AS p_open, max(price) AS p_high, min(price) AS p_low,
  last(price ORDER BY event_timestamp, received_timestamp, trade_id NULLS FIRST) AS p_close, avg(price) AS p_trade_mean,
  sum(quantity) AS v_trade, sum(CASE taker_side WHEN 'buy' THEN quantity ELSE 0 END) AS v_buy, sum(CASE taker_side WHEN 'sell' THEN quantity ELSE 0 END) AS v_sell,
  count(*) FILTER (quantity > 0) AS cnt_trade, avg(dt_ms) AS dt_fill_mean_ms, max(dt_ms) AS dt_fill_max_ms, min(dt_ms) AS dt_fill_min_ms
  FROM timed GROUP BY ALL),
latest AS (SELECT {BUCKET} AS bucket, venue, instrument, side, level, last(price ORDER BY event_timestamp, received_timestamp) AS price, last(quantity ORDER BY event_timestamp, received_timestamp) AS quantity FROM book_levels GROUP BY ALL),
wide AS (SELECT bucket, venue, instrument, {_WIDE} FROM latest GROUP BY ALL),
grid AS (SELECT unnest(range(low, high + 3600, 3600)) AS bucket, venue, instrument FROM
  (SELECT DISTINCT venue, instrument FROM deduped), (SELECT min({BUCKET}) AS low, max({BUCKET}) AS high FROM deduped))"""
BARS = TRADE_BARS + f""",
bars AS (SELECT bucket, venue, instrument, p_open, p_high, p_low, p_close, p_trade_mean, coalesce(v_trade, 0) AS v_trade, coalesce(v_buy, 0) AS v_buy, coalesce(v_sell, 0) AS v_sell,
  coalesce(cnt_trade, 0) AS cnt_trade, dt_fill_mean_ms, dt_fill_max_ms, dt_fill_min_ms,
  {', '.join(f'last_value({c} IGNORE NULLS) OVER w AS {c}' for c in _BOOK)}
  FROM grid LEFT JOIN trade_bars USING (bucket, venue, instrument) LEFT JOIN wide USING (bucket, venue, instrument)
  WINDOW w AS (PARTITION BY venue, instrument ORDER BY bucket ROWS UNBOUNDED PRECEDING))"""
SYNTHETIC = BARS + """,
synthetic AS (SELECT 'SYN' AS asset, bucket, avg(coalesce(p_trade_mean, p_close)) AS synthetic_price, count(coalesce(p_trade_mean, p_close)) AS venue_count, sum(v_buy) AS v_buy FROM bars GROUP BY bucket),
returns AS (SELECT *, ln(CASE WHEN synthetic_price / lag(synthetic_price) OVER (ORDER BY bucket) > 0 THEN synthetic_price / lag(synthetic_price) OVER (ORDER BY bucket) END) AS log_return FROM synthetic)"""
