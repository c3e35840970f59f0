"""Windows over globally ordered series, without one task for a whole series.

in_chunks: any steps that look back or ahead by a bounded time, run on chunks of time with a halo. carried, previous,
before_chunk: the last value so far, or the row before, from a window inside the chunk and a small table with a row a
chunk. halo_window: bounded frames. Each row goes to the chunk of time that owns it and to those whose frames reach it;
the window runs inside chunks, and only owned rows stay. carry_scan: running recurrences of the affine kind
y = a*y' + b (cumulative sums: a = 1; exponential averages: a constant a). Rows are sorted into ranges once; a range gives
one affine map, maps are scanned over a row a range, and each range finishes from its carry.

What is read twice, for the small table and for the rows, is written down once before (`voltide.sources.shared.cut`), so
an input is computed once however steps are nested.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.sources.shared import cut, shuffle_partitions

DAY = 86_400


def in_chunks(df: DataFrame, at: str, by: list[str], steps: Callable[[DataFrame, list[str]], DataFrame], back: int, ahead: int = 0, chunk: int = DAY) -> DataFrame:
    """steps(rows, keys) on the rows of each chunk of time and those at most `back` seconds before and `ahead` seconds after.

    `at` holds whole epoch seconds. The steps partition their windows by the keys that they are given, and no window of
    theirs may reach beyond those bounds; rows outside a chunk are only there to be looked at.
    """
    own = F.floor(F.col(at) / chunk)
    first, last = F.floor((F.col(at) - ahead) / chunk), F.floor((F.col(at) + back) / chunk)
    spread = df.withColumn("__own", own).withColumn("__chunk", F.explode(F.sequence(first, last)))
    return steps(spread, [*by, "__chunk"]).where("__chunk = __own").drop("__own", "__chunk")


def halo_window(df: DataFrame, at: str, by: list[str], columns: dict, back: int, ahead: int = 0, chunk: int = DAY) -> DataFrame:
    """Adds `columns` (name: function from a window specification to a Column), by `in_chunks`. Every frame must lie within the bounds."""

    def steps(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(at)
        return rows.select("*", *[f(w).alias(name) for name, f in columns.items()])

    return in_chunks(df, at, by, steps, back, ahead, chunk)


def before_chunk(rows: DataFrame, by: list[str], ends: dict[str, Column], chunk: str = "__chunk") -> DataFrame:
    """Adds, for each of `ends` (name: aggregate over a chunk), its last value that isn't null among the chunks before.

    One row a key and chunk reaches the window, not one a row.
    """
    rows = cut(rows)
    table = rows.groupBy(*by, chunk).agg(*[e.alias(name) for name, e in ends.items()])
    before = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, chunk]
    table = table.select(*[F.col(c).alias(f"__of_{c}") for c in keys], *[F.last(name, ignorenulls=True).over(before).alias(name) for name in ends])
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return rows.join(table, on, "left").drop(*[f"__of_{c}" for c in keys])


def previous(df: DataFrame, at: str, by: list[str], columns: dict[str, Column], chunk: int = DAY, ties: tuple[str, ...] = (), unit: int = 1) -> DataFrame:
    """Adds each of `columns` (name: value of a row) as it is in the row before, in order of `at` (whole epoch seconds, or
    parts of a second of which `unit` make one) and then of `ties`; null in a key's first row.
    """
    order = (at, *ties)
    rows = df.withColumn("__chunk", F.floor(F.col(at) / (chunk * unit))).withColumn("__now", F.struct(*[v.alias(name) for name, v in columns.items()]))
    rows = before_chunk(rows, by, {"__before": F.max_by("__now", F.struct(*order))})
    inside = Window.partitionBy(*by, "__chunk").orderBy(*order)
    rows = rows.withColumn("__last", F.when(F.row_number().over(inside) > 1, F.lag("__now").over(inside)).otherwise(F.col("__before")))
    return rows.select(*df.columns, *[F.col(f"__last.{name}").alias(name) for name in columns])


def carried(df: DataFrame, at: str, by: list[str], columns: list[str], chunk: int = DAY) -> DataFrame:
    """The columns filled with their last value that isn't null, up to each row in order of `at` (epoch seconds)."""
    rows = df.withColumn("__chunk", F.floor(F.col(at) / chunk))
    rows = before_chunk(rows, by, {f"__before_{c}": F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))) for c in columns})
    so_far = Window.partitionBy(*by, "__chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(so_far), f"__before_{c}") for c in columns})
    return filled.select(*df.columns)


def affine(a: np.ndarray, b: np.ndarray, y: float) -> np.ndarray:
    """y_t = a_t * y_(t-1) + b_t from `y` before the first, in rounds that double what each entry has taken in."""
    a, b = a.copy(), b.copy()
    k = 1
    while k < len(a):
        b[k:] += a[k:] * b[:-k]
        a[k:] *= a[:-k]
        k *= 2
    return a * y + b


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of a range with a, b and first values, and which rows begin a key; of the range's own first row that is
    not known here, and it counts as none.
    """
    last = None
    for batch in batches:
        if batch.num_rows:
            keys = batch.column("__key").to_numpy(zero_copy_only=False)
            begins = np.r_[last is not None and keys[0] != last, keys[1:] != keys[:-1]]
            last = keys[-1]
            yield batch, *[batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("__a", "__b", "__f")], begins


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a range: its first row's values, the map of all rows behind that one, and its first and last keys."""
    whole, top, key = np.array([1.0, 0.0]), None, None
    for batch, a, b, f, begins in _parts(batches):
        if top is None:
            top, key = [a[0], b[0], f[0]], batch.column("__key")[0].as_py()
            a[0], b[0] = 1.0, 0.0
        a, b = np.where(begins, 0.0, a), np.where(begins, f, b)
        whole = np.array([a.prod() * whole[0], affine(a, b, whole[1])[-1]])
        part, last = batch.column("__part")[0].as_py(), batch.column("__key")[-1].as_py()
    if top is not None:
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "a": [top[0]], "b": [top[1]], "f": [top[2]], "all_a": [whole[0]], "all_b": [whole[1]], "key": [key], "last": [last]})


def carry_scan(df: DataFrame, at: str, by: list[str], a: Column, b: Column, out: str, chunk: int | None = None, first: Column | None = None, levels: int | None = None, before: str | None = None) -> DataFrame:
    """Adds `out`, y_t = a_t * y_(t-1) + b_t in order of `at`, with y = 0 before the first row (or `first` as the first
    row's value), and with `before` the value before each row's own, null in the first. Times of a key differ.

    The rows are sorted by key and time into ranges and written down once; the first pass makes a row a range, which the
    driver scans, the second finishes each range from its carry. Work grows with the rows, whatever the length of a series.
    `chunk` and `levels` belonged to an earlier form and are not used.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installation of this module
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    order = [F.col(c).asc_nulls_first() for c in [*by, at]]
    rows = df.select("*", key.alias("__key"), a.cast("double").alias("__a"), b.cast("double").alias("__b"), (b if first is None else first).cast("double").alias("__f"))
    rows = cut(rows.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    ends = rows.select("__key", "__a", "__b", "__f", "__part").mapInArrow(_ends, "part int, a double, b double, f double, all_a double, all_b double, key string, last string")
    carries, y, last = {}, 0.0, None
    for r in sorted(ends.collect()):  # a row a range
        carries[r.part] = y if r.key == last else None
        y, last = r.all_a * (r.a * y + r.b if r.key == last else r.f) + r.all_b, r.last

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = None
        for batch, a, b, f, begins in _parts(batches):
            if y is None:
                carry = carries[batch.column("__part")[0].as_py()]
                begins[0], y = carry is None, carry or 0.0
            values = affine(np.where(begins, 0.0, a), np.where(begins, f, b), y)
            own = [batch.column(k) for k in range(batch.num_columns - 5)]
            own.append(pa.array(values))
            if before:
                own.append(pa.array(np.r_[y, values[:-1]], mask=begins))
            y = values[-1]
            yield pa.RecordBatch.from_arrays(own, [f.name for f in schema])

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType()), *([T.StructField(before, T.DoubleType())] if before else [])])
    return rows.select(*df.columns, "__key", "__a", "__b", "__f", "__part").mapInArrow(finish, schema)
