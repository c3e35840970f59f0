"""Running totals over a whole table in one global order, without one task for all rows.

Rows are dealt to partitions by ranges of the order and summed inside each; a table with a row a partition is scanned for
what comes before each of them, and every row adds its partition's carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], xors: dict[str, Column] | None = None) -> DataFrame:
    """Adds, for each of `sums` and `xors` (name: whole-number value of a row), the sum or exclusive or of the values of all
    rows up to this one, itself included, in the order given. The result is written down, so later steps see one order.

    Rows that the order doesn't tell apart are taken in the order of the scan, which also spreads a value that many rows
    share over partitions. Values are long and never null; an empty table stays empty.
    """
    total = {name: (F.sum, value) for name, value in sums.items()} | {name: (F.bit_xor, value) for name, value in (xors or {}).items()}
    rows = df.withColumns({f"__own_{name}": value.cast("long") for name, (_, value) in total.items()} | {"__scan": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(shuffle_partitions(df.sparkSession), *order, "__scan").withColumn("__part", F.spark_partition_id())
    so_far = Window.partitionBy("__part").orderBy(*order, "__scan").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = cut(rows.withColumns({name: f(f"__own_{name}").over(so_far) for name, (f, _) in total.items()}).drop("__scan"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("__part").agg(*[f(f"__own_{name}").alias(f"__all_{name}") for name, (f, _) in total.items()])
    carries = parts.select("__part", *[F.coalesce(f(f"__all_{name}").over(before), F.lit(0)).alias(f"__carry_{name}") for name, (f, _) in total.items()])
    rows = rows.join(F.broadcast(carries), "__part")  # a row a shuffle partition
    whole = {name: F.col(name) + F.col(f"__carry_{name}") if f is F.sum else F.col(name).bitwiseXOR(F.col(f"__carry_{name}")) for name, (f, _) in total.items()}
    return rows.withColumns(whole).select(*df.columns, *total)
