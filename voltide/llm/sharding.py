"""Contiguous shards of equal bytes by global prefix sums.

Documents are put in order of their id and dealt to partitions by ranges; partition totals give each document the number
of bytes before it in the whole corpus. A document goes to the shard whose stretch, of an equal share of all bytes, holds
the document's middle, so shards are contiguous in that order and miss their share by less than the document at either
end. Only ids, sizes and checksums are shuffled, and slots come from the same sums: a row's number in the corpus less the
first number of its shard.

Defined cases: a null text has no bytes (size 16, checksum 0), and so has an empty one; null ids come last; repeated ids
are documents of their own, in order of size and checksum, and equal rows are told apart by the scan alone, which their
values don't show; a document of more than a share leaves shards beside it empty; texts are never split, however long;
an empty table gives an empty result; further columns are ignored by `assign` and kept by `write_shards`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import identified, shuffle_partitions, table, text_of
from .prefix_sums import running

SHARDS = 40
#: What a document takes in a shard besides its text.
OVERHEAD = 16


def assign(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """A row a document: doc_id, size, text_crc32, shard (0 to shards - 1) and slot (its place in the shard, from 0)."""
    text = text_of(text_col)
    rows = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("text_crc32")]
    rows = running(rows, order, {"bytes_upto": F.col("size"), "rows_upto": F.lit(1)})
    every = rows.agg(F.max("bytes_upto")).first()[0] or 1
    # the middle of the document in half bytes, in a type that a petabyte times the number of shards doesn't overflow
    middle = (2 * F.col("bytes_upto") - F.col("size")).cast("decimal(38,0)")
    rows = rows.withColumn("middle", middle).withColumn("shard", F.expr(f"int(middle * {shards} div {2 * every})"))
    first = rows.groupBy("shard").agg(F.min("rows_upto").alias("first"))  # a row a shard
    return rows.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rows_upto") - F.col("first")).alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the rows with all their columns, in order of slot, as Parquet under shard=0, shard=1 and so on.

    Files are ranges of shard and slot, so a large shard is written by many tasks.
    """
    rows, row = identified(df, id_col, text_col)
    placed = assign(rows, shards, row, text_col).select(F.col("doc_id").alias("__of"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    own = [F.col(c).alias(f"__own_{c}") for c in df.columns]  # so that no name of theirs is in the way
    rows = rows.select(F.col(row).alias("__at"), *own).join(placed, F.col("__at") == F.col("__of"))
    rows = rows.repartitionByRange(max(shards, shuffle_partitions(df.sparkSession)), "__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    names = {c: c if c.lower() not in ("shard", "slot") else f"{c}_before" for c in df.columns}
    rows.select(F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), *[F.col(f"__own_{c}").alias(n) for c, n in names.items()]).write.partitionBy("shard").parquet(path)


def op11_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 comes from its polynomial: the table of 256 remainders, then a fold over the bytes of a text.
SQL = r"""
WITH b AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda r, k: xor(r >> 1, (r & 1) * 3988292384)) ORDER BY n) AS rest FROM (SELECT unnest(range(256)) AS n)),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size,
             [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda r, x: xor(r >> 8, rest[(xor(r, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d, b),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS LAST, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS every FROM c),
s AS (SELECT *, ((2 * upto - size) * 40 // (2 * every))::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, size, text_crc32) - 1 AS slot, NULL::INT AS grown_shard
FROM s
"""
