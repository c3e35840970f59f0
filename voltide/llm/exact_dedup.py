"""Exact dedup over a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. New rows are reduced to one candidate a digest, freed of
known digests by a sort-merge anti-join, and appended; so a later batch never re-reads earlier texts. Texts equal up
to blanks share a digest.

Defined cases: a null text counts as empty; empty texts form a group; a null id sorts after every id; of rows that
repeat id and text exactly one stays; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, cut, identified, table, text_of, written

#: Digests that more than one in HEAVY of the rows share are joined by broadcast; there are fewer than HEAVY of them.
HEAVY = 1000


def digests_of(df: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row a document: row, id, digest of the text without blanks, code points of the original text."""
    text = text_of(text_col)
    return df.select(
        F.col(row_col).alias("row"),
        F.col(id_col).alias("doc_id"),
        F.sha2(F.regexp_replace(text, f"{BLANK}+", "").cast("binary"), 256).alias("digest"),
        F.length(text).cast("long").alias("n_chars"),
    )


class DigestIndex:
    """A digest table in the warehouse, bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name = spark, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        # one writer a bucket: the rows arrive by digest, in as many parts as there are buckets
        (rows.repartition(self.buckets, "digest").write.format("parquet").mode("append")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))

    def add(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Adds a batch; returns a row for each of its rows: doc_id, keep_id, group_size (in the batch), kept, text_sha256.

        Of a new digest the row with most code points, then smallest id, stays; of a known digest none of the batch stays.
        A named batch may be added again, after a failure: what it appended before counts as its own.
        """
        rows, row = identified(df, id_col, text_col)
        rows = cut(digests_of(rows, row, id_col, text_col))
        best = rows.groupBy("digest").agg(
            F.count(F.lit(1)).alias("group_size"),
            F.min_by(F.struct("doc_id", "row"), F.struct((-F.col("n_chars")).alias("shorter"), "row")).alias("best"),
        )
        best = cut(best.select("digest", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")))
        batch = batch or uuid.uuid4().hex
        entries = lambda rows: rows.select("digest", "keep_id", F.col("keep_row").alias("index_row"), F.lit(batch).alias("batch"))
        if not self.exists():
            self.append(entries(best.limit(0)))  # a new index is empty, and its first batch takes the way of all others
        self.append(entries(best.join(self.read().hint("merge"), "digest", "left_anti")))
        index = self.read().select("digest", F.col("keep_id").alias("index_id"), "index_row", F.col("batch").alias("of_batch"))
        groups = best.select("digest", "group_size").join(index.hint("merge"), "digest")
        total = rows.count()
        heavy = groups.where(F.col("group_size") * HEAVY > total)  # fewer than HEAVY rows, whatever the input
        light = groups.where(F.col("group_size") * HEAVY <= total)
        in_heavy = rows.join(F.broadcast(heavy), "digest")
        in_light = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(light.hint("merge"), "digest")
        return in_heavy.unionByName(in_light).select(
            "doc_id",
            F.col("index_id").alias("keep_id"),
            "group_size",
            ((F.col("row") == F.col("index_row")) & (F.col("of_batch") == batch)).alias("kept"),
            F.col("digest").alias("text_sha256"),
            "row",
        )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: str | None = None, batch: str | None = None) -> DataFrame:
    """Verdicts of a batch against a named index, or against a new one, which goes when the verdicts are written."""
    spark = df.sparkSession
    if index:
        return DigestIndex(spark, index).add(df, id_col, text_col, batch)
    name = f"digest_index_{uuid.uuid4().hex}"
    out = written(DigestIndex(spark, name).add(df, id_col, text_col), "exact-dedup")
    spark.sql(f"DROP TABLE {name}")
    return out


def kept_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: str | None = None) -> DataFrame:
    """The rows of `df` that stay, with all of its columns."""
    rows, row = identified(df, id_col, text_col)
    kept = exact_dedup(rows, row, text_col, index).where("kept").select(F.col("row").alias(row))
    return rows.join(kept, row, "left_semi").select(*df.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("row")


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
"""
