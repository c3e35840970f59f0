"""What the training-data operators share: tables, word splitting, shared folders and the label fold."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word characters are everything but the ASCII space and the control blanks from tab to carriage return.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors' Python workers, once a session, where PYTHONPATH doesn't."""
    context, top = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if getattr(context, "_voltide_shipped", False) or os.path.dirname(top) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="voltide-package-"), "voltide_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for at, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    out.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), os.path.dirname(top)))
    context.addPyFile(path)
    context._voltide_shipped = True


#: Rows and bytes that a Python worker is given at once.
BATCH_ROWS, BATCH_BYTES = 2000, "8m"


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's own, for rows that are whole texts, unless the session has others set."""
    for name, given, own in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) == given:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, f"{BLANK}+"), "")


def n_words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learned from: crc32 of the id's text, modulo 5, is 0 (null ids: never)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines of the cluster share; a folder of our own only where none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        named = tempfile.mkdtemp(prefix="voltide-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/voltide/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Lets the driver find now what no plan refers to any more: shuffle files and checkpoints of steps that are over.

    Spark removes them when the driver's JVM happens to collect its garbage, which long jobs with small plans seldom do.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """The rows, and a column that tells each from all others in every later scan and sorts as `id_col` does (nulls last).

    It is `id_col` where that is unique and never null; else the rows are sorted, numbered and written down once. Rows of
    one id are numbered by their text's hash.
    """
    spread = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.count(F.when(F.col(id_col).isNull(), 1))).first()
    if (spread[0] or 0) <= 1 and not spread[1]:
        return df, id_col
    name = "__row"
    while name in df.columns:
        name += "_"
    order = [F.col(id_col).asc_nulls_last(), F.xxhash64(text_col)]
    rows = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return written(rows.withColumn(name, F.monotonically_increasing_id()), "numbered"), name
