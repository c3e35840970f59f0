"""The partitioned lake: pruned scans, writes by partition, idempotent replacement."""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_partitioned(spark: SparkSession, root: str, start: str, end: str, venues: list[str] | None = None) -> DataFrame:
    """Rows from `start` to `end` (inclusive) by partition pruning; none at all is an error.

    Both are dates (yyyy-MM-dd), or hours (yyyy-MM-dd HH) of a lake that has `hour` partitions, across midnight too; they
    may be the same.
    """
    rows = spark.read.option("recursiveFileLookup", "false").parquet(root)
    for text, is_start in ((start, True), (end, False)):
        day, _, hour = text.partition(" ")
        date = F.lit(day).cast("date")
        beyond = F.col("date") > date if is_start else F.col("date") < date
        edge = F.lit(True)
        if hour:
            at = F.col("hour").cast("int")
            edge = at >= int(hour) if is_start else at <= int(hour)
        rows = rows.where(beyond | ((F.col("date") == date) & edge))
    rows = rows.where(F.col("venue").isin(venues)) if venues else rows
    if rows.select(F.lit(1)).isEmpty():  # no column is read for this
        raise ValueError(f"no partitions from {start} to {end}")
    return rows


def dealt(rows: DataFrame, by: list[str], cluster: list[str]) -> DataFrame:
    """The rows in tasks by partition value, sorted inside by `cluster`. Tasks are evened out at run time: a hot value is
    split over many, and many small values share one, without a pass to count them.
    """
    return rows.hint("rebalance", *by).sortWithinPartitions(*by, *cluster)


def write_hive(rows: DataFrame, root: str, by: list[str], mode: str = "append", cluster: list[str] | None = None) -> None:
    """Partition columns live in the path. Files are sorted by `cluster` (say instrument and time), so that their row groups
    can be skipped; a partition value has one file, a hot one several.
    """
    dealt(rows, by, cluster or []).write.mode(mode).option("compression", "snappy").partitionBy(*by).parquet(root)


def replace_partition(rows: DataFrame, root: str, by: list[str], cluster: list[str] | None = None) -> None:
    """The partitions that the rows have are replaced in place; siblings stay. `AtomicTable` does it in one step."""
    dealt(rows, by, cluster or []).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(root)


class AtomicTable:
    """A partitioned table whose versions are manifests: rows are written beside what is there, and a new manifest, made by
    one rename that fails if another writer was first, is the moment of change. A failure before it leaves the old rows.

    Layout: <root>/version=<n>/<by>=<value>/part files, and <root>/_manifests/<n>.json with the folders that count and the
    table's schema. The driver holds a line a partition value, never rows.
    """

    def __init__(self, spark: SparkSession, root: str, by: list[str], cluster: list[str] | None = None):
        self.spark, self.root, self.by, self.cluster = spark, root.rstrip("/"), by, cluster or []
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the newest manifest; 0 for a table without any."""
        at = self._path(f"{self.root}/_manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"folders": [], "schema": None}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/_manifests/{version}.json", wholetext=True).collect()))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, or of the newest one."""
        found = self.manifest(version)
        if found["schema"] is None:
            raise ValueError(f"no version of a table at {self.root}")
        schema = T.StructType.fromJson(found["schema"])
        if not found["folders"]:
            return self.spark.createDataFrame([], schema)
        parts = T.StructType([*(f for f in schema if f.name not in self.by), *(f for f in schema if f.name in self.by)])
        return self.spark.read.schema(parts).option("basePath", self.root).parquet(*[f"{self.root}/{f}" for f in found["folders"]]).select(*schema.names)

    def _folders(self, path: str, depth: int) -> list[str]:
        if not depth:
            return [path]
        at = self._path(f"{self.root}/{path}")
        inner = [s.getPath().getName() for s in self._fs.listStatus(at) if s.isDirectory()] if self._fs.exists(at) else []
        return [f for name in sorted(inner) if "=" in name for f in self._folders(f"{path}/{name}", depth - 1)]

    def stage(self, rows: DataFrame) -> tuple[int, list[str]]:
        """Writes rows that no reader sees yet; returns the version that they are for, and their folders."""
        version = self.version() + 1
        name = f"version={version}-{uuid.uuid4().hex[:8]}"
        dealt(rows, self.by, self.cluster).write.mode("errorifexists").partitionBy(*self.by).parquet(f"{self.root}/{name}")
        return version, self._folders(name, len(self.by))

    def switch(self, version: int, folders: list[str], schema: T.StructType) -> None:
        """Makes the folders the table. An error if another writer has made this version meanwhile: nothing has changed then."""
        at = self._path(f"{self.root}/_manifests/.{uuid.uuid4().hex}")
        self._fs.mkdirs(at.getParent())
        out = self._fs.create(at, False)
        out.write(bytearray(json.dumps({"folders": folders, "schema": schema.jsonValue()}).encode()))
        out.close()
        goal = self._path(f"{self.root}/_manifests/{version}.json")
        if self._fs.exists(goal) or not self._fs.rename(at, goal):
            self._fs.delete(at, False)
            raise RuntimeError(f"version {version} of {self.root} was made by another writer")

    def replace_partitions(self, rows: DataFrame) -> int:
        """The partitions that the rows have hold these rows and no others; all others stay. Returns the new version."""
        old = self.manifest()
        version, new = self.stage(rows)
        values = {f.split("/", 1)[1] for f in new}
        self.switch(version, [f for f in old["folders"] if f.split("/", 1)[1] not in values] + new, rows.schema)
        return version

    def replace_slice(self, new: DataFrame, inside: Column) -> int:
        """Rows for which `inside` holds go, and those of `new` for which it holds come, in one step; partitions that no row
        of the slice touches are neither read nor written.
        """
        old = self.manifest()
        if old["schema"] is None:
            return self.replace_partitions(new.where(inside))
        rows = self.read()
        version, folders = self.stage(touched(new, rows, self.by, inside))
        # partitions that the slice reached go even where nothing of them is left
        at = F.regexp_extract(F.input_file_name(), "(version=[^/]+(?:/[^/]+)*)/[^/]+$", 1)
        reached = {unquote(r.at) for r in rows.where(inside).select(at.alias("at")).distinct().collect()}
        values = {f.split("/", 1)[1] for f in [*folders, *reached]}
        self.switch(version, [f for f in old["folders"] if f.split("/", 1)[1] not in values] + folders, new.schema)
        return version

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that none of the newest `keep` manifests names, and older manifests; returns how many folders went."""
        newest = self.version()
        used = {f for v in range(max(1, newest - keep + 1), newest + 1) for f in self.manifest(v)["folders"]}
        versions, gone = {f.split("/", 1)[0] for f in used}, 0
        for name in [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]:
            if name.startswith("version="):
                old = [f for f in self._folders(name, len(self.by)) if f not in used]
                gone += len(old)
                for f in old if name in versions else [name]:
                    self._fs.delete(self._path(f"{self.root}/{f}"), True)
        for v in range(1, newest - keep + 1):
            self._fs.delete(self._path(f"{self.root}/_manifests/{v}.json"), False)
        return gone


def drop_path_columns(rows: DataFrame, names: list[str], to: str | None = None) -> DataFrame:
    """The rows without columns that the path has as well; with `to`, written there, and read back if no row was lost."""
    out = rows.drop(*names)
    if to is None:
        return out
    out.write.parquet(to)
    written = rows.sparkSession.read.schema(out.schema).parquet(to)
    before, after = rows.count(), written.count()
    if before != after:
        raise ValueError(f"{before} rows became {after}")
    return written


def compat_view(newest: DataFrame, columns: list[str], version: str) -> DataFrame:
    """An older contract as a projection of the newest table."""
    return newest.select(*columns).withColumn("feature_version", F.lit(version))


def touched(new: DataFrame, existing: DataFrame, by: list[str], inside: Column) -> DataFrame:
    """What the partitions that a slice touches hold after the slice is replaced: small rewrites of a large table.

    Rows for which `inside` is null are outside the slice and stay.
    """
    within = F.coalesce(inside, F.lit(False))
    parts = existing.where(within).select(*by).unionByName(new.where(within).select(*by)).distinct()
    parts = parts.select(*[F.col(c).alias(f"__of_{c}") for c in by])
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return existing.join(parts, on, "left_semi").where(~within).unionByName(new.where(within))


def write_clustered(rows: DataFrame, table: str, by: list[str], at: str, buckets: int | None = None, mode: str = "errorifexists") -> None:
    """Saves rows as a table in `buckets` buckets by `by` and day (a new column, days since 1970 of the timestamp `at`), each
    sorted by these and time. Joins and windows by key and day then read a bucket as it lies, without a shuffle; a key's days
    lie in different buckets, so a hot key is spread.
    """
    n = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, "day"]
    placed = rows.withColumn("day", F.floor(F.unix_seconds(at) / 86_400))
    placed.repartition(n, *keys).write.mode(mode).bucketBy(n, *keys).sortBy(*keys, at).saveAsTable(table)
