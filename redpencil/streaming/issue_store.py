"""A keyed, bucketed issue table that late results merge into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redpencil.operators.candidates import merge_issues

KEYS = ["workspace_id", "source_type", "source_id"]
RULE, CANDIDATE = "rule", "candidate"


class IssueStore:
    """Rule issues and candidates as they arrived, and the merged issues of each source.

    ``found`` keeps every arrived row with its origin and ``ord``, ``merged`` the issues after J12. Both
    are Parquet below ``path``, laid out by epoch and by bucket of the source's key. An epoch writes
    the buckets that its rows fall into and no others: sources that the batch does not name are
    copied from the bucket's last version, the named ones are merged again from all their rows.
    So the table depends on the rows alone and not on how they were cut into batches, and a
    replayed epoch overwrites exactly its own folders.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int = 64, keys: list[str] | None = None) -> None:
        self.spark, self.path, self.buckets, self.keys = spark, path.rstrip("/"), buckets, keys or KEYS
        plain = [f for f in schema if f.name not in ("origin", "ord", "bucket", "epoch")]
        self.columns = [f.name for f in plain]
        place = [T.StructField("epoch", T.LongType()), T.StructField("bucket", T.IntegerType())]
        self.found_schema = T.StructType([*plain, T.StructField("origin", T.StringType()), T.StructField("ord", T.LongType()), *place])
        self.merged_schema = T.StructType([*plain, T.StructField("origin", T.StringType()), *place])

    def _read(self, name: str, schema: T.StructType, before: int | None) -> DataFrame:
        # the folders are listed once; epochs and buckets are partition columns, so other folders are not opened
        rows = self.spark.read.schema(schema).option("ignoreMissingFiles", "true")
        folder = f"{self.path}/{name}"
        if not self._exists(folder):
            return self.spark.createDataFrame([], schema)
        df = rows.option("basePath", folder).parquet(folder)
        return df if before is None else df.where(F.col("epoch") < before)

    def _exists(self, folder: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(folder)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _latest(self, merged: DataFrame) -> DataFrame:
        """The rows of each bucket's last version."""
        last = merged.groupBy("bucket").agg(F.max("epoch").alias("epoch"))
        return merged.join(F.broadcast(last), ["bucket", "epoch"], "left_semi")  # a row for each bucket

    def write(self, batch: DataFrame, epoch: int) -> None:
        """Merge a batch of rule issues and candidates: the issue columns, ``origin`` and ``ord``."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = batch.select(*self.columns, "origin", F.col("ord").cast("long").alias("ord"),
                            F.lit(epoch).cast("long").alias("epoch"), bucket.alias("bucket"))
        rows.repartition("bucket").drop("epoch").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/found/epoch={epoch}")
        arrived = self._read("found", self.found_schema, None).where(F.col("epoch") == epoch)
        touched = [r["bucket"] for r in arrived.select("bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        named = arrived.select(*self.keys).distinct()
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
        all_found = self._read("found", self.found_schema, epoch + 1).where(F.col("bucket").isin(touched))
        of_named = all_found.alias("a").join(named.alias("n"), same, "left_semi")
        # J12 compares keys by equality; a null part of a key is a value of its own here
        fold = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("null")).alias(f"_{k}") for k in self.keys]
        keyed = of_named.select(*of_named.columns, *fold)
        names = [f"_{k}" for k in self.keys]
        merged = merge_issues(keyed.where(F.col("origin") == RULE).drop("ord"), keyed.where(F.col("origin") != RULE), names)
        before = self._latest(self._read("merged", self.merged_schema, epoch).where(F.col("bucket").isin(touched)))
        others = before.alias("a").join(named.alias("n"), same, "left_anti")
        whole = merged.select(*self.columns, "origin", "bucket").unionByName(others.select(*self.columns, "origin", "bucket"))
        whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/merged/epoch={epoch}")

    def issues(self) -> DataFrame:
        """The merged issues as of the last epoch."""
        return self._latest(self._read("merged", self.merged_schema, None)).select(*self.columns, "origin")
