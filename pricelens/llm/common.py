"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.session import ensure_checkpoint_dir

#: The words of the digest contracts: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, to be handed to Python in short batches."""
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let Spark hand texts to Python at most ``rows`` at a time: the default of
    10,000 whole texts is more than a worker should hold."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The partitions of the returned frame are fixed files, so values derived
    from them (``spark_partition_id``, row numbers) stay the same when a task
    or executor is lost and its work is run again.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_key(*cols: Column) -> Column:
    """128-bit key of a row's identifying columns; equal rows share one key.

    Null and empty values differ, and a column's end is marked, so
    ``('a', 'b')`` and ``('ab', '')`` get different keys.
    """
    parts = [F.coalesce(F.concat(F.lit("v"), F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")),
                        F.lit("n")) for c in cols]
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))


def column(name: str) -> Column:
    """A table's own column, whatever its name holds (a dot, say)."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (case-insensitive)."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name = "_" + name
    return name


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed, small list of rows as column literals of one generated row."""
    names = [part.split() for part in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)
    structs = [F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(row, names, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


class Scratch:
    """Tables in a folder of their own inside the shared checkpoint folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []
        self.folder = f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read again."""
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def bucketed(self, df: DataFrame, key: str | list[str], name: str) -> DataFrame:
        """``df`` written in buckets of ``key``: joins and groups on it don't shuffle it again."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        full = f"{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", f"{self.folder}/{name}").saveAsTable(full)
        self.names.append(full)
        return self.spark.table(full)

    def drop(self, name: str = "") -> None:
        """Delete a table that nothing reads any more; without a name, all of them."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        path.getFileSystem(conf).delete(path, True)

    def close(self) -> None:
        """Drop the tables; what was made from them must be materialised."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.drop()


def release(spark: SparkSession) -> None:
    """Let the driver notice shuffle files that nothing refers to any more, so
    that executors can delete them between the phases of a long job."""
    gc.collect()
    spark._jvm.System.gc()
