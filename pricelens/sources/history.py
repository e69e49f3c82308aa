"""Recommendation history: batches that are appended once, and JSON files of any shape read back.

A history folder holds JSON files that people and programs have put there: one
object, an array of objects, or one object or array a line, printed on one line
or over many. They are read line by line, so a large file of JSON lines is split
over tasks; what a line means follows from its file's shape:

* a file of which most lines are whole objects or arrays is a file of lines, and
  every line stands for itself;
* any other file is one document: its lines are put together again and parsed
  as a whole (one document is one value, so it has to fit into a task).

Values are kept as VARIANT until their fields are taken by name. Nothing that
can't be read is lost: it goes to the rejects with its file and a reason.

Cases: empty files and blank lines give nothing; a field that is absent or can't
be read as its type is NULL; fields that the schema doesn't name are left out;
an array's elements are rows in their order; a lone number or text, and array
elements that aren't objects, are rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.functions.core import attach
from pricelens.sources.schemas import RECOMMENDATION_SCHEMA

NOT_JSON, NOT_OBJECT = "not JSON", "not an object"


def append_batch(df: DataFrame, path: str, batch_id: str) -> None:
    """Append a batch of recommendations once, however often it is tried.

    The batch's own partition is overwritten, so a second try replaces what a
    first one left; its commit row comes last, and :func:`read_batches` reads
    committed batches only.
    """
    spark = df.sparkSession

    def put(rows: DataFrame, name: str) -> None:
        (rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").json(f"{path}/{name}"))

    put(df, "data")
    put(spark.range(1).select(F.current_timestamp().alias("committed_at")), "commits")


def read_batches(spark: SparkSession, path: str, schema: T.StructType = RECOMMENDATION_SCHEMA) -> DataFrame:
    """The rows of all committed batches, with batch_id and committed_at."""
    named = T.StructType([*schema.fields, T.StructField("batch_id", T.StringType())])
    commits = spark.read.schema("committed_at timestamp, batch_id string").json(f"{path}/commits")
    return spark.read.schema(named).json(f"{path}/data").join(commits, "batch_id")


def _parsed(value: Column) -> Column:
    """A text as VARIANT; NULL if it isn't JSON as a whole (the parser alone would take ``{..},``)."""
    cut_off = value.rlike(r"^\s*[\[{]") & ~value.rlike(r"(?s)^\s*(?:\{.*\}|\[.*\])\s*$")
    return F.try_parse_json(F.when(~cut_off, value))


def _values(spark: SparkSession, path: str) -> DataFrame:
    """source_file, recorded_at, value, v (VARIANT, NULL where it can't be parsed): one row per line or document."""
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("recorded_at"), "value",
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth")).alias("at"))
    lines = text.where(~F.col("value").rlike(r"^\s*$")).withColumn("v", _parsed(F.col("value")))
    whole = F.col("v").isNotNull() & F.col("value").rlike(r"^\s*[\[{]")
    shape = lines.groupBy("source_file").agg((2 * F.count_if(whole) > F.count(F.lit(1))).alias("by_line"))
    both = attach(lines, shape, "source_file")
    parts = F.array_sort(F.collect_list(F.struct("at", "value")))
    documents = (both.where(~F.col("by_line")).groupBy("source_file", "recorded_at")
                 .agg(F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("value"), F.min("at").alias("at"))
                 .withColumn("v", _parsed(F.col("value"))))
    return both.where("by_line").drop("by_line").unionByName(documents)


def _items(values: DataFrame) -> DataFrame:
    """One row per value of a line or document: ``item`` (VARIANT) and why it is rejected, if it is."""
    is_array = F.col("value").rlike(r"^\s*\[")
    elements = F.when(F.col("v").isNotNull(), F.when(is_array, F.col("v").cast("array<variant>")).otherwise(F.array("v")))
    each = values.select("source_file", "recorded_at", "value", "at", F.col("v").isNull().alias("broken"), F.posexplode_outer(elements).alias("nth", "item"))
    reason = (F.when(F.col("broken"), NOT_JSON)
              .when(~F.coalesce(F.schema_of_variant("item").startswith("OBJECT"), F.lit(False)), NOT_OBJECT))
    empty = F.col("item").isNull() & ~F.col("broken")  # an empty array
    return each.withColumn("reason", reason).where(~empty)


def _fields(schema: T.StructType) -> list[Column]:
    return [F.try_variant_get("item", f"$['{f.name}']", f.dataType.simpleString()).alias(f.name) for f in schema.fields]


def read_history(spark: SparkSession, path: str, schema: T.StructType = RECOMMENDATION_SCHEMA) -> DataFrame:
    """The objects of every JSON file under ``path``, with ``recorded_at``
    (the file's time) and ``source_file``. Not sorted: see ``market.history``."""
    good = _items(_values(spark, path)).where(F.col("reason").isNull())
    return good.select(*_fields(schema), "recorded_at", "source_file")


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`read_history` leaves out: source_file, recorded_at, reason, and the text of the line or document."""
    return _items(_values(spark, path)).where(F.col("reason").isNotNull()).select("source_file", "recorded_at", "reason", "value")


def set_file_times(spark: SparkSession, path: str, millis_of) -> None:
    """Set the modification time of every file below the folders of ``path``:
    ``millis_of(folder name)`` since 1970. For histories moved between stores,
    which lose their files' times."""
    fs_path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    top = fs_path(path)
    fs = top.getFileSystem(conf)
    for folder in fs.listStatus(top):
        if folder.isDirectory():
            for f in fs.listStatus(folder.getPath()):
                fs.setTimes(f.getPath(), int(millis_of(folder.getPath().getName())), -1)
