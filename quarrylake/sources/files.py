"""Sources and sinks of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths


def walk(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    """path, file_size and modified_at of files below root with these extensions; contents are not read. A root that is missing is an
    error, never an empty result."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"))
    system = paths.norm_path(F.lower("path")).rlike(r"\\(\$recycle\.bin|system volume information)\\")
    return files.where(paths.extension(F.col("path")).isin(*extensions) & ~system & ~paths.basename(F.col("path")).startswith(".")).withColumn("filename", paths.basename(F.col("path")))


def write_diary(messages: DataFrame, folder: str) -> None:
    """One line for each message, in a folder for each day of its time: messages has day and line."""
    messages.select("day", F.col("line").alias("value")).write.mode("append").partitionBy("day").text(folder)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result cache in JSON; malformed rows are as good as none."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
