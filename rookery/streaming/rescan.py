"""Incremental re-scan (an addition of this engine): each batch of new Java files adds their classes. A stream does not see a known path change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rookery.sources.java import java_classes


def class_stream(spark: SparkSession, root: str, out: str, checkpoint: str):
    """Start a query that writes the classes of every new Java file under root below out, a folder for each batch.

    A batch that runs again replaces its folder, so each is written once. A file without classes has one row, whose name is null.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.java").load(root)
    rows = files.select(F.lit(root).alias("repo"), "path", F.decode("content", "UTF-8").alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        seen = batch.select("repo", F.col("path").alias("file"))
        seen.join(java_classes(batch), ["repo", "file"], "left").write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_classes(spark: SparkSession, out: str) -> DataFrame:
    """The classes of each file that class_stream has written; of a file in several batches (after its checkpoint was lost) the latest."""
    rows = spark.read.parquet(out)
    latest = F.max("batch").over(Window.partitionBy("repo", "file"))
    return rows.withColumn("latest", latest).where("batch = latest and name is not null").drop("latest", "batch")
