"""Pages as they arrive: an extension that runs the page operators over a folder that fills up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators import pages

PAGE = "file_id long, page_no int, page_text string, arrived timestamp"


def page_stream(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files of pages that come into a folder."""
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def once(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each page once, though it may arrive again within `lateness`; the state of older pages goes."""
    return stream.withWatermark("arrived", lateness).dropDuplicatesWithinWatermark(["file_id", "page_no"])


def extract_to(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Extracts what has arrived and stops. A micro-batch that is tried again after a failure overwrites its own folder,
    so that no row is written twice."""

    def put(batch: DataFrame, number: int) -> None:
        pages.extract(batch).write.mode("overwrite").parquet(f"{target}/micro_batch={number}")

    return once(stream).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """How many pages, of how many without text, arrived in each window."""
    return stream.withWatermark("arrived", lateness).groupBy(F.window("arrived", window).alias("w")).agg(F.count("*").alias("pages"), F.count_if(F.coalesce(F.trim("page_text"), F.lit("")) == "").alias("blank")).select("w.start", "w.end", "pages", "blank")
