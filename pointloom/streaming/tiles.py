"""A cascade over tiles as they arrive. Tiles are independent, so the stream keeps no state but its progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def label_arriving_tiles(spark: SparkSession, source: str, target: str, progress: str, schema: str, label: Callable[[DataFrame], DataFrame], files_at_once: int = 64) -> StreamingQuery:
    """Label the Parquet tiles that appear under ``source`` and write each batch to a folder of its own under ``target``.

    A batch that is run again after a failure overwrites its folder, so rows come once. Ends when all files are done.
    """

    def batch(points: DataFrame, number: int) -> None:
        label(points).write.mode("overwrite").parquet(f"{target}/batch={number}")

    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", progress).trigger(availableNow=True).start()
