"""Files that arrive: tile names and point batches as streams, dealt to the same plans batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.labels import in_tile_pixels, tile_overlap
from tessella.session import shared_folder


def arriving_labels(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of label rows from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def label_tiles(labels: DataFrame, tiles: DataFrame, sink: Callable[[DataFrame, int], None], name: str, ratio: tuple[int, int] = (9, 10), once: bool = True) -> StreamingQuery:
    """Join each batch of arriving labels with the (static) tiles and hand the clipped labels to ``sink``.

    Progress is kept in the shared folder under ``name``, so a restarted job goes on where it stopped.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(in_tile_pixels(tile_overlap(tiles, batch, ratio)), number)

    writer = labels.writeStream.foreachBatch(each).option("checkpointLocation", f"{shared_folder(labels.sparkSession)}/streams/{name}")
    return (writer.trigger(availableNow=True) if once else writer).start()


def tile_counts(labels: DataFrame, time: str, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Labels by category and window of event time; rows later than the watermark are left out."""
    return labels.withWatermark(time, late).groupBy(F.window(time, every), "category").agg(F.count(F.lit(1)).alias("n"))
