"""Changes from a stream, applied to a store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def apply_changes(stream: DataFrame, store: Store, checkpoint: str, order: str = "seq", **trigger) -> StreamingQuery:
    """Append each micro-batch of changes (op, id, values, metadata, ..., `order`) to the store's log.

    The change of the greatest `order` wins, in whatever micro-batch it comes, so the result is that of the same changes
    applied in one batch. A batch is appended once: the query's id and the batch's number are part of the store's
    manifest, so a batch that is run again after a failure is skipped, and a new query begins anew.
    """

    def write(df: DataFrame, epoch: int) -> None:
        query = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        store.append(df, order=order, epoch=(query, epoch))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per window and key; rows later than `late` behind the newest are dropped by the watermark."""
    rows = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    out = rows.groupBy(F.window("_t", width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n")
