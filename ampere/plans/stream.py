"""The streaming twin of the market view, run over the events files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.driver_tables import market_view, market_view_sql, table
from ..streaming import market_view_stream
from .common import D, scratch
from .registry import register

WATERMARK_HOURS = 2


def streamed_view(spark, folder: str, schema, files_per_trigger: int | None = None):
    """Hourly market view of the event files of a folder (or one file, as a
    pattern) by a file stream. An hour is final once the watermark (latest
    event - 2 h) passes its end; finals go to a parquet sink in the shared
    checkpoint folder, the hours still open at the end come from the newest
    events. All files present are one micro-batch unless ``files_per_trigger``
    says otherwise; where rows came later than the watermark allows, so that
    the stream has dropped some, the whole view is computed anew."""
    base = scratch(spark, "stream")
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(kept)
    spark.conf.set(kept, "1000000")  # the progress of every micro-batch is looked at
    try:
        q = (market_view_stream(reader.parquet(folder), f"{WATERMARK_HOURS} hours").writeStream.format("parquet")
             .option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append")
             .trigger(availableNow=True).start())
        try:
            q.awaitTermination()
            dropped = sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators)
        finally:
            q.stop()
    finally:
        spark.conf.set(kept, before)
    events = spark.read.schema(schema).parquet(folder)
    view = market_view(events)
    final = spark.read.schema(view.schema).parquet(f"{base}/out")
    last = None if dropped else final.agg(F.max(f"`{D}`")).first()[0]
    if last is None:
        return view
    rest = market_view(events.where(F.col("ts") >= F.lit(last) + F.expr("INTERVAL 1 HOUR")))
    return final.unionByName(rest)


@register("market_view_stream", f"WITH mv AS ({market_view_sql()}) SELECT * FROM mv")
def market_view_streamed(spark, sf):
    """The market view by a stream over the event files, whatever their order."""
    # as a pattern: a file or a folder of files
    return streamed_view(spark, f"{sf}/events.parque[t]", table(spark, sf, "events").schema)
