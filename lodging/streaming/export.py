"""The enrichment export over a stream of booking files.

The original exports the enriched bookings to its dashboard in one batch.
When booking files keep arriving, the same export runs incrementally: every
step of the enrichment is row-local (two stream-static broadcast joins to the
lookups, then Column rules), so Structured Streaming can apply it to each new
file without any state, watermark or shuffle.  The query checkpoints its
progress under ``spark.checkpoint.dir``; a restart resumes after the last
committed file and the Parquet sink commits each batch exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodging.operators.enrich import enrich
from lodging.schema import BOOKINGS
from lodging.sources.files import PARTITION_COLUMN, text_schema, typed_from_text


def booking_stream(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int | None = None
) -> DataFrame:
    """New booking files under ``path`` as a stream with the booking schema.

    ``fmt='csv'`` reads header CSV sheets as text and types them like the batch
    reader (numeric 'NULL' markers become NULL, the country text 'NULL' stays).
    Every sheet's header must list the booking columns in schema order; one
    that doesn't fails the query.
    """
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        # enforceSchema=false: a file whose header differs fails instead of being read by position.
        raw = reader.schema(text_schema(BOOKINGS)).option("header", True).option("enforceSchema", False).csv(path)
        return typed_from_text(raw, BOOKINGS)
    return reader.schema(BOOKINGS).format(fmt).load(path)


def start_enriched_export(
    bookings: DataFrame,
    segments: DataFrame,
    meals: DataFrame,
    sink_path: str,
    checkpoint_path: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Start writing the enriched stream as year-partitioned Parquet.

    ``available_now`` processes every file present, then stops (a scheduled
    incremental export); otherwise the query keeps running.
    """
    writer = (
        enrich(bookings, segments, meals)
        .writeStream.format("parquet")
        .partitionBy(PARTITION_COLUMN)
        .option("checkpointLocation", checkpoint_path)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(sink_path)
