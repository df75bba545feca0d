"""Stream scoring (ST1–ST5): messages → decode → normalise → score → dual log + dead letters.

The message source is injected: a Kafka ``readStream`` on a cluster (the
connector jar is not part of plain PySpark), or a file stream with the same
``(key, value, topic, partition, offset, timestamp)`` columns in tests. The
stateless transformation is part of the streaming plan; only the sink runs
in ``foreachBatch``. Offsets are committed by the checkpoint after the batch
is written (at-least-once), and the batch-id partitioned sink makes a
replayed batch overwrite itself (effectively exactly-once rows).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lendwise.operators import requests as R
from lendwise.sources.sinks import TableSink, run_identity, write_prediction_logs

# Micro-batch bounds of the scoring consumer.
MAX_RECORDS_PER_BATCH = 512
BATCH_INTERVAL = "200 milliseconds"
MESSAGE_SCHEMA = "key string, value string, topic string, partition int, offset bigint, timestamp timestamp_ntz"


def kafka_messages(spark: SparkSession, servers: str, topic: str = "predict",
                   max_per_trigger: int | None = None) -> DataFrame:
    """S9 + ST2: Kafka source from the earliest offset.

    A batch takes all there is, so that intake grows with the cluster; pass ``max_per_trigger`` (such as
    ``MAX_RECORDS_PER_BATCH``, the original consumer's poll) to bound a micro-batch.
    """
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic).option("startingOffsets", "earliest"))
    if max_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
                      "topic", "partition", "offset", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


def file_messages(spark: SparkSession, path: str, max_files_per_trigger: int = 1, fmt: str = "parquet") -> DataFrame:
    """Test source with the Kafka message columns (ST2 bound by files per trigger).

    The messages of a batch are dealt over as many tasks as the cluster runs at once: a file of one row group would
    be decoded by one.
    """
    messages = (spark.readStream.format(fmt).schema(MESSAGE_SCHEMA)
                .option("maxFilesPerTrigger", max_files_per_trigger).load(path))
    return messages.repartition(spark.sparkContext.defaultParallelism)


def scored_stream(messages: DataFrame, scorer: Callable[[DataFrame], Column] = R.default_scorer,
                  processing_date: Column | None = None, event_ts: Column | None = None,
                  dedupe_watermark: str | None = None) -> DataFrame:
    """ST1 transformation (also ST7 on a static frame): J1 → P21/P24 → score → P19/P20 → P30.

    With ``dedupe_watermark`` (e.g. ``"1 hour"``) repeated request ids within
    the watermark are dropped (optional state for duplicate-free logging).
    """
    norm = R.normalise(R.decode_envelope(messages), processing_date=processing_date)
    scored = R.score_requests(norm, scorer=scorer, event_ts=event_ts)
    if dedupe_watermark:
        scored = scored.withColumn("__wm", F.col("timestamp").cast("timestamp")) \
            .withWatermark("__wm", dedupe_watermark).dropDuplicatesWithinWatermark(["event_id"]).drop("__wm")
    return scored


def start_scoring(scored: DataFrame, checkpoint: str, events_path: str | TableSink, requests_path: str | TableSink,
                  dead_letter_path: str | TableSink, trigger: dict | None = None,
                  partitions: int = 0, query_name: str | None = None) -> StreamingQuery:
    """ST1 + S11 + ST3 + ST4: run the stream; each micro-batch goes to both logs and the dead letters.

    Rejected messages always go to the dead letters. Batches are written under the identity stored in
    the checkpoint, so a stream with another checkpoint never replaces them. Targets are folders, or
    catalog tables (:class:`~lendwise.sources.sinks.TableSink`) that a separate job compacts.

    ``trigger`` defaults to a 200 ms processing-time trigger; pass
    ``{"availableNow": True}`` to drain what is there and stop.
    """
    run_id = run_identity(scored.sparkSession, checkpoint)

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_prediction_logs(batch, batch_id, events_path, requests_path, dead_letter_path, partitions, run_id)

    writer = scored.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"processingTime": BATCH_INTERVAL}))
    if query_name:
        writer = writer.queryName(query_name)
    return writer.start()
