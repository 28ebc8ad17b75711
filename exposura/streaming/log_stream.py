"""Incremental log audit, validation with quarantine, and event-time sessions over file streams."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from exposura.operators.audit import log_audit
from exposura.session import shared_folder
from exposura.sources.impressions import policy_is_valid


def read_log_stream(spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet", files_per_batch: int = 16) -> DataFrame:
    """New files under ``path`` as micro-batches of bounded size."""
    reader = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("header", True) if file_format == "csv" else reader).load(path)


def streaming_log_audit(log: DataFrame) -> DataFrame:
    """Running audit per log. State is one row per log: distinct counts are HLL sketches."""
    return log_audit(log, approximate=True)


def split_valid(log: DataFrame, expected_random: str = "expected_random") -> tuple[DataFrame, DataFrame]:
    """Rows whose policy flag is binary and matches its log, and all others."""
    ok = F.coalesce(policy_is_valid(F.col(expected_random)), F.lit(False))
    return log.where(ok), log.where(~ok)


def start_quarantine(
    log: DataFrame, good_path: str, bad_path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Write valid rows and rejected rows to separate tables.

    A batch that is retried after a failure rewrites its own ``batch`` folder, so no row is doubled.
    """
    def sink(batch: DataFrame, number: int) -> None:
        for part, path in zip(split_valid(batch), (good_path, bad_path)):
            part.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = log.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# Of 2**12 registers: a standard error of about 1.6 %.
SKETCH_BITS = 12


def streaming_sketches(log: DataFrame, by: Sequence[str] = ("date",)) -> DataFrame:
    """Rows and sketches of the distinct users and items of every group, such as a day; state is one row per group.

    Sketches of groups merge without their rows: see ``merged_counts``.
    """
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg("user_id", F.lit(SKETCH_BITS)).alias("users"),
        F.hll_sketch_agg("item_id", F.lit(SKETCH_BITS)).alias("items"),
    )


def merged_counts(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and estimated distinct users and items of groups of sketches, or of all of them."""
    return sketches.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"),
        F.hll_sketch_estimate(F.hll_union_agg("items")).alias("items"),
    )


def streaming_sessions(log: DataFrame, max_gap_minutes: int = 30, delay: str = "1 hour") -> DataFrame:
    """Event-time sessions per user by the batch rule: a gap longer than the limit ends a session, one of exactly it does not.

    Session windows that touch are merged, so a window as long as the limit is right. In append mode a session is written
    once the watermark has passed it.
    """
    if max_gap_minutes <= 0:
        raise ValueError("a session needs a gap above zero")
    timed = log.withColumn("ts", F.timestamp_millis("timestamp_ms"))
    window = F.session_window("ts", f"{max_gap_minutes} minutes")
    return timed.withWatermark("ts", delay).groupBy("user_id", window.alias("session")).agg(
        F.min("timestamp_ms").alias("started_ms"), F.max("timestamp_ms").alias("ended_ms"),
        F.count(F.lit(1)).alias("rows"), F.sum("long_view").alias("positives"),
    ).drop("session")


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Drain an aggregate over what is there now; the last result of each run is stored and returned."""
    folder = f"{shared_folder(stream.sparkSession)}/exposura-stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
        .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/result"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/result")


def drain_parts(log: DataFrame) -> DataFrame:
    """Run the quarantine over what is there now; all rows of both sinks, told apart by ``sink`` (valid, rejected)."""
    folder = f"{shared_folder(log.sparkSession)}/exposura-stream-{uuid.uuid4().hex}"
    start_quarantine(log, f"{folder}/good", f"{folder}/bad", f"{folder}/state").awaitTermination()
    parts = [
        log.sparkSession.read.schema(log.schema).parquet(f"{folder}/{name}/*").withColumn("sink", F.lit(sink))
        for name, sink in (("good", "valid"), ("bad", "rejected"))
    ]
    return parts[0].unionByName(parts[1])
