"""Writing streams: idempotent upserts per micro-batch, and bounded runs over what has arrived."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from callweave.sources.store import upsert
from callweave.streaming.metrics import new_calls

EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def upsert_stream(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    version: Sequence[str] = (),
    output_mode: str = "update",
    buckets: int = 16,
):
    """Keep the newest row per key in a table of files.

    A row's version is (``version`` columns, batch number), so a batch that is replayed after a
    failure changes nothing. Returns the started query, which stops when all input is consumed.
    """
    spark = rows.sparkSession
    order = F.struct(*version, "__batch")
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])

    def write(batch: DataFrame, batch_id: int) -> None:
        tagged = (
            batch.withColumn("__batch", F.lit(batch_id)).withColumn("row_key", key).withColumn("row_version", order)
        )
        # The upsert looks at the batch twice; keeping it spares running the stateful part again.
        tagged = tagged.drop("__batch").persist()
        try:
            upsert(batch.sparkSession, tagged, path, "row_key", "row_version", buckets)
        finally:
            tagged.unpersist()

    # State with a time to live always asks for one more empty batch, so a run over what has arrived
    # would not end. The setting is read when the query starts.
    before = spark.conf.get(EMPTY_BATCHES, "true")
    spark.conf.set(EMPTY_BATCHES, "false")
    try:
        return (
            rows.writeStream.outputMode(output_mode)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
    finally:
        spark.conf.set(EMPTY_BATCHES, before)


def append_stream(rows: DataFrame, path: str, checkpoint: str):
    """Append finished rows to a table of files until all input is consumed."""
    return (
        rows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_new_stream(rows: DataFrame, path: str, checkpoint: str, key: str = "content_sha1"):
    """Append rows whose key the table does not hold yet, until all input is consumed.

    Every micro-batch writes a part named by its number, so a batch that is replayed replaces its own part.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.option("basePath", path).parquet(path).where(F.col("__batch") != batch_id)
        except AnalysisException:  # no table yet
            known = None
        fresh = new_calls(batch, known, key)
        fresh.write.mode("overwrite").parquet(f"{path}/__batch={batch_id}")

    return (
        rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    )
