"""X1 + D4: incremental ingest of digest messages.

Message files arriving in ``source`` are read as a file stream; each micro-batch is turned
into papers (U5), deduplicated within the batch, freed of the papers already stored (D4:
never redo work; ``seen``), and written to ``<sink>/batch_id=<n>`` with overwrite. A
replayed batch (after a failure between write and commit) rewrites the same directory and
asks the batches before its own only, so the sink is exactly-once. Identity is kept forever
rather than in a watermark-bounded state store, which would forget old ids and drop late
re-deliveries wrongly.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsift.operators.common import materialize, top_k
from litsift.schemas import MESSAGE
from litsift.streaming.seen import SeenKeys

DEFAULT_KEY = ["email_id", "article_pos"]


def process_batch(batch: DataFrame, batch_id: int, sink: str, to_papers, key: list[str]) -> None:
    spark = batch.sparkSession
    papers = to_papers(batch)
    # Within the batch: one row per key (a message delivered twice in one batch), the first by
    # its content, so that a replayed batch keeps the same one.
    papers = top_k(papers, key, [F.to_json(F.struct(*papers.columns))], 1, "_r").drop("_r")
    papers = materialize(papers, "batch")
    papers = SeenKeys(spark, sink, key).unseen(papers, batch_id)
    papers.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")


def ingest_incremental(spark: SparkSession, source: str, sink: str, checkpoint: str, to_papers,
                       key: list[str] | None = None, files_per_batch: int | None = None,
                       fmt: str = "json"):
    """Process every message file not yet processed (``availableNow``), then stop.

    ``to_papers`` maps a batch of messages to papers (e.g. ``recent_papers`` with its
    parameters bound). Returns the finished ``StreamingQuery``.
    """
    key = key or DEFAULT_KEY
    reader = spark.readStream.schema(MESSAGE).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.load(source)
    q = (stream.writeStream
         .foreachBatch(lambda df, bid: process_batch(df, bid, sink, to_papers, key))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return q


def read_ingested(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink)


#: State in RocksDB on the executors, its changes (not whole snapshots) checkpointed with each batch.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for what starts inside."""
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ingest_incremental_stateful(spark: SparkSession, source: str, sink: str, checkpoint: str, to_papers,
                                key: list[str] | None = None, files_per_batch: int | None = None,
                                fmt: str = "json", state_store: dict[str, str] | None = None):
    """X1 with Spark's state store instead of runs of stored keys.

    ``dropDuplicates(key)`` without a watermark keeps every key seen in the state store
    (partitioned by key), so each micro-batch costs work proportional to the batch, not to
    the history. The store is RocksDB (``state_store``: other settings; a checkpoint is
    tied to the store that wrote it). The Parquet file sink is exactly-once through its
    ``_spark_metadata`` log. ``to_papers`` must be streaming-compatible (``recent_papers``
    is: filters, explode and projections only).
    """
    key = key or DEFAULT_KEY
    reader = spark.readStream.schema(MESSAGE).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    papers = to_papers(reader.load(source)).dropDuplicates(key)
    with _settings(spark, ROCKSDB if state_store is None else state_store):
        q = (papers.writeStream.format("parquet")
             .option("path", sink)
             .option("checkpointLocation", checkpoint)
             .outputMode("append")
             .trigger(availableNow=True)
             .start())
    q.awaitTermination()
    return q


def stored_state(spark: SparkSession, checkpoint: str, state_store: dict[str, str] | None = None) -> DataFrame:
    """The keys that a stateful ingest has in its state, read back from its checkpoint."""
    with _settings(spark, ROCKSDB if state_store is None else state_store):
        return spark.read.format("statestore").load(checkpoint).select("key.*")
