"""Live paths: idempotent ingest of a stream, the last event per key, published changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions import payload
from ledgerfold.operators import state
from ledgerfold.operators.snapshots import PatchTable
from ledgerfold.sources import intake
from ledgerfold.streaming.ledger import Ledger, stream_id


def deduplicated(payloads: DataFrame, within: str | None = None, ts: str = "ts") -> DataFrame:
    """A stream of payloads (raw), each content once.

    The state holds every hash seen. `within` bounds it: copies further apart than that then pass again.
    """
    hashed = payloads.withColumn("idempotency_key", payload.content_hash(F.col("raw")))
    if within is None:
        return hashed.dropDuplicates(["idempotency_key"])
    return hashed.withWatermark(ts, within).dropDuplicatesWithinWatermark(["idempotency_key"])


def ingest(payloads: DataFrame, receive: Callable[[DataFrame, int], None], ledger: str, checkpoint: str):
    """Starts the ingest of a stream of payloads (seq, raw): every batch goes to `receive` with the outcome of each row.

    The ledger is a folder of created keys that any number of streams and jobs share (see Ledger): a duplicate is
    known however much later it comes and whichever stream it came by first; the stream itself holds no state. A
    batch that is repeated after a failure gives the same outcomes again.
    """
    book = Ledger(payloads.sparkSession, ledger)

    def batch(df: DataFrame, number: int) -> None:
        out = intake.with_contents(book.ingest(df, stream_id(df.sparkSession, checkpoint), number), df).persist()
        try:
            receive(out, number)
        finally:
            out.unpersist()

    return payloads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_status(events: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """Keyed last status; write it in update mode to replace rows, or in complete mode."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias(status))


#: The state store for keyed states that outgrow memory.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def good_patches(callbacks: DataFrame) -> DataFrame:
    """Callbacks (onboarding_id, seq, patch) that can be taken up whatever is stored: with an onboarding, known fields, and no status or a run's."""
    status, has = F.col("patch")["status"], F.map_contains_key("patch", F.lit("status"))
    fine = F.col("onboarding_id").isNotNull() & (~has | state.status_errors(status, state.RUN_STATUSES).isNull())
    return callbacks.filter(fine).withColumn("patch", state.allowed(F.col("patch")))


def folded(callbacks: DataFrame, fields: tuple[str, ...] = state.FIELDS) -> DataFrame:
    """A stream of callbacks (onboarding_id, seq, patch) as one row for each onboarding, to be written in update mode.

    The state keeps each field's last value and its place, so a late patch loses field by field: the rows are those
    of state.fold_patches() over all callbacks, in whatever order they come and however they are cut into batches.
    It is an aggregation, partial in each task, and its state is in RocksDB on the executors if the session has
    use_rocksdb().
    """
    return state.fold_patches(good_patches(callbacks), "onboarding_id", ["seq"], fields)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def keep(callbacks: DataFrame, table: PatchTable, checkpoint: str, compact_every: int = 20):
    """Starts a query that takes every batch of callbacks (onboarding_id, seq, patch) up in a table, once, with its feed of changes.

    A batch that is repeated after a failure is known by its stream and number. Every compact_every batches the
    touched buckets are folded into the snapshot.
    """

    def batch(df: DataFrame, number: int) -> None:
        good = good_patches(df).select(F.col("onboarding_id").alias("key"), "seq", "patch")
        table.append(good, f"{stream_id(df.sparkSession, checkpoint)}-{number}")
        if number % compact_every == compact_every - 1:
            table.compact()

    return callbacks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish(changes: DataFrame, receive: Callable[[DataFrame, int], None], checkpoint: str, only_key=None, key: str = "id"):
    """Starts a query that hands every batch of changed keys to `receive`; only_key narrows it to one key."""
    chosen = changes if only_key is None else changes.filter(F.col(key) == only_key)
    return chosen.writeStream.outputMode("update").foreachBatch(receive).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
