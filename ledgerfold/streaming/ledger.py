"""The ledger of payloads that were accepted: one for any number of streams and batch jobs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.sources import intake
from ledgerfold.sources.buckets import Bucketed, Conflict, added
from ledgerfold.sources.scratch import file_system, hadoop_path


class Ledger:
    """Keys of created payloads, each with the stream and batch that created it, in hash buckets below a folder.

    A batch reads the buckets of its own keys. It is decided against a state of the ledger and counts only if no
    other writer has changed the state meanwhile; else it is decided anew. A batch that is repeated after a failure
    doesn't meet its own keys, and adds none.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, most_parts: int = 50):
        self.table, self.most_parts = Bucketed(spark, path, "idempotency_key string, stream string, batch long", "idempotency_key", buckets), most_parts

    def keys(self, buckets: list[int] | None = None) -> DataFrame:
        return self.table.rows(self.table.versions.latest()[1].get("folders", {}), buckets)

    def ingest(self, payloads: DataFrame, stream: str, batch: int) -> DataFrame:
        """Outcomes of a batch of payloads (seq, raw), as intake.outcomes() has them; created keys are in the ledger then."""
        facts = intake.facts(payloads).persist()
        try:
            touched = self.table.touched(facts.filter("valid"))
            while True:
                number, state = self.table.versions.latest()
                known = self.table.rows(state.get("folders", {}), touched).filter(~((F.col("stream") == stream) & (F.col("batch") == batch)))
                out = intake.decided(facts, known)
                if batch <= state.get("done", {}).get(stream, -1):
                    return out
                made = self.table.put(out.filter("result = 'created'").select("idempotency_key", F.lit(stream).alias("stream"), F.lit(batch).cast("long").alias("batch")))
                try:
                    self.table.versions.commit(number, state | {"folders": added(state.get("folders", {}), made), "done": state.get("done", {}) | {stream: batch}, "parts": state.get("parts", 0) + 1})
                    break
                except Conflict:
                    continue  # another writer's keys are known now
        finally:
            facts.unpersist()
        if state.get("parts", 0) + 1 >= self.most_parts:
            self.compact()
        return out

    def compact(self) -> None:
        """Writes every bucket's keys anew as one part; old parts stay for those that read them, until vacuum()."""

        def step(number: int, state: dict) -> dict:
            whole = self.table.put(self.table.rows(state.get("folders", {})))
            return state | {"folders": added({}, whole), "parts": 1, "left": [*state.get("left", []), *(p for own in state.get("folders", {}).values() for p in own)]}

        self.table.versions.change(step)

    def vacuum(self) -> None:
        """Deletes the parts that compaction has replaced, once no reader needs an old state."""
        _, state = self.table.versions.latest()
        for p in state.get("left", []):
            file_system(self.table.spark, p).delete(hadoop_path(self.table.spark, p), True)
        self.table.versions.change(lambda _, s: s | {"left": [p for p in s.get("left", []) if p not in state.get("left", [])]})


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream of this checkpoint: it survives restarts, and a new checkpoint has another."""
    stream = file_system(spark, checkpoint).open(hadoop_path(spark, f"{checkpoint}/metadata"))
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())["id"]
    finally:
        stream.close()

