"""Threads that pause before a review and are resumed by a decision: their states outlive any run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.operators import flow
from ledgerfold.sources.buckets import Bucketed, Conflict, added
from ledgerfold.sources.scratch import written


class ThreadLog:
    """The log of states (thread_id, seq, next, state), with the callback that goes out with each.

    A state follows the one it was made from: seq is one more, and a state that is based on an old one isn't written.
    So of two decisions on a paused thread, in one batch, one after the other or by two writers at once, one is
    taken, and its callback is there once. What is written with a tag is written once, however often a run repeats.
    """

    SCHEMA = "thread_id string, seq long, next string, state string, callback map<string,string>"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.table = spark, Bucketed(spark, path, self.SCHEMA, "thread_id", buckets)

    def _rows(self, state: dict, keys: DataFrame | None = None) -> DataFrame:
        return self.table.rows(state.get("folders", {}), None if keys is None else self.table.touched(keys))

    def states(self, threads: DataFrame | None = None) -> DataFrame:
        """The last state of every thread, or of these (column thread_id), whose buckets alone are opened."""
        rows = self._rows(self.table.versions.latest()[1], threads)
        return flow.latest_states(rows if threads is None else rows.join(threads.select("thread_id").distinct(), "thread_id", "left_semi"))

    def callbacks(self, after: int = 0) -> DataFrame:
        """thread_id, seq and callback of the states of versions beyond `after`."""
        _, state = self.table.versions.latest()
        folders: dict[str, list[str]] = {}
        for version, part in state.get("log", []):
            if version > after:
                folders = added(folders, part)
        return self.table.rows(folders).filter("callback is not null").select("thread_id", "seq", "callback")

    def pause(self, runs: DataFrame, tag: str) -> int:
        """Logs the outcomes of flow.run() without an error: paused threads before their review, others at their end. A thread that runs again goes on from its last seq."""
        # one outcome of a thread counts in a batch
        fine = runs.filter("error is null").dropDuplicates(["thread_id"])
        rows = written(fine.select("thread_id", "next", "state", F.col("patch").alias("callback")), "outcomes")

        def made(known: DataFrame) -> DataFrame:
            before = known.select(F.col("thread_id").alias("__t"), F.col("seq").alias("__seq"))
            return rows.join(before, F.col("thread_id") == F.col("__t"), "left").select("thread_id", (F.coalesce("__seq", F.lit(0)) + 1).cast("long").alias("seq"), "next", "state", "callback")

        self._write(rows, made, tag)
        return self.table.versions.latest()[0]

    def decide(self, decisions: DataFrame, tag: str, order: str = "at") -> DataFrame:
        """Decisions (thread_id, decision, and the column of `order`) with result: ok, not_found, invalid_decision or
        not_awaiting_review, which is also that of the second good decision on a thread. Good ones are in the log then."""
        asked = written(decisions.select("thread_id", "decision", F.col(order).alias("__order")), "decisions")

        def judged(known: DataFrame) -> DataFrame:
            return flow.resumed(known, asked, "__order")

        def made(known: DataFrame) -> DataFrame:
            return judged(known).filter("result = 'ok'").select("thread_id", F.col("seq").cast("long").alias("seq"), "next", "state", F.col("patch").alias("callback"))

        known = self._write(asked, made, tag)
        return written(judged(known).withColumnRenamed("__order", order), "results")

    def _write(self, keys: DataFrame, made: Callable[[DataFrame], DataFrame], tag: str) -> DataFrame:
        """Writes what `made` makes of the last states of these threads, against a state that nobody changes meanwhile; the states before it."""
        while True:
            number, state = self.table.versions.latest()
            own = {p for version, part in state.get("log", []) if version >= state.get("tags", {}).get(tag, number + 1) for p in part.values()}
            before = {b: [p for p in folders if p not in own] for b, folders in state.get("folders", {}).items()}
            known = flow.latest_states(self.table.rows(before, self.table.touched(keys)))
            if tag in state.get("tags", {}):
                return known
            part = self.table.put(made(known))
            try:
                self.table.versions.commit(number, state | {"folders": added(state.get("folders", {}), part), "log": [*state.get("log", []), [number + 1, part]], "tags": state.get("tags", {}) | {tag: number + 1}})
                return known
            except Conflict:
                continue

