"""Patched rows that are kept: a snapshot in buckets, a log of patches since, and a feed of what each one changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.operators.state import FIELDS
from ledgerfold.sources.buckets import Bucketed, Conflict, Versions, added
from ledgerfold.sources.scratch import written


def latest(cells: DataFrame) -> DataFrame:
    """Of cells (key, field, seq, value) the last one of each field; of equal places the larger value, null before any."""
    return cells.groupBy("key", "field").agg(F.max("seq").alias("seq"), F.max_by(F.struct("value"), F.struct("seq", "value")).getField("value").alias("value"))


def cells_of(patches: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Patches (key, seq, patch) as cells (key, field, seq, value): one for each field that a patch has, null ones too."""
    return patches.select("key", "seq", F.explode("patch").alias("field", "value")).filter(F.col("field").isin(*fields)).select("key", "field", "seq", "value")


def wide(cells: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """A row for each key, a column for each field."""
    return cells.groupBy("key").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields))


class PatchTable:
    """The rows that patches make, without folding all patches at each reading.

    A patch has a key, a place in the order (seq, long) and a map of fields: a field that it lacks keeps its value, an
    explicit null overwrites, and of two patches of one field the later one counts, in whatever order they arrive and
    however they are cut into batches. append() writes only the new cells; read() folds the snapshot with those
    since; compact() rewrites the buckets that patches have touched and no others. Every change is one new state, so
    readers and writers don't wait for each other.
    """

    #: Tags that are remembered: a batch is repeated soon or never.
    MOST_TAGS = 1000

    def __init__(self, spark: SparkSession, path: str, key: str = "long", fields: tuple[str, ...] = FIELDS, buckets: int = 32):
        self.fields, self.path, self.spark = fields, path.rstrip("/"), spark
        self.table = Bucketed(spark, path, f"key {key}, field string, seq long, value string", "key", buckets)
        self.images = f"version long, key {key}, seq long, before map<string,string>, after map<string,string>"

    def _cells(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        """All cells of these buckets: of the snapshot, and of the patches since."""
        return self.table.rows(state.get("snapshot", {}), buckets).union(self.table.rows(state.get("delta", {}), buckets))

    def append(self, patches: DataFrame, tag: str | None = None, feed: bool = True) -> int:
        """Takes up patches (key, seq, patch) and gives the version that has them.

        A tag that was taken up before changes nothing: a batch that is repeated counts once. With feed, the rows
        that the patches change are kept with their values before and after.
        """
        new = written(latest(cells_of(patches, self.fields)), "cells")
        if new.isEmpty():
            return self.table.versions.latest()[0]
        touched = self.table.touched(new)
        part = self.table.put(new)
        while True:
            number, state = self.table.versions.latest()
            if tag is not None and tag in state.get("tags", {}):
                return state["tags"][tag]
            tags = dict(sorted(state.get("tags", {}).items(), key=lambda x: x[1])[-self.MOST_TAGS :]) | ({tag: number + 1} if tag is not None else {})
            after = state | {"delta": added(state.get("delta", {}), part), "tags": tags}
            if feed:
                folder = f"{self.path}/feed/{number + 1}-{uuid.uuid4().hex}"
                self._changes(self._cells(state, touched), new, number + 1).write.parquet(folder)
                after["feed"] = [*state.get("feed", []), [number + 1, folder]]
            try:
                return self.table.versions.commit(number, after)
            except Conflict:
                continue  # what was there before has changed, and so have the images

    def _changes(self, old: DataFrame, new: DataFrame, version: int) -> DataFrame:
        """The rows whose values the new cells change, with their maps before and after."""
        keys = new.select("key").distinct()
        before = latest(old.join(keys, "key", "left_semi"))
        image = lambda cells: cells.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("image"), F.max("seq").alias("seq"))  # noqa: E731  a row has as many cells as fields
        was = image(before).select("key", F.col("image").alias("before"))
        now = image(latest(before.union(new))).select("key", "seq", F.col("image").alias("after"))
        met = now.join(was, "key", "left").withColumn("before", F.coalesce("before", F.create_map().cast("map<string,string>")))
        return met.filter(F.to_json("before") != F.to_json("after")).select(F.lit(version).cast("long").alias("version"), "key", "seq", "before", "after")

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """key and the fields; of these keys only (column key), whose buckets alone are opened, if they are given."""
        _, state = self.table.versions.latest()
        cells = self._cells(state, None if keys is None else self.table.touched(keys))
        return wide(latest(cells if keys is None else cells.join(keys.select("key").distinct(), "key", "left_semi")), self.fields)

    def compact(self) -> list[int]:
        """Folds the patches since into the snapshot, and gives the buckets that were rewritten: those with patches."""
        rewritten: list[int] = []

        def step(_: int, state: dict) -> dict | None:
            rewritten[:] = sorted(int(b) for b, own in state.get("delta", {}).items() if own)
            if not rewritten:
                return None
            part = self.table.put(latest(self._cells(state, rewritten)))
            kept = {b: own for b, own in state.get("snapshot", {}).items() if int(b) not in rewritten}
            return state | {"snapshot": kept | {b: [p] for b, p in part.items()}, "delta": {}}

        self.table.versions.change(step)
        return rewritten

    def changes(self, after: int = 0) -> DataFrame:
        """version, key, seq, before and after of every row that was changed in versions beyond `after`."""
        _, state = self.table.versions.latest()
        folders = [p for v, p in state.get("feed", []) if v > after]
        return self.spark.read.schema(self.images).parquet(*folders) if folders else self.spark.createDataFrame([], self.images)


class Subscriber:
    """Follows the changes of a PatchTable from where it stopped: its position is a state of its own folder.

    Each version is handed on once it hasn't been before; `receive` gets (changes, version) and must accept a version
    that it got before a crash, which it knows by the number, or write with it: take() does that.
    """

    def __init__(self, table: PatchTable, path: str, only: Column | None = None):
        self.table, self.only, self.path = table, only, path.rstrip("/")
        self.positions = Versions(table.spark, path)

    def position(self) -> int:
        return self.positions.latest()[1].get("position", 0)

    def _next(self) -> list[tuple[int, DataFrame]]:
        _, state = self.table.table.versions.latest()
        at = self.position()
        rows = lambda p: self.table.spark.read.schema(self.table.images).parquet(p)
        return [(v, rows(p) if self.only is None else rows(p).filter(self.only)) for v, p in state.get("feed", []) if v > at]

    def follow(self, receive: Callable[[DataFrame, int], None]) -> int:
        """Hands on every new version in order, and moves its position after each."""
        for version, rows in self._next():
            receive(rows, version)
            self.positions.change(lambda _, s, v=version: s | {"position": max(v, s.get("position", 0))})
        return self.position()

    def take(self) -> DataFrame:
        """All changes so far as a table of the subscriber's: a version that was written before a crash is written over, so none is missing and none there twice."""
        self.follow(lambda rows, version: rows.write.mode("overwrite").parquet(f"{self.path}/taken/{version}"))
        taken = [f"{self.path}/taken/{v}" for v, _ in self.table.table.versions.latest()[1].get("feed", []) if v <= self.position()]
        return self.table.spark.read.schema(self.table.images).parquet(*taken) if taken else self.table.spark.createDataFrame([], self.table.images)
