"""Hard negatives: inner products by blocks of anchors, in two passes over all rows.

A block of anchors, of a bounded size, is broadcast; tasks multiply it with their rows, batch by batch, in float64.
The first pass keeps each anchor's best rows of its own label, a list that merges with another task's; the second
keeps, below the score of each of these positives, the best rows of other labels within a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table, tidied, written

#: Bytes of the anchors' vectors that are broadcast at once, and anchors at most.
BLOCK_BYTES, BLOCK_ANCHORS = 16 << 20, 8192
#: Anchors and rows of one product: 2 MB.
TILE_ANCHORS, TILE_ROWS = 256, 1024
#: Sums of products below this are exact in float64.
EXACT = float(1 << 53)
#: The largest score of 38 digits: scores travel as decimals, since those of very large vectors don't fit 64 bits.
LARGEST = 10**38 - 1
#: Negatives score from LOW to HIGH hundredths of the positive's score.
LOW, HIGH = 80, 100
LONG = np.iinfo(np.int64)


class Block:
    """Vectors of one dimension with ids and labels, ids ascending."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]

    def tiles(self, size: int) -> Iterator[Block]:
        for k in range(0, len(self.ids), size):
            yield Block(self.ids[k : k + size], self.labels[k : k + size], self.vectors[k : k + size])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows as 64-bit integers; as Python's where float64 can't hold them, within LARGEST."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object)
    return np.clip(whole(a) @ whole(b).T, -LARGEST, LARGEST)


def blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    """vec_id, label and embedding of a batch as blocks by dimension: components become floor(256 x); rows with a null
    or a component that is null or not finite are left out."""
    ids, labels, lists = (batch.column(k) for k in range(3))
    good = np.array(ids.is_valid()) & np.array(labels.is_valid()) & np.array(lists.is_valid())
    lengths = np.where(good, np.array(lists.value_lengths().fill_null(0)), -1)
    for d in np.unique(lengths[good]):
        rows = np.flatnonzero(lengths == d)
        part = lists.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan)
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = np.floor(part.to_numpy(zero_copy_only=False).reshape(len(rows), d) * 256.0)
        fine = np.isfinite(scaled).all(axis=1)
        if fine.any():
            kept = pa.array(rows[fine])
            yield Block(ids.take(kept).to_numpy(), labels.take(kept).to_numpy(), scaled[fine])


class Best:
    """For each of n lists, the k best (score, id): higher scores first, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, [[] for _ in range(n)], [[] for _ in range(n)]
        self.least = np.full(n, -LARGEST, object)  # score of the last one of a full list

    def offer(self, lists: np.ndarray, scores: np.ndarray, wanted: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each of `lists`, a column for each of ids, which ascend; only the wanted entries count."""
        floor = self.least[lists][:, None]
        if scores.dtype != object:
            floor = np.clip(floor, int(LONG.min), int(LONG.max)).astype(np.int64)
        rows, columns = np.nonzero(wanted & (scores >= floor))
        if not len(rows):
            return
        values = scores[rows, columns]
        if scores.dtype != object:
            order = np.lexsort((columns, -values, rows))
        else:
            order = np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -values[i], columns[i])))
        rows, columns, values = rows[order], columns[order], values[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        for start, end in zip(first, np.r_[first[1:], len(rows)], strict=True):
            end = min(end, start + self.k)
            self.add(int(lists[rows[start]]), zip(values[start:end].tolist(), ids[columns[start:end]].tolist(), strict=True))

    def add(self, n: int, pairs) -> None:
        """Merges (score, id) pairs into list n."""
        both = sorted([*zip(self.scores[n], self.ids[n], strict=True), *pairs], key=lambda x: (-x[0], x[1]))[: self.k]
        self.scores[n], self.ids[n] = [x[0] for x in both], [x[1] for x in both]
        if len(both) == self.k:
            self.least[n] = both[-1][0]

    def batches(self, schema: pa.Schema, key: Callable[[int], dict]) -> Iterator[pa.RecordBatch]:
        held = []
        for n, (scores, ids) in enumerate(zip(self.scores, self.ids, strict=True)):
            held += [key(n) | {"row_id": i, "score": int(s)} for s, i in zip(scores, ids, strict=True)]
            if len(held) >= 4096:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)


SCORE = pa.decimal128(38, 0)
FIRST = pa.schema([("anchor_id", pa.int64()), ("row_id", pa.int64()), ("score", SCORE)])
SECOND = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("row_id", pa.int64()), ("score", SCORE)])
_DDL = "anchor_id long, {}row_id long, score decimal(38,0)"


def _pass(anchors: list[Block], wanted: Callable, n_lists: int, k: int, schema: pa.Schema, key: Callable[[int], dict]) -> Callable:
    """A mapInArrow function that meets all rows with the anchors (their lists are numbered in order of the blocks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n_lists, k)
        for batch in batches:
            for block in blocks(batch):
                start = 0
                for own in anchors:
                    if own.vectors.shape[1] == block.vectors.shape[1]:
                        for at in range(0, len(own.ids), TILE_ANCHORS):
                            a = slice(at, at + TILE_ANCHORS)
                            for rows in block.tiles(TILE_ROWS):
                                scores = product(own.vectors[a], rows.vectors)
                                own_lists = np.arange(start + at, start + at + len(scores))
                                for lists, mask in wanted(own, a, own_lists, rows, scores):
                                    best.offer(lists, scores, mask, rows.ids)
                    start += len(own.ids)
        yield from best.batches(schema, key)

    return run


def _merged(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each key over all tasks' lists."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _rows(df: DataFrame, id_column: str, label: str, vector: str) -> DataFrame:
    return df.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("vector")).filter("vec_id is not null and label is not null and vector is not null")


def mined(df: DataFrame, every: int = 100, id_column: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score for the rows whose id `every` divides.

    Rows with a null id, label or vector, or a component that is null or not finite (after times 256, too), take
    no part; vectors of different dimensions aren't compared, those without any component have products of 0. A row
    isn't compared with rows of its own id; where an anchor's id repeats, the row of the least label and vector is
    the anchor; each row of a repeated id is a candidate, and a positive, by itself. An anchor or positive for which nothing
    is found has no row. Products are exact, up to 38 digits; as 64-bit results they are held to that range. An empty table gives
    no rows; other columns, of any name, aren't read.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = _rows(df, id_column, label, vector)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    with Scratch() as scratch:
        chosen = scratch.write(rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("own")).select("vec_id", "own.label", "own.vector"), "anchors")
        size = chosen.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
        most = min(BLOCK_ANCHORS, max(1, BLOCK_BYTES // (8 * max(1, size["d"] or 1))))
        n_blocks = -(-size["n"] // most)
        # a block is a bucket of hashed ids, so its size is binomial around the bound
        parts = [_block(rows, chosen.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == k), positives, negatives) for k in range(n_blocks)]
    if not parts:
        return spark.createDataFrame([], out)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    held = lambda c: F.greatest(F.least(F.col(c), F.lit(int(LONG.max))), F.lit(int(LONG.min))).cast("long")
    return whole.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"), held("positive_score").alias("positive_score"), held("score").alias("negative_score"))


def _block(rows: DataFrame, own: DataFrame, positives: int, negatives: int) -> DataFrame:
    """Both passes over all rows for a block of anchors, which is broadcast with its positives."""
    context = rows.sparkSession.sparkContext
    anchors = [b for batch in own.select("vec_id", "label", "vector").toArrow().combine_chunks().to_batches() for b in blocks(batch)]
    ids = [int(i) for b in anchors for i in b.ids]
    shared = context.broadcast(anchors)

    def same_label(own: Block, a: slice, lists: np.ndarray, rows: Block, scores: np.ndarray):
        yield lists, (own.labels[a, None] == rows.labels[None]) & (own.ids[a, None] != rows.ids[None])

    first = rows.mapInArrow(tidied(lambda batches: _pass(shared.value, same_label, len(ids), positives, FIRST, lambda n: {"anchor_id": ids[n]})(batches)), _DDL.format(""))
    with Scratch() as scratch:
        found = scratch.write(_merged(first, ["anchor_id"], positives), "positives")
        # `positives` at most for each anchor of the block
        at, score_of, there = {i: n for n, i in enumerate(ids)}, np.zeros((len(ids), positives), object), np.zeros((len(ids), positives), bool)
        for r in found.collect():
            score_of[at[r["anchor_id"]], r["rank"] - 1], there[at[r["anchor_id"]], r["rank"] - 1] = int(r["score"]), True
        limits = context.broadcast((score_of, there))

        def in_window(own: Block, a: slice, lists: np.ndarray, rows: Block, scores: np.ndarray):
            score_of, there = limits.value
            other = own.labels[a, None] != rows.labels[None]
            for k in range(positives):
                # in whole numbers: LOW p <= HIGH n, and n <= p
                low, high = np.array([-(-LOW * p // HIGH) for p in score_of[lists, k]], object), score_of[lists, k]
                if scores.dtype != object:
                    low, high = (np.clip(v, int(LONG.min), int(LONG.max)).astype(np.int64) for v in (low, high))
                yield lists * positives + k, other & there[lists, k][:, None] & (scores >= low[:, None]) & (scores <= high[:, None])

        def key(n: int) -> dict:
            return {"anchor_id": ids[n // positives], "place": n % positives + 1}

        second = rows.mapInArrow(tidied(lambda batches: _pass(shared.value, in_window, len(ids) * positives, negatives, SECOND, key)(batches)), _DDL.format("place int, "))
        best = _merged(second, ["anchor_id", "place"], negatives)
        return written(best.join(found.select("anchor_id", F.col("rank").alias("place"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor_id", "place"]), "mined")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings, where labels of ids that 7 divides are one more, modulo 10; see mined() for nulls, ties and repeats."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding"))
