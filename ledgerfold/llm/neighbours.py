"""Approximate nearest neighbours by inner product: inverted lists and an adaptive dimension scan.

Vectors get one more component, which makes all lengths equal, so the largest inner product is the
least distance. They are rotated at random and dealt into lists by their nearest centroid. A query
probes the lists of the nearest centroids, as many as a trial on the sample needs. Within a list, many
queries at once, distances are summed over one block of columns after another, and a candidate of a query
is abandoned as soon as its partial distance, by a hypothesis test, is too large for the query's result.
Scores of the rest are exact. Vectors of other dimensions than the commonest are compared in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lowest_hashes, small_batches, table, written

K, EPSILON, COLUMNS = 20, 2.1, 16
#: Share of the true neighbours that lie in the probed lists, in the trial; its queries; lists probed at least.
COVERED, TRIALS, LEAST_LISTS = 0.97, 256, 16
#: Vectors of the sample that centroids are fitted to (about), and its components at most (64 MB as floats);
#: lists at most (of about sqrt(n) vectors below that), vectors of a part of a list (about), queries sent at once.
SAMPLE, SAMPLE_CELLS, LISTS, PART, SENT = 16384, 16 << 20, 2048, 2048, 2048
#: Share of the pairs of a block that go on: below, only their own columns are read.
SPARSE = 0.1


class Index:
    """Rotation, centroids, sizes of the lists, probes, and the sample, which bounds a query's distances from above."""

    def __init__(self, vectors: np.ndarray, most: float, rows: int, seed: int = 3):
        d = vectors.shape[1] + 1
        self.most = most
        self.rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0].astype(np.float32)
        self.sample = self.rotated(vectors)
        lists = int(min(LISTS, len(vectors) / 8, np.sqrt(rows))) or 1
        centroids = self.sample[np.random.default_rng(seed).permutation(len(self.sample))[:lists]].copy()
        for _ in range(8):
            near = self.nearest(self.sample, centroids, 1)[:, 0]
            sums, n = np.zeros_like(centroids), np.bincount(near, minlength=len(centroids))
            np.add.at(sums, near, self.sample)
            centroids[n > 0] = sums[n > 0] / n[n > 0, None]
        self.centroids = centroids
        self.sample_lists = self.nearest(self.sample, centroids, 1)[:, 0]
        self.sizes = np.zeros(len(centroids), np.int64)
        self.probes = self.trial(vectors, seed)

    def trial(self, vectors: np.ndarray, seed: int, k: int = K) -> int:
        """Lists that hold COVERED of the sample's nearest of some of its vectors. Those of all vectors are nearer, so they lie in no more lists."""
        if len(vectors) <= k + 1 or len(self.centroids) <= LEAST_LISTS:
            return len(self.centroids)
        tried = np.random.default_rng(seed + 1).permutation(len(vectors))[:TRIALS]
        q = self.rotated_query(vectors[tried])
        distance = (self.sample**2).sum(1) - 2 * q @ self.sample.T
        distance[np.arange(len(tried)), tried] = np.inf
        found = np.argpartition(distance, k, axis=1)[:, :k]
        order = self.nearest(q, self.centroids, len(self.centroids))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        needed = np.sort(np.take_along_axis(place, self.sample_lists[found], axis=1).ravel())
        return max(LEAST_LISTS, int(needed[int(COVERED * (len(needed) - 1))]) + 1)

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.most - (vectors.astype(np.float64) ** 2).sum(1)))
        return np.column_stack([vectors, rest]).astype(np.float32) @ self.rotation

    def rotated_query(self, vectors: np.ndarray) -> np.ndarray:
        return np.column_stack([vectors, np.zeros(len(vectors), np.float32)]).astype(np.float32) @ self.rotation

    @staticmethod
    def nearest(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
        out = []
        for part in np.array_split(x, max(1, len(x) // 1024)):
            distance = (centroids**2).sum(1) - 2 * part @ centroids.T
            out.append(np.argsort(distance, axis=1, kind="stable")[:, :n] if n > 1 else distance.argmin(1)[:, None])
        return np.concatenate(out)

    def parts(self, i: int) -> int:
        return int(-(-self.sizes[i] // PART)) or 1


def valid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows that take part: id and vector, without nulls, non-finite components or a length of 0."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<float>").alias("v")).filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def build(vectors: DataFrame, scratch: Scratch) -> tuple[Index | None, DataFrame | None]:
    """The index of vectors of one dimension, and its parts: list, part, ids, original vectors and rotated ones (column by column), about PART rows each."""
    spark = vectors.sparkSession
    small_batches(spark)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    stats = vectors.agg(F.count("*").alias("n"), F.max(square).alias("most"), F.max(F.size("v")).alias("d")).first()
    if not stats["n"]:
        return None, None
    most = max(2, min(SAMPLE, SAMPLE_CELLS // (stats["d"] + 1)))
    sample = lowest_hashes(vectors.withColumn("all", F.lit(1)), "vec_id", "all", most).select("vec_id", "v").orderBy("vec_id", "v").collect()
    if not sample:  # so few vectors that none hashes low enough
        sample = vectors.orderBy("vec_id", "v").limit(1).collect()
    index = Index(np.array([r["v"] for r in sample], np.float32), stats["most"], stats["n"])
    shared = spark.sparkContext.broadcast(index)

    def deal(batches):
        held = shared.value
        for batch in batches:
            if batch.num_rows:
                near = held.nearest(held.rotated(_matrix(batch["v"])), held.centroids, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch["vec_id"], batch["v"]], names=["list", "vec_id", "v"])

    dealt = scratch.write(vectors.mapInArrow(deal, "list int, vec_id long, v array<float>"), "lists")
    for row in dealt.groupBy("list").count().collect():
        index.sizes[row["list"]] = row["count"]
    shared = spark.sparkContext.broadcast(index)
    parts = F.array(*(F.lit(index.parts(i)) for i in range(len(index.sizes))))
    cut = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.get(parts, F.col("list"))).cast("int"))

    def pack(key, found):
        found = found.combine_chunks()
        order = np.argsort(found["vec_id"].to_numpy(), kind="stable")
        vectors = _matrix(found["v"].combine_chunks())[order]
        row = {"list": key[0].as_py(), "part": key[1].as_py(), "ids": found["vec_id"].to_numpy()[order].tobytes(), "vectors": vectors.tobytes(), "columns": np.ascontiguousarray(shared.value.rotated(vectors).T).tobytes()}
        return pa.Table.from_pylist([row], schema=pa.schema([("list", pa.int32()), ("part", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("columns", pa.binary())]))

    return index, cut.groupBy("list", "part").applyInArrow(pack, "list int, part int, ids binary, vectors binary, columns binary")


def scan(queries: np.ndarray, columns: np.ndarray, limits: np.ndarray, epsilon: float, step: int, slack: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of queries, column of columns) that the test doesn't abandon: columns is dimensions x candidates.

    After d of D dimensions a candidate whose partial distance exceeds limit * d/D * (1 + epsilon/sqrt(d))**2 goes.
    Blocks of columns are matrix products while many pairs are left; then only what is left is read.
    """
    dims, at = len(columns), 0

    def bound(end: int) -> np.ndarray:
        return (limits * (1 + 1e-4) if end == dims else limits * end / dims * (1 + epsilon / np.sqrt(end)) ** 2).astype(np.float32) + np.float32(slack)

    partial = np.zeros((len(queries), columns.shape[1]), np.float32)
    alive = np.ones(partial.shape, bool)
    while at < dims:
        end = min(dims, at + step)
        q, x = queries[:, at:end], columns[at:end]
        partial += q @ (-2 * x)
        partial += (q * q).sum(1)[:, None] + (x * x).sum(0)
        alive &= partial <= bound(end)[:, None]
        at = end
        if np.count_nonzero(alive) < SPARSE * alive.size:
            break
    row, column = np.nonzero(alive)
    partial = partial[row, column]
    while at < dims and len(row):
        end = min(dims, at + step)
        partial = partial + ((columns[at:end].T[column] - queries[row, at:end]) ** 2).sum(1)
        near = partial <= bound(end)[row]
        row, column, partial = row[near], column[near], partial[near]
        at = end
    return row, column


def _best(query_ids, v, ids, vectors, row, column, k: int) -> list[np.ndarray]:
    """query_id, vec_id and score of the k best pairs of each query, by exact scores: a query isn't its own candidate."""
    score = np.zeros(len(row))
    for at in range(0, len(row), 65536):
        a, b = row[at : at + 65536], column[at : at + 65536]
        score[at : at + 65536] = (vectors[b].astype(np.float64) * v[a].astype(np.float64)).sum(1)
    other = ids[column] != query_ids[row]
    same = np.flatnonzero(~other)
    other[same] = (vectors[column[same]] != v[row[same]]).any(1)
    row, column, score = row[other], column[other], score[other]
    order = np.lexsort((ids[column], -score, row))
    row, column, score = row[order], column[order], score[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    rank = np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row)))
    kept = rank < k
    return [query_ids[row[kept]], ids[column[kept]], score[kept]]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(queries: DataFrame, index: Index | None, parts: DataFrame | None, k: int = K, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of the largest inner product found, ties to the smaller vec_id.

    A query (vec_id, v) isn't its own candidate, nor is a row that repeats both; its id with another vector is one.
    It probes the index's number of lists, and more until they hold twice k candidates; with fewer candidates in
    all, each is a result. Queries that repeat an id count once, with the vector of the least hash.
    """
    spark = queries.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index)
    routed = pa.schema([("list", pa.int32()), ("part", pa.int32()), ("query_ids", pa.binary()), ("queries", pa.binary()), ("limits", pa.binary())])

    def route(batches):
        """SENT queries or a task's that probe a list, as one row for each of its parts."""
        held = shared.value
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def send():
            ids, v = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            probed, limits = np.zeros((len(ids), len(held.centroids)), bool), np.zeros(len(ids))
            for at in range(0, len(ids), 512):
                q = held.rotated_query(v[at : at + 512])
                near = held.nearest(q, held.centroids, len(held.centroids)) if len(held.centroids) > 1 else np.zeros((len(q), 1), np.int64)
                enough = np.cumsum(held.sizes[near], axis=1) < 2 * k + 1
                probes = np.maximum(held.probes, enough.sum(1) + 1)
                own = np.zeros(near.shape, bool)
                np.put_along_axis(own, near, np.arange(near.shape[1])[None, :] < probes[:, None], axis=1)
                # the distance of the spare-th vector of the sample in the probed lists bounds the k-th of all
                # from above; what is spare makes up for candidates that the test abandons wrongly
                spare = 2 * k
                distance = np.maximum(0, (q**2).sum(1)[:, None] + (held.sample**2).sum(1) - 2 * q @ held.sample.T)
                distance[~own[:, held.sample_lists]] = np.inf
                limits[at : at + 512] = np.partition(distance, spare, axis=1)[:, spare] if distance.shape[1] > spare else np.inf
                probed[at : at + 512] = own
            for i in range(probed.shape[1]):
                own = np.flatnonzero(probed[:, i])
                if len(own):
                    row = {"list": i, "query_ids": ids[own].tobytes(), "queries": v[own].tobytes(), "limits": limits[own].astype(np.float64).tobytes()}
                    yield pa.RecordBatch.from_pylist([row | {"part": p} for p in range(held.parts(i))], schema=routed)

        for batch in batches:
            if batch.num_rows:
                waiting.append((batch["vec_id"].to_numpy(), _matrix(batch["v"])))
            if sum(len(x) for x, _ in waiting) >= SENT:
                yield from send()
        if waiting:
            yield from send()

    sent = _once(queries).mapInArrow(route, "list int, part int, query_ids binary, queries binary, limits binary")
    met = sent.join(parts, ["list", "part"])

    def match(batches):
        held = shared.value
        dims = held.rotation.shape[0] - 1
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ids, vectors = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float32).reshape(-1, dims)
                columns = np.frombuffer(row["columns"], np.float32).reshape(dims + 1, -1)
                query_ids, v = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["queries"], np.float32).reshape(-1, dims)
                limits = np.frombuffer(row["limits"], np.float64)
                for at in range(0, len(v), 512):
                    x = v[at : at + 512]
                    found = scan(held.rotated_query(x), columns, limits[at : at + 512], epsilon, COLUMNS, 1e-5 * max(1.0, held.most))
                    out.append(_best(query_ids[at : at + 512], x, ids, vectors, *found, k))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return _ranked(met.select("ids", "vectors", "columns", "query_ids", "queries", "limits").mapInArrow(match, "query_id long, vec_id long, score double"), k)


def _once(queries: DataFrame) -> DataFrame:
    return queries.groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))


def compare(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """search() in full, for vectors of any dimensions: a query's candidates are the rows of its own dimension, in blocks of about PART."""
    sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.ceil(F.count("*") / PART).alias("parts"))
    blocks = vectors.withColumn("d", F.size("v")).join(sizes, "d").groupBy("d", F.pmod(F.xxhash64("vec_id", "v"), "parts").alias("part")).agg(F.collect_list("vec_id").alias("ids"), F.flatten(F.collect_list("v")).alias("vectors"))
    asked = _once(queries).withColumn("d", F.size("v")).groupBy("d", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("q")).agg(F.collect_list("vec_id").alias("query_ids"), F.flatten(F.collect_list("v")).alias("queries"))

    def match(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, query_ids = np.array(row["ids"], np.int64), np.array(row["query_ids"], np.int64)
                x, v = np.array(row["vectors"], np.float32).reshape(len(ids), -1), np.array(row["queries"], np.float32).reshape(len(query_ids), -1)
                for at in range(0, len(v), 64):
                    pairs = np.divmod(np.arange(len(v[at : at + 64]) * len(ids)), len(ids))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best(query_ids[at : at + 64], v[at : at + 64], ids, x, *pairs, k)], names=["query_id", "vec_id", "score"])

    return _ranked(asked.join(blocks, "d").select("ids", "vectors", "query_ids", "queries").mapInArrow(match, "query_id long, vec_id long, score double"), k)


def nearest(vectors: DataFrame, queries: str, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the rows of (vec_id, v) that `queries` (a condition) holds for, among all other rows.

    Only vectors of the same dimension are comparable. Those of the commonest one are searched by an index,
    the others, which a clean table doesn't have, compared in full. An empty table gives no rows. The result
    is a written table.
    """
    dims = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(2).collect()
    with Scratch() as scratch:
        main = F.size("v") == (dims[0]["d"] if dims else 0)
        index, parts = build(vectors.filter(main), scratch)
        found = search(vectors.filter(main).filter(queries), index, parts, k)
        if len(dims) > 1:
            found = found.union(compare(vectors.filter(~main).filter(queries), vectors.filter(~main), k))
        return written(found, "neighbours")


def op6_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20, among all other rows."""
    return nearest(valid(table(spark, sf_dir, "embeddings")), "vec_id % 20 = 0")
