"""Merkle manifest of a table: a hash tree over the rows of each group, a tree over the groups, and a proof for each row.

Rows are reduced to the hashes of their leaves before they move. Leaves are range-sorted by group and id; from the
number of rows of each group in each partition comes the offset of the partition in the group, and so the place of
every leaf. A task then builds the complete subtrees of 256 aligned leaves among its own rows; the leaves at its ragged
ends are shuffled by their subtree's coordinate. The levels above, a 256th of the rows, are built by coordinate,
level by level, and read downwards for the rest of each subtree's proofs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FEW, Scratch, as_batches, small_batches, table, tidied, written

#: Nodes of a run, and levels of the subtrees that tasks build: 256 leaves.
ARITY, HEIGHT = 16, 2
SUBTREE = ARITY**HEIGHT
#: Rows of a range partition at most, where the session asks for fewer partitions; at least so many where for more.
MOST_ROWS, LEAST_ROWS = 1 << 20, 1 << 10
#: Pairs of partition and group that may be broadcast (some 100 bytes each).
PAIRS = 100 * FEW

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def leaf_of(*fields: Column) -> Column:
    """SHA-256 (32 bytes) of the fields end to end: each is `-` if null, else its UTF-8 byte count, `:` and its value."""
    text = [f.cast("string") for f in fields]
    each = (F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text)
    return F.unhex(F.sha2(F.concat(*each).cast("binary"), 256))


def joined_hash(nodes: str) -> str:
    """The hash of digests that stand end to end as hex text."""
    return hashlib.sha256(nodes.encode()).hexdigest()


def indexed(df: DataFrame, group: str, order: list[str], scratch: Scratch) -> DataFrame:
    """df with i, the place of the row in its group from 0 in the given order, and total, the group's rows.

    Rows are sorted by range over all groups. Offsets come from the rows that each partition has of each group; a
    group of any size is spread over partitions, and no task or driver has more than the pairs of one group.
    """
    spark = df.sparkSession
    n = df.count()
    wished = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // MOST_ROWS))
    parts = max(1, min(wished, n // LEAST_ROWS))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = scratch.write(df.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).select("*", F.spark_partition_id().alias("p"), place.alias("place")), "ranged")
    pairs = ranged.groupBy("p", group).agg(F.count("*").alias("c"), F.min("place").alias("first"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("c").over(own.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = scratch.write(pairs.select("p", group, (before - F.col("first")).alias("shift"), F.sum("c").over(own).alias("total")), "offsets")
    few = offsets.count() <= PAIRS
    out = ranged.join(F.broadcast(offsets) if few else offsets, ["p", group]).withColumn("i", F.col("place") + F.col("shift")).drop("p", "place", "shift")
    return out if few else out.sortWithinPartitions(group, "i")


def _levels(total: int) -> int:
    """Levels within a subtree of a group of so many leaves: HEIGHT, or as many as leave one node."""
    level = 0
    while level < HEIGHT and total > ARITY**level:
        level += 1
    return level


def _rows_up(leaves: str, levels: int) -> list[str]:
    """The subtree's nodes by level as hex text, leaves first."""
    out = [leaves]
    for _ in range(levels):
        out.append("".join(joined_hash(out[-1][k : k + 64 * ARITY]) for k in range(0, len(out[-1]), 64 * ARITY)))
    return out


def _pieces(id_kind: pa.DataType) -> Callable:
    """Rows (g, i, total, id, leaf, shown) as pieces of subtrees: complete ones, with their top node, and ragged ones."""
    out = pa.schema([("g", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(id_kind)), ("leaves", pa.binary()), ("shown", pa.binary()), ("top", pa.binary())])

    def closed(g, start, total, ids, leaves, shown) -> dict:
        block = start // SUBTREE
        whole = start == block * SUBTREE and len(ids) == min(SUBTREE, total - start)
        top = bytes.fromhex(_rows_up(leaves.hex(), _levels(total))[-1]) if whole else None
        return {"g": g, "block": block, "total": total, "start": start, "ids": ids, "leaves": bytes(leaves), "shown": bytes(shown), "top": top}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            now, following = None, None
            for batch in batches:
                for g, i, total, id_, leaf, shown in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                    if following != (g, i):
                        if now:
                            yield closed(*now)
                        now = (g, i, total, [], bytearray(), bytearray())
                    now[3].append(id_)
                    now[4].extend(leaf)
                    now[5].extend(shown)
                    following = (g, i + 1) if (i + 1) % SUBTREE else None
            if now:
                yield closed(*now)

        yield from as_batches(rows(), out, 64)

    return run


def _topped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tops = [bytes.fromhex(_rows_up(leaves.hex(), _levels(total))[-1]) for total, leaves in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(tops, pa.binary())], [*batch.schema.names[:7], "top"])


def _subtrees(placed: DataFrame, id_kind: pa.DataType, ddl: str, scratch: Scratch) -> DataFrame:
    """All subtrees of the leaves: g, block, total, ids, leaves, shown, top."""
    columns = f"g string, block long, total long, start long, ids array<{ddl}>, leaves binary, shown binary, top binary"
    found = scratch.write(placed.select("g", "i", "total", "id", "leaf", "shown").mapInArrow(tidied(_pieces(id_kind)), columns), "pieces")
    met = found.filter("top is null").groupBy("g", "block").agg(F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("start", "ids", "leaves", "shown"))).alias("pieces"))
    end_to_end = lambda c: F.aggregate("pieces", F.lit(b""), lambda so_far, x: F.concat(so_far, x[c]))
    mended = met.select("g", "block", "total", F.lit(0).cast("long").alias("start"), F.flatten("pieces.ids").alias("ids"), end_to_end("leaves").alias("leaves"), end_to_end("shown").alias("shown"), F.lit(None).cast("binary").alias("top"))
    return written(found.filter("top is not null").union(mended.mapInArrow(tidied(_topped), columns)), "subtrees")


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _climbed(nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """The trees over nodes (g, j, n, digest; n nodes of the group on this level): the last node of each group as
    (g, digest), and by level the nodes and the runs (g, up, n, run of (j, digest), digest)."""
    levels, runs, left = [nodes], [], nodes.agg(F.max("n")).first()[0] or 0
    while left > 1:
        grouped = levels[-1].filter("n > 1").groupBy("g", F.expr(f"j div {ARITY}").alias("up")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("j", "digest"))).alias("run"))
        whole = F.array_join(F.transform("run", lambda x: _hex(x["digest"])), "")
        runs.append(scratch.write(grouped.withColumn("digest", F.unhex(F.sha2(whole.cast("binary"), 256))), "runs"))
        levels.append(runs[-1].select("g", F.col("up").alias("j"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), "digest"))
        left = -(-left // ARITY)
    ends = [level.filter("n = 1").select("g", "digest") for level in levels]
    last = ends[0]
    for e in ends[1:]:
        last = last.union(e)
    return last, levels, runs


def _paths(levels: list[DataFrame], runs: list[DataFrame], base: DataFrame) -> DataFrame:
    """(g, j, path, and the other columns of base) for the nodes of the first level: the siblings (left, right), as hex
    text, of every level upwards. base: g and what follows above the group's own tree, path among it."""
    rest = [c for c in base.columns if c not in ("g", "path")]

    def at(k: int) -> DataFrame:
        alone = levels[k].filter("n = 1").select("g", "j").join(base, "g")
        if k == len(runs):
            return alone
        side = lambda after: F.array_join(F.transform(F.filter("run", lambda x: (x["j"] > F.col("kid.j")) if after else (x["j"] < F.col("kid.j"))), lambda x: _hex(x["digest"])), "")
        kids = runs[k].select("g", "up", "run", F.explode("run").alias("kid")).select("g", "up", F.col("kid.j").alias("j"), F.struct(side(False).alias("left"), side(True).alias("right")).alias("step"))
        met = kids.join(at(k + 1).withColumnRenamed("j", "up"), ["g", "up"])
        return alone.select("g", "j", "path", *rest).union(met.select("g", "j", F.concat(F.array("step"), "path").alias("path"), *rest))

    return at(0)


def _trees(df: DataFrame, leaf: Column, shown: Column, id_column: str, group: str, scratch: Scratch):
    """Subtrees, trees of the groups, and for each group its way up: (g, path, subroot), and the root. None for no rows."""
    small_batches(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[id_column].dataType
    g = F.when(F.col(f"`{group}`").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")))  # sorts null first, then by bytes
    leaves = scratch.write(df.select(g.alias("g"), F.col(f"`{id_column}`").alias("id"), leaf.alias("leaf"), shown.alias("shown"), F.monotonically_increasing_id().alias("row")), "leaves")
    placed = indexed(leaves, "g", ["id", "leaf", "row"], scratch).select("g", "i", "total", "id", "leaf", F.coalesce("shown", "leaf").alias("shown"))
    subtrees = _subtrees(placed, to_arrow_type(kind), kind.simpleString(), scratch)
    tops = subtrees.select("g", F.col("block").alias("j"), F.expr(f"(total + {SUBTREE - 1}) div {SUBTREE}").alias("n"), F.col("top").alias("digest"))
    last, levels, runs = _climbed(tops, scratch)
    groups = indexed(scratch.write(last.select(F.lit("").alias("all"), F.col("g").alias("name"), "digest"), "subroots"), "all", ["name"], scratch)
    above = scratch.write(groups.select(F.col("all").alias("g"), F.col("i").alias("j"), F.col("total").alias("n"), "digest", "name"), "groups")
    final, above_levels, above_runs = _climbed(above.select("g", "j", "n", "digest"), scratch)
    found = final.first()
    if found is None:
        return subtrees, None, None
    root = bytes(found["digest"]).hex()
    none = F.array().cast("array<struct<left:string,right:string>>").alias("path")
    upwards = _paths(above_levels, above_runs, final.select("g", none))
    base = scratch.write(above.join(upwards, ["g", "j"]).select(F.col("name").alias("g"), "path", _hex(F.col("digest")).alias("subroot")), "base")
    return subtrees, _paths(levels, runs, base), root


def manifest(df: DataFrame, leaf: Column, id_column: str = "doc_id", group: str = "source") -> DataFrame:
    """What a data set's publisher signs: for each group (null first) its number of rows and subroot, and with each the root."""
    with Scratch() as scratch:
        subtrees, paths, root = _trees(df, leaf, F.lit(None).cast("binary"), id_column, group, scratch)
        if root is None:
            return df.sparkSession.createDataFrame([], f"`{group}` string, n_rows long, subroot string, root string")
        sizes = subtrees.groupBy("g").agg(F.first("total").alias("n_rows"))
        name = F.when(F.col("g") != "", F.substring("g", 2, 2**31 - 1)).alias(group)
        return written(sizes.join(paths.groupBy("g").agg(F.first("subroot").alias("subroot")), "g").select(name, "n_rows", "subroot", F.lit(root).alias("root")), "manifest")


def _proved(root: str, id_kind: pa.DataType) -> Callable:
    out = pa.schema([("id", id_kind), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for total, ids, leaves, shown, path, subroot in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                    levels = _levels(total)
                    up = _rows_up(leaves.hex(), levels)
                    above, known = "".join(s["left"] + s["right"] for s in path), {}
                    for x, id_ in enumerate(ids):
                        siblings, node, at = [], shown[32 * x : 32 * x + 32].hex(), x
                        for level in range(levels):
                            run_of, o = up[level][64 * ARITY * (at // ARITY) :][: 64 * ARITY], 64 * (at % ARITY)
                            siblings += (run_of[:o], run_of[o + 64 :])
                            node = joined_hash(run_of[:o] + node + run_of[o + 64 :])
                            at //= ARITY
                        if node not in known:
                            folded = node
                            for s in path:
                                folded = joined_hash(s["left"] + folded + s["right"])
                            known[node] = folded
                        yield {"id": id_, "leaf": up[0][64 * x : 64 * x + 64], "subroot": subroot, "root": root, "proof_sha256": joined_hash("".join(siblings) + above), "folded_root": known[node], "verified": known[node] == root}

        yield from as_batches(rows(), out)

    return run


def proofs(df: DataFrame, leaf: Column, shown: Column | None = None, id_column: str = "doc_id", group: str = "source") -> DataFrame:
    """Every row of df: id, leaf, subroot, root, proof_sha256 (of all siblings from its run up to the root), and
    whether the shown leaf, folded with these siblings, gives the root (folded_root, verified).

    leaf and shown: 32 bytes each, as by leaf_of(); a null shown leaf is the leaf itself. A null group is a group of
    its own, before the others; in a group a null id comes first, and rows of one id stand in the order of their
    leaves (equal ones can be told apart by nothing). An empty table gives no rows. Only the columns that leaf, shown,
    id and group name are read; others may have any name.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[id_column].dataType
    columns = f"id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    scratch = Scratch()  # the result reads its tables
    subtrees, paths, root = _trees(df, leaf, F.lit(None).cast("binary") if shown is None else shown, id_column, group, scratch)
    if root is None:
        return df.sparkSession.createDataFrame([], columns).withColumnRenamed("id", id_column)
    met = subtrees.join(paths.withColumnRenamed("j", "block"), ["g", "block"])
    return met.select("total", "ids", "leaves", "shown", "path", "subroot").mapInArrow(tidied(_proved(root, to_arrow_type(kind))), columns).withColumnRenamed("id", id_column)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their proofs; where 5 divides crc32 of the decimal id (rows without an id aside), the text shown
    is in lower case. See proofs() for nulls, ties and repeated rows."""
    docs, names = table(spark, sf_dir, "documents"), ("doc_id", "source", "lang", "n_chars")
    whole = leaf_of(*(F.col(c) for c in names), F.col("text"))
    lowered = leaf_of(*(F.col(c) for c in names), F.translate("text", UPPER, UPPER.lower()))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return proofs(docs, whole, F.when(tampered, lowered))
