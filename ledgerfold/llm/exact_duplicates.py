"""Exact duplicates: a cuckoo-filter index of live digests, whose hits are verified against bucketed content.

Every task of the scan keeps an index of the texts it has met of late and hands on each of them once, with the
number and the best of its copies; texts that fall out of the window are deleted from the index. What is handed
on is dealt by digest, and an index of each part brings the copies from all tasks together. So a text that half
of all rows hold travels once from a task, not once from a row.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, as_batches, input_bytes, small_batches, table, tidied, written

#: What is deleted from a text before it is compared, as bytes: [\x20\x09-\x0D].
BLANK = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes of text that the index of a scanning task holds: older texts are handed on and deleted.
WINDOW = 32 << 20
#: Bytes of the input (as its files are) for each part of the digests; its distinct texts are held by one task.
PART_BYTES = 12 << 20
#: Fingerprints of a bucket, and evictions that an insertion may cause before the table is made larger.
SLOTS, KICKS = 4, 200


def digest_of(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


class CuckooIndex:
    """Live texts by digest: a cuckoo filter of 16-bit fingerprints before buckets of (digest, content, value).

    A digest whose fingerprint is in neither of its two buckets of the filter isn't there: nothing else is read.
    A hit is verified against the contents of the digest's bucket, so that neither a false positive of the filter
    nor two texts of one digest are ever taken for copies. Insertions that find no room after KICKS evictions make
    the table twice as large and fill it anew from the stored digests. The filter has each live digest once,
    and loses it when its last content goes.
    """

    def __init__(self, buckets: int = 256, digest: Callable[[bytes], bytes] = digest_of):
        self.digest, self.live, self.turn = digest, 0, 0
        self._sized(buckets)

    def _sized(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table = array("H", bytes(2 * SLOTS * buckets))
        self.content: list[list[tuple]] = [[] for _ in range(buckets)]

    def __len__(self) -> int:
        return self.live

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        own = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, own, self._other(own, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 >> 3 & self.mask)

    def maybe(self, digest: bytes) -> bool:
        """What the filter alone says: false for certain, true with few false positives."""
        mark, a, b = self._places(digest)
        return mark in self.table[SLOTS * a : SLOTS * a + SLOTS] or mark in self.table[SLOTS * b : SLOTS * b + SLOTS]

    def find(self, digest: bytes, content: bytes):
        """The value of the text, or None."""
        mark, a, b = self._places(digest)
        if mark in self.table[SLOTS * a : SLOTS * a + SLOTS] or mark in self.table[SLOTS * b : SLOTS * b + SLOTS]:
            for d, c, value in self.content[a]:
                if d == digest and c == content:
                    return value
        return None

    def insert(self, digest: bytes, content: bytes, value) -> None:
        """Adds a text that isn't there."""
        own = self.content[self._places(digest)[1]]
        known = any(d == digest for d, _, _ in own)
        own.append((digest, content, value))
        self.live += 1
        if not known and not self._placed(digest):
            self._grow()

    def delete(self, digest: bytes, content: bytes):
        """Takes a text out and gives its value; None, and nothing changes, if it isn't there."""
        mark, a, b = self._places(digest)
        for k, (d, c, value) in enumerate(self.content[a]):
            if d == digest and c == content:
                del self.content[a][k]
                self.live -= 1
                if not any(d == digest for d, _, _ in self.content[a]):
                    for bucket in (a, b):
                        for i in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                            if self.table[i] == mark:
                                self.table[i] = 0
                                return value
                return value
        return None

    def values(self) -> Iterator:
        return (value for bucket in self.content for _, _, value in bucket)

    def _placed(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            for i in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if not self.table[i]:
                    self.table[i] = mark
                    return True
        bucket = b
        for _ in range(KICKS):
            self.turn += 1
            i = SLOTS * bucket + self.turn % SLOTS
            mark, self.table[i] = self.table[i], mark
            bucket = self._other(bucket, mark)
            for i in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if not self.table[i]:
                    self.table[i] = mark
                    return True
        return False

    def _grow(self) -> None:
        """A table twice as large, or more, filled from the stored digests; contents move to the buckets of the new size."""
        stored, buckets = [x for bucket in self.content for x in bucket], len(self.content)
        while True:
            buckets *= 2
            self._sized(buckets)
            for x in stored:
                self.content[self._places(x[0])[1]].append(x)
            if all(self._placed(d) for d in {d for d, _, _ in stored}):
                return


def _better(a: tuple, b: tuple) -> int:
    """Over 0 if (points, id) of a is the better one, 0 if they are equal: more points, then the smaller id; no id comes last."""
    if a[0] != b[0]:
        return 1 if a[0] > b[0] else -1
    if a[1] == b[1]:
        return 0
    return -1 if a[1] is None or b[1] is not None and a[1] > b[1] else 1


class _Tally:
    """Copies of one text: how many, and the best one's points and id, and how many rows have both."""

    __slots__ = ("digest", "content", "points", "id", "n", "n_best")

    def __init__(self, digest, content, points, id_, n, n_best):
        self.digest, self.content, self.points, self.id, self.n, self.n_best = digest, content, points, id_, n, n_best

    def add(self, points, id_, n, n_best):
        self.n += n
        sign = _better((points, id_), (self.points, self.id))
        if sign > 0:
            self.points, self.id, self.n_best = points, id_, n_best
        elif sign == 0:
            self.n_best += n_best

    def row(self, with_content: bool) -> dict:
        return {"digest": self.digest, "content": self.content if with_content else None, "id": self.id, "points": self.points, "n": self.n, "n_best": self.n_best}


def _gathered(rows: Iterator[tuple], window: int | None) -> Iterator[dict]:
    """(digest, content, id, points, n, n_best) with the copies of a text added up: over all rows, or, with a window of so many bytes, as far as it reaches."""
    index, recent, held = CuckooIndex(), {}, 0
    for digest, content, id_, points, n, n_best in rows:
        tally = index.find(digest, content)
        if tally is None:
            tally = _Tally(digest, content, points, id_, n, n_best)
            index.insert(digest, content, tally)
            held += len(content) + 200
        else:
            tally.add(points, id_, n, n_best)
        if window is not None:
            recent.pop(id(tally), None)
            recent[id(tally)] = tally
            while held > window:
                oldest = recent.pop(next(iter(recent)))
                index.delete(oldest.digest, oldest.content)
                held -= len(oldest.content) + 200
                yield oldest.row(True)
    yield from (t.row(window is not None) for t in index.values())


def _scanned(id_kind: pa.DataType, window: int) -> Callable:
    out = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("id", id_kind), ("points", pa.int64()), ("n", pa.int64()), ("n_best", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for id_, points, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    content = raw.translate(None, BLANK)
                    yield digest_of(content), content, id_, points, 1, 1

        yield from as_batches(_gathered(rows(), window), out)

    return run


def _merged(id_kind: pa.DataType) -> Callable:
    out = pa.schema([("digest", pa.binary()), ("id", id_kind), ("points", pa.int64()), ("n", pa.int64()), ("n_best", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)

        yield from as_batches(({k: r[k] for k in out.names} for r in _gathered(rows(), None)), out)

    return run


def _digests(id_kind: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest_of(raw.translate(None, BLANK)) for raw in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(found, pa.binary())], ["id", "points", "row", "digest"])

    return run


def _kind(df: DataFrame, id_column: str) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[id_column].dataType
    return kind.simpleString(), to_arrow_type(kind)


def _read(df: DataFrame, id_column: str, text: str) -> tuple[Column, ...]:
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return F.col(f"`{id_column}`").alias("id"), F.length(whole).cast("long").alias("points"), whole.cast("binary").alias("raw")


def groups(df: DataFrame, id_column: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """One row for each distinct text: digest (SHA-256 of the text without blanks), id and points (code points) of the
    copy that stays, n (copies) and n_best (rows that have that id and those points, over 1 only where an id repeats)."""
    small_batches(df.sparkSession)
    ddl, kind = _kind(df, id_column)
    n = parts or max(1, -(-input_bytes(df.select(f"`{text}`")) // PART_BYTES))
    met = df.select(*_read(df, id_column, text)).mapInArrow(tidied(_scanned(kind, WINDOW)), f"digest binary, content binary, id {ddl}, points long, n long, n_best long")
    return met.repartition(n, "digest").mapInArrow(tidied(_merged(kind)), f"digest binary, id {ddl}, points long, n long, n_best long")


def deduplicated(df: DataFrame, id_column: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Every row of df (only its id and text are read): doc_id, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are the same without the characters [\\x20\\x09-\\x0D]; null counts as empty, so null,
    empty and blank texts are one group. The row of the most code points stays, of several the one of the smallest
    id; one without an id only where all of these lack one (keep_id is null then). Of rows that repeat the id and
    length of the one that stays, exactly one is kept. Whole texts are compared, however long. An empty table gives
    no rows; other columns, of any name, aren't read.
    """
    small_batches(df.sparkSession)
    ddl, kind = _kind(df, id_column)
    with Scratch() as scratch:
        found = scratch.write(groups(df, id_column, text, parts).select("digest", F.col("id").alias("keep_id"), F.col("points").alias("keep_points"), "n", "n_best"), "groups")
        narrow = df.select(*_read(df, id_column, text), F.monotonically_increasing_id().alias("row")).mapInArrow(tidied(_digests(kind)), f"id {ddl}, points long, row long, digest binary")
        # texts of one row need no partner: the others' groups are what is joined
        several = found.filter("n > 1")
        met = narrow.join(several, "digest", "left").withColumn("best", F.col("n").isNull() | (F.col("points") == F.col("keep_points")) & F.col("id").eqNullSafe(F.col("keep_id")))
        placed = written(met.select("id", "row", "digest", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("n"), F.coalesce("n_best", F.lit(1)).cast("long").alias("n_best"), "best"), "members")
        return _told(placed)


def _told(placed: DataFrame) -> DataFrame:
    """kept, once ties of repeated ids are broken by the place of the row: few rows, if any, take part in that."""
    first = placed.filter("best and n_best > 1").groupBy("digest").agg(F.min("row").alias("first"))
    out = placed.join(first, "digest", "left")
    kept = F.col("best") & (F.col("first").isNull() | (F.col("row") == F.col("first")))
    return out.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def replayed(changes: DataFrame, parts: int, seq: str = "seq", action: str = "action", text: str = "text") -> DataFrame:
    """A log of insertions and deletions of texts (action: insert or delete), applied in the order of seq: seq, result
    and copies (of the text, after the change).

    result: new, copy (it was live already), deleted (its last copy went), one_less, absent (nothing to delete) or
    invalid (another action, or none; it changes nothing). The index of a part holds its live texts only.
    """
    small_batches(changes.sparkSession)
    _, kind = _kind(changes, seq)
    out = pa.schema([("seq", kind), ("result", pa.string()), ("copies", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()

        def rows():
            for batch in batches:
                for at, what, digest, content in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    held = index.find(digest, content)
                    if what == "insert":
                        if held is None:
                            index.insert(digest, content, held := [0])
                        held[0] += 1
                        said = "new" if held[0] == 1 else "copy"
                    elif what == "delete" and held:
                        held[0] -= 1
                        said = "one_less" if held[0] else "deleted"
                        if not held[0]:
                            index.delete(digest, content)
                    else:
                        said = "absent" if what == "delete" else "invalid"
                    yield {"seq": at, "result": said, "copies": held[0] if held else 0}

        yield from as_batches(rows(), out)

    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", "").cast("binary")
    keyed = changes.select(F.col(seq).alias("seq"), F.col(action).alias("action"), F.unhex(F.sha2(bare, 256)).alias("digest"), bare.alias("content"))
    dealt = keyed.repartition(parts, "digest").sortWithinPartitions("seq")
    return dealt.mapInArrow(tidied(run), f"seq {changes.schema[seq].dataType.simpleString()}, result string, copies long")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the row that stays of each group of equal texts; see deduplicated() for nulls, ties and repeats."""
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
