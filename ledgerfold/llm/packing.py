"""Packing: cost-balanced packing of tokenised documents into sequences of a fixed length.

Pieces are dealt into shards of a bounded number of tokens. In a shard they are taken in descending
length, and each goes to the sequence of the lowest estimated cost (linear plus quadratic in the
lengths of its pieces) that has room for it; a piece that no sequence can hold is cut over those
that have room left.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batches, input_bytes, power_of_two, small_batches, table, tidied

LENGTH, END = 4096, 2
#: Estimated cost of a sequence: its tokens, plus QUADRATIC for each pair of tokens of one piece.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Bytes of the input table for each shard: a few million tokens at most.
SHARD_BYTES = 8 << 20
#: Shuffle partitions of the shards at most: a task takes one shard after another.
PARTITIONS = 1 << 15
#: Pre-tokens, and what stands between white space, that a worker remembers (some 150 bytes each), and fewer where
#: other steps need the memory.
REMEMBERED, FEWER = 600_000, 80_000

SCHEMA = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@cache
def tokenizer(path: str, remembered: int = REMEMBERED) -> Encoder:
    """One for each worker process."""
    return Encoder(path, remembered)


class Encoder(dict):
    """ids of whole texts as little-endian 32-bit bytes, the same as the tokenizer's own.

    What stands between white space repeats, and so do the pre-tokens in it: each is encoded once and
    remembered. No pre-token holds white space, and one is split alike wherever it stands. Texts with
    characters beyond Latin-1 or with a special token's mark go through the tokenizer itself.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import regex
        from tokenizers import Tokenizer

        self.half = remembered // 2
        self.older: dict[str, bytes] = {}  # a full half is put aside here, and goes when the next one is full; what is met meanwhile moves back
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.simple = re.compile(r"[\x09-\x0D\x20-\x7E\xA1-\xAC\xAE-\xFF]*").fullmatch
        # byte-level BPE shows a byte that isn't printable as a character from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.bytes = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        # the fast path holds for lower-casing word BPE with this split only: it is tried before it is used
        trial = "It's 2 l'Été, ÀB\tdon't—¿qué? #x$ ½ Straße\nAbc 12"
        self.fast = self._plain(trial.replace("—", "-")) == self._own(trial.replace("—", "-"))
        self.clear()

    def __missing__(self, word: str) -> bytes:
        parts = () if (found := self.older.pop(word, None)) is not None else self.split(word)
        if len(parts) > 1:
            found = b"".join(map(self.__getitem__, parts))
        elif parts:
            ids = self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes))
            found = b"".join([t.id.to_bytes(4, "little") for t in ids])
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.lower().split()))

    def _own(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.fast and "<|" not in text and self.simple(text):
            return self._plain(text)
        return self._own(text)


def pieces(documents: DataFrame, path: str, length: int = LENGTH, end: int = END, shards: int = 1, remembered: int = REMEMBERED) -> DataFrame:
    """Tokenises (doc_id, text) and cuts at multiples of `length`: doc_id, start, ids (unsigned 16-bit where
    all ids fit), doc_tokens, shard. A null text is empty; every document ends with the id `end`."""
    small_batches(documents.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("wide", pa.bool_()), ("doc_tokens", pa.int64())])
    last = int(end).to_bytes(4, "little")

    def run(batches):
        encoder = tokenizer(path, remembered)

        def rows():
            for batch in batches:
                for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    ids = np.frombuffer(encoder.encode(text or "") + last, "<u4")
                    for start in range(0, len(ids), length):
                        piece = ids[start : start + length]
                        wide = bool(piece.max() > 0xFFFF)
                        yield {"doc_id": doc, "start": start, "ids": (piece if wide else piece.astype("<u2")).tobytes(), "wide": wide, "doc_tokens": len(ids)}

        yield from as_batches(rows(), schema)

    cut = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, start long, ids binary, wide boolean, doc_tokens long")
    return cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", F.crc32("ids")), F.lit(shards)).cast("int"))


def assign(lengths: np.ndarray, length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(piece, begin, size, sequence, offset) for pieces of these lengths, each from 1 to `length` tokens.

    As few sequences as can hold all tokens are open. Descending pieces, ties by their place, go to the
    open sequence of the lowest cost (ties: the first) that has room; one that fits none is cut.
    """
    total = int(lengths.sum())
    sequences = -(-total // length)
    room, cost = np.full(sequences, length, np.int64), np.zeros(sequences)
    out = []

    def put(i: int, begin: int, size: int, s: int) -> None:
        out.append((i, begin, size, s, length - int(room[s])))
        room[s] -= size
        cost[s] += linear * size + quadratic * size * size if room[s] else np.inf

    for i in np.argsort(-lengths, kind="stable"):
        size, begin = int(lengths[i]), 0
        fits = np.where(room >= size, cost, np.inf)
        s = int(np.argmin(fits))
        if np.isfinite(fits[s]):
            put(int(i), 0, size, s)
            continue
        while size:
            # cut into the most room, so into as few parts as can be; ties: the lowest cost
            most = room.max()
            s = int(np.argmin(np.where(room == most, cost, np.inf)))
            part = min(size, int(most))
            put(int(i), begin, part, s)
            begin, size = begin + part, size - part
    return out


def pack(documents: DataFrame, path: str, length: int = LENGTH, end: int = END, shards: int | None = None, remembered: int = REMEMBERED, split: int = 1) -> DataFrame:
    """Packs every document of (doc_id, text): one row per piece, with its ids (little-endian unsigned 32-bit).

    sequence_id is the shard times 2**32 plus a number from 0. Repeated rows are packed each on their own; a null
    or empty text is its end mark alone; a long one is cut; a null doc_id stays null; an empty table gives no rows;
    other columns are not read. shards: by default one for each SHARD_BYTES of the input, or `split` smaller
    ones, which a task takes one after another; remembered: see REMEMBERED.
    """
    if shards is None:
        shards = power_of_two(input_bytes(documents) / SHARD_BYTES) * split
    dealt = pieces(documents, path, length, end, shards, remembered).repartition(min(-(-shards // split), PARTITIONS), "shard")

    def run(key, table):
        shard = key[0].as_py()
        order = np.lexsort((table["start"].to_numpy(), table["doc_id"].fill_null(-(2**63)).to_numpy()))
        table = table.take(pa.array(order))
        docs, starts, totals = table["doc_id"].to_pylist(), table["start"].to_pylist(), table["doc_tokens"].to_pylist()
        ids = [np.frombuffer(x, "<u4" if wide else "<u2") for x, wide in zip(table["ids"].to_pylist(), table["wide"].to_pylist(), strict=True)]
        columns: list[list] = [[] for _ in range(8)]
        for i, begin, size, s, offset in assign(np.array([len(x) for x in ids], np.int64), length):
            part = ids[i][begin : begin + size].astype("<u4").tobytes()
            for column, x in zip(columns, (docs[i], starts[i] + begin, size, part, zlib.crc32(part), totals[i], (shard << 32) + s, offset), strict=True):
                column.append(x)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return dealt.groupBy("shard").applyInArrow(tidied(run), SCHEMA)


def tokenizer_path() -> str:
    """The default tokenizer file; a parameter of pack()."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Packs every document; the ids themselves are left out of the result."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()).drop("ids")
