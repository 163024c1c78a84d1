"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

1. One pass hashes every text's word n-grams and counts, over all documents, in how many each occurs.
   The counts give the global order: n-grams of few documents first, by hash, then the commoner ones by
   class (power of two), which a table of a fixed size holds.
2. Texts with the same n-grams are one node. Of two linked nodes, the prefixes (the first part of each in
   the order) share an n-gram. Prefixes are dealt by ranges of n-grams, and those that one node alone has
   go. Then each n-gram's nodes are paired with the one that has fewest n-grams before it, so a large group
   of near copies gives one pair for each member, not all pairs; nodes that are still apart are then paired
   in full. Sizes, places and the parity bits of whole n-gram sets, all of them exact bounds, rule out most pairs.
3. The order is cut into fragments. Each fragment's n-grams are counted for a pair separately, and the
   partial overlaps are summed per pair: an exact Jaccard similarity.
4. Links make components.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_batches, input_bytes, power_of_two, small_batches, table, tidied, written
from .components import connected_components

#: n-grams of the contract and the least similarity, as a fraction.
WORDS, NUMERATOR, DENOMINATOR = 4, 85, 100
#: Fragments of the order; n-grams, and n-grams of prefixes, that a task sorts at once; bytes of input for a range of hashes.
FRAGMENTS, SORTED_AT_ONCE, POSTED_AT_ONCE, RANGE_BYTES = 8, 500_000, 250_000, 4 << 20
#: The least class in the table of the order: n-grams of more than 4 documents. The table has so many cells at most
#: (bits), a byte each: 32 MB; if more n-grams are that common, the least class rises. A Bloom filter has so many
#: bits at most: 16 MB. Results don't depend on these sizes.
LEAST_CLASS, CELL_BITS, BLOOM_BITS = 3, 25, 27
#: Nodes of an n-gram, still apart, from which on it is taken together with a second one (see _crossed): with fewer, their
#: pairs are no more than the rows that this takes.
MANY = 2048
#: n-grams of a text that is short: its prefix has few pairs of n-grams. Longer ones meet by each n-gram, as ever.
SHORT = 24
#: 64-bit words of the parity bits of an n-gram set.
PARITY = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, n: int) -> np.ndarray:
    """The distinct word n-grams as sorted 64-bit hashes: words lower-cased in A-Z, split at ASCII white space."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < n:
        h = np.concatenate([h, np.full(n - len(h), len(h), np.uint64)])
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def node_of(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


class Order:
    """The global order: class of each hash, and the key (class, hash) that sorts n-grams."""

    def __init__(self, range_bits: int, cell_bits: int, cells: np.ndarray):
        self.range_bits, self.cell_bits, self.cells = range_bits, cell_bits, cells

    def cell(self, short: np.ndarray) -> np.ndarray:
        return ((short * _ODD) >> np.uint64(64 - self.cell_bits)).astype(np.int64)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        kind = self.cells[self.cell(hashes >> np.uint64(32 - self.range_bits))].astype(np.uint64)
        return (kind << np.uint64(57)) | (hashes >> np.uint64(7))


def _planes(values: np.ndarray) -> bytes:
    """Numbers, byte plane by byte plane, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def _numbers(data: bytes, n: int, kind) -> np.ndarray:
    import zstandard

    wide = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=wide * n), np.uint8)
    return planes.reshape(wide, -1).T.copy().view(kind).ravel()


def _packed(values: np.ndarray) -> bytes:
    """Sorted numbers as differences."""
    return _planes(np.diff(values, prepend=values.dtype.type(0)))


def _unpacked(data: bytes, n: int, kind=np.uint32) -> np.ndarray:
    return np.cumsum(_numbers(data, n, kind), dtype=kind)


def parity(found: np.ndarray) -> list[int]:
    """For each of 64 * PARITY cells whether an odd number of n-grams falls into it. Two sets differ by as many n-grams at least as cells."""
    odd = np.bincount((found * _ODD >> np.uint64(64 - (64 * PARITY - 1).bit_length())).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(bool)).view("<i8").tolist()


def described(documents: DataFrame, n: int, range_bits: int) -> DataFrame:
    """One pass: kind 0, a row per document (doc_id, n_shingles, node, text_hash, parity; the node null without n-grams);
    kind 1, packed hashes (range, n_shingles of them, data, and times: how often each occurs)."""
    small_batches(documents.sparkSession)
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("text_hash", pa.int64()), ("parity", pa.list_(pa.int64())), ("range", pa.int32()), ("data", pa.binary()), ("times", pa.binary())])
    empty = dict.fromkeys(schema.names)

    def run(batches):
        held, size = [], 0

        def flush():
            everything, times = np.unique(np.concatenate(held), return_counts=True)
            times = times.astype(np.uint32)
            ranges = (everything >> np.uint64(64 - range_bits)).astype(np.int64) if range_bits else np.zeros(len(everything), np.int64)
            low = (everything >> np.uint64(32 - range_bits)).astype(np.uint32)
            cuts = np.flatnonzero(np.diff(ranges)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(low)], strict=True):
                yield empty | {"kind": 1, "n_shingles": int(end - begin), "range": int(ranges[begin]), "data": _packed(low[begin:end]), "times": _planes(times[begin:end])}

        def rows():
            nonlocal size
            for batch in batches:
                for doc, text, text_hash in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["text_hash"].to_pylist(), strict=True):
                    found = shingles(text, n)
                    if not len(found):
                        yield empty | {"kind": 0, "doc_id": doc, "n_shingles": 0}
                        continue
                    yield empty | {"kind": 0, "doc_id": doc, "n_shingles": len(found), "node": node_of(found), "text_hash": text_hash, "parity": parity(found)}
                    held.append(found)
                    size += len(found)
                    if size >= SORTED_AT_ONCE:
                        yield from flush()
                        held.clear()
                        size = 0
            if size:
                yield from flush()

        yield from as_batches(rows(), schema)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return texts.mapInArrow(tidied(run), "kind int, doc_id long, n_shingles long, node long, text_hash long, parity array<long>, range int, data binary, times binary")


def order_of(packed: DataFrame, range_bits: int, scratch: Scratch, cell_bits: int = CELL_BITS) -> tuple[Order, list[int]]:
    """The order from packed hashes (range, n_shingles, data, times), and the keys that cut it into FRAGMENTS of equal mass.

    Exact document counts of each range of hashes are made where it lies; a task has sent each hash once, with
    its count. What comes to the driver is the n-grams of LEAST_CLASS or more, at most a quarter of the cells.
    """

    def count(key, found):
        sizes = found["n_shingles"].to_pylist()
        low = np.concatenate([_unpacked(d, n) for d, n in zip(found["data"].to_pylist(), sizes, strict=True)])
        times = np.concatenate([_numbers(d, n, np.uint32) for d, n in zip(found["times"].to_pylist(), sizes, strict=True)])
        order = np.argsort(low, kind="stable")
        low, times = low[order], times[order].astype(np.int64)
        starts = np.flatnonzero(np.diff(low, prepend=low[0] ^ np.uint32(1)))
        low, times = low[starts], np.add.reduceat(times, starts)
        kinds = np.ceil(np.log2(times)).astype(np.int64)
        rows = [{"range": key[0].as_py(), "class": 0, "n": 0, "mass": int(times[kinds < LEAST_CLASS].sum()), "data": b""}]
        for k in np.unique(kinds[kinds >= LEAST_CLASS]):
            rows.append({"range": key[0].as_py(), "class": int(k), "n": int((kinds == k).sum()), "mass": int(times[kinds == k].sum()), "data": _packed(low[kinds == k])})
        return pa.Table.from_pylist(rows, schema=pa.schema([("range", pa.int32()), ("class", pa.int32()), ("n", pa.int64()), ("mass", pa.int64()), ("data", pa.binary())]))

    counted = scratch.write(packed.select("range", "n_shingles", "data", "times").groupBy("range").applyInArrow(tidied(count), "range int, class int, n long, mass long, data binary"), "ngram-counts")
    sizes = {r["class"]: (r["n"], r["mass"]) for r in counted.groupBy("class").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass")).collect()}
    least, total = 64, 0
    for k in sorted(sizes, reverse=True):
        if not k or total + sizes[k][0] > 1 << (cell_bits - 2):
            break
        least, total = k, total + sizes[k][0]
    bits = min(cell_bits, max(16, (8 * total).bit_length()))
    order = Order(range_bits, bits, np.zeros(1 << bits, np.uint8))
    for row in counted.filter(F.col("class") >= least).toLocalIterator():
        short = (np.uint64(row["range"]) << np.uint64(32)) | _unpacked(row["data"], row["n"]).astype(np.uint64)
        at = order.cell(short)
        order.cells[at] = np.maximum(order.cells[at], row["class"])
    scratch.drop(counted)
    kept = [(0, sum(m for k, (_, m) in sizes.items() if k < least))] + [(k, sizes[k][1]) for k in sorted(sizes) if k >= least]
    mass, cuts, done = sum(m for _, m in kept), [], 0
    for k, m in kept:
        while m and len(cuts) < FRAGMENTS - 1 and done + m >= (len(cuts) + 1) * mass / FRAGMENTS:
            cuts.append((k << 57) | min((1 << 57) - 1, int(((len(cuts) + 1) * mass / FRAGMENTS - done) / m * (1 << 57))))
        done += m
    return order, cuts


def _fresh(seen: OrderedDict, node: int, most: int = 100_000) -> bool:
    """Whether a task meets a node for the first time, as far as it remembers: repeats cost work, not results."""
    if node in seen:
        return False
    seen[node] = True
    if len(seen) > most:
        seen.popitem(last=False)
    return True


def shared_prefixes(documents: DataFrame, n: int, order, range_bits: int, numerator: int, denominator: int) -> DataFrame:
    """key, node, n, place: a row for each n-gram of a node's prefix, one longer than linked nodes need to share one
    n-gram, that another node's prefix has too.

    n is the node's size, place the number of its n-grams before this one. A task keeps the n-grams of which it
    has two nodes or more, and only names each of them once to the range that settles it; the others go there
    whole. So no range gathers a common n-gram's nodes, and what goes through it is only spread.
    A node that no other set can be similar enough to has no row.
    """
    kinds = ((np.uint64, "key"), (np.int64, "node"), (np.uint32, "n"), (np.uint32, "place"))
    wire = pa.schema([("range", pa.int32()), ("settled", pa.bool_()), ("rows", pa.int64()), *((name, pa.binary()) for _, name in kinds)])
    columns = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("place", pa.int64())])

    def post(batches):
        held, by_text, by_node = order.value, OrderedDict(), OrderedDict()
        parts, size = [], 0

        def row(where, settled, found):
            by = np.argsort(found[0], kind="stable")
            key, *rest = (x[by] for x in found)
            return {"range": int(where), "settled": settled, "rows": len(key), "key": _packed(key)} | {name: _planes(x) for (_, name), x in zip(kinds[1:], rest, strict=True)}

        def flush(turn):
            found = [np.concatenate(x) for x in zip(*parts, strict=True)]
            by = np.lexsort((found[1], found[0]))
            key, node = found[0][by], found[1][by]
            new = np.ones(len(by), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            found = [x[by][new] for x in found]
            starts = np.flatnonzero(np.diff(found[0], prepend=found[0][0] ^ np.uint64(1)))
            counts = np.diff(starts, append=len(found[0]))
            many = np.repeat(counts > 1, counts)
            own = [x[many] for x in found]
            for at in range(0, len(own[0]), 8192):
                yield row((turn * 31 + at // 8192) % (1 << range_bits), True, [x[at : at + 8192] for x in own])
            named = starts[counts > 1]
            sent = [np.concatenate([x[~many], x[named] if i < 2 else np.zeros(len(named), x.dtype)]) for i, x in enumerate(found)]
            ranges = ((sent[0] * _ODD) >> np.uint64(64 - range_bits)).astype(np.int64) if range_bits else np.zeros(len(sent[0]), np.int64)
            by = np.argsort(ranges, kind="stable")
            ranges, sent = ranges[by], [x[by] for x in sent]
            cuts = np.flatnonzero(np.diff(ranges)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(ranges)], strict=True):
                yield row(ranges[begin], False, [x[begin:end] for x in sent])

        def rows():
            nonlocal size
            turn = 0
            for batch in batches:
                for text, text_hash in zip(batch["text"].to_pylist(), batch["text_hash"].to_pylist(), strict=True):
                    if not _fresh(by_text, text_hash):
                        continue
                    found = shingles(text, n)
                    whole = len(found)
                    if whole * denominator < (whole + 1) * numerator or not _fresh(by_node, node := node_of(found)):
                        continue
                    length = min(whole, whole - -(-numerator * whole // denominator) + 2)
                    keys = held.keys(found)
                    if length < whole:
                        keys = np.partition(keys, length - 1)[:length]
                    keys.sort()
                    parts.append((keys, np.full(length, node, np.int64), np.full(length, whole, np.uint32), np.arange(length, dtype=np.uint32)))
                    size += length
                    if size >= POSTED_AT_ONCE:
                        yield from flush(turn := turn + 1)
                        parts.clear()
                        size = 0
            if size:
                yield from flush(turn + 1)

        yield from as_batches(rows(), wire)

    def settle(_, found):
        sizes = found["rows"].to_pylist()
        read = [np.concatenate([_unpacked(d, m, kind) if name == "key" else _numbers(d, m, kind) for d, m in zip(found[name].to_pylist(), sizes, strict=True)]) for kind, name in kinds]
        settled = np.repeat(np.array(found["settled"].to_pylist(), bool), sizes)
        out = [x[settled] for x in read]
        left = [x[~settled] for x in read]
        if len(left[0]):
            by = np.lexsort((left[1], left[0]))
            key, node, whole, place = (x[by] for x in left)
            starts = np.flatnonzero(np.diff(key, prepend=key[0] ^ np.uint64(1)))
            counts = np.diff(starts, append=len(key))
            ends = starts + counts - 1
            shared = (node[starts] != node[ends]) | (np.minimum.reduceat(whole, starts) == 0)  # two nodes, or named
            keep = np.repeat(shared, counts) & (whole > 0)
            keep[1:] &= ~((key[1:] == key[:-1]) & (node[1:] == node[:-1]) & (whole[:-1] > 0))
            out = [np.concatenate(x) for x in zip(out, (key[keep], node[keep], whole[keep], place[keep]), strict=True)]
        return pa.Table.from_arrays([pa.array(x.view(np.int64) if x.itemsize == 8 else x.astype(np.int64)) for x in out], schema=columns)

    sent = documents.select("text", F.xxhash64("text").alias("text_hash")).mapInArrow(tidied(post), "range int, settled boolean, rows long, key binary, node binary, n binary, place binary")
    return sent.groupBy("range").applyInArrow(tidied(settle), "key long, node long, n long, place long")


def _may_link(a: str, b: str, numerator: int, denominator: int):
    """Whether sizes and places allow a link of two different sets whose first common n-gram this is."""
    col = F.col
    fits = (col(f"{a}.n") * denominator >= col(f"{b}.n") * numerator) & (col(f"{b}.n") * denominator >= col(f"{a}.n") * numerator)
    rest = F.least(col(f"{a}.n") - col(f"{a}.place"), col(f"{b}.n") - col(f"{b}.place"), col(f"{a}.n") - (col(f"{a}.n") == col(f"{b}.n")).cast("long"))
    return fits & (rest * (numerator + denominator) >= (col(f"{a}.n") + col(f"{b}.n")) * numerator)


def _own(numerator: int, denominator: int):
    """Whether an n-gram's place is in the prefix proper: two linked nodes share one there, and two with one place more."""
    return F.col("place") < F.col("n") - F.ceil(F.col("n") * numerator / denominator) + 1


def _crossed(mixed: DataFrame, found: DataFrame, numerator: int, denominator: int, scratch: Scratch) -> DataFrame:
    """Pairs of nodes of different labels that may link and whose first common n-gram is one of `mixed`.

    Where very many short texts have an n-gram in common, and little else, all of their pairs would be too many.
    Linked nodes have two n-grams in common at least, and the second one too is among their longer prefixes: the
    short nodes of such an n-gram meet only by it together with another.
    """
    sizes = scratch.write(mixed.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > MANY).select("key"), "many")
    apart = (F.col("m.label") < F.col("h.label")) & _may_link("m", "h", numerator, denominator)
    if sizes.isEmpty():
        return _pairs(mixed.alias("m").join(mixed.alias("h"), (F.col("m.key") == F.col("h.key")) & apart), "m", "h")
    # a pair whose smaller node is short is found by two n-grams (its larger one is hardly longer), any other by one
    single = scratch.write(mixed.join(sizes, "key", "left_anti").union(mixed.filter(F.col("n") > SHORT).join(sizes, "key", "left_semi").select(*mixed.columns)), "one-ngram")
    pairs = _pairs(single.alias("m").join(single.alias("h"), (F.col("m.key") == F.col("h.key")) & apart), "m", "h")
    second = found.select(F.col("node").alias("__node"), F.col("key").alias("second"), F.col("place").alias("__place"))
    short = mixed.filter(F.col("n") * numerator <= SHORT * denominator).join(sizes, "key", "left_semi")
    both = scratch.write(short.join(second, (F.col("node") == F.col("__node")) & (F.col("__place") > F.col("place"))).drop("__node", "__place"), "two-ngrams")
    met = both.alias("m").join(both.alias("h"), (F.col("m.key") == F.col("h.key")) & (F.col("m.second") == F.col("h.second")) & apart)
    return pairs.union(_pairs(met, "m", "h")).distinct()


def _pairs(joined: DataFrame, a: str, b: str) -> DataFrame:
    low, high = F.struct(f"{a}.node", f"{a}.n"), F.struct(f"{b}.node", f"{b}.n")
    return joined.select(F.least(low, high).alias("x"), F.greatest(low, high).alias("y")).select(F.col("x.node").alias("a"), F.col("x.n").alias("n_a"), F.col("y.node").alias("b"), F.col("y.n").alias("n_b")).distinct()


def _similar_parity(pairs: DataFrame, nodes: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs whose sets may link by their parity bits, with the hash of a text of each (text_a, text_b).

    Linked sets differ by (1 - t) / (1 + t) of their sizes' sum at most, and in no more bits than n-grams.
    """
    both = pairs
    for x in "ab":
        both = both.join(nodes.select(F.col("node").alias(x), F.col("text_hash").alias(f"text_{x}"), F.col("parity").alias(f"parity_{x}")), x)
    bits = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITY)), F.lit(0))
    return both.filter(bits * (numerator + denominator) <= (F.col("n_a") + F.col("n_b")) * (denominator - numerator)).select("a", "n_a", "text_a", "b", "n_b", "text_b")


def _bloom(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of (text_hash) as packed bits, a fixed size at most. When full it lets everything through."""
    bits = min(BLOOM_BITS, max(16, (12 * hashes.count()).bit_length()))

    def run(batches):
        own = np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            for at in _bloom_places(batch["text_hash"].to_numpy(), bits):
                np.bitwise_or.at(own, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_pylist([{"bits": zlib.compress(own.tobytes(), 1)}])

    out = np.zeros(1 << bits - 3, np.uint8)
    for row in hashes.coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return out


def _bloom_holds(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The places of hashes that the filter may hold."""
    bits = (8 * len(filled)).bit_length() - 1
    return np.flatnonzero(np.logical_and.reduce([filled[at >> 3] >> (at & 7).astype(np.uint8) & 1 for at in _bloom_places(hashes, bits)]))


def _bloom_places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    x = hashes.astype(np.int64).view(np.uint64)
    return [((x * np.uint64(m)) >> np.uint64(64 - bits)).astype(np.int64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def verified(pairs: DataFrame, documents: DataFrame, n: int, order, cuts: list[int], numerator: int, denominator: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, n_a, text_a, b, n_b, text_b) that link: overlaps are counted in each fragment and summed."""
    spark = documents.sparkSession
    wanted = spark.sparkContext.broadcast(_bloom(pairs.select(F.col("text_a").alias("text_hash")).union(pairs.select("text_b")).distinct()))
    cut = np.array(cuts, np.uint64)
    schema = pa.schema([("node", pa.int64()), ("fragment", pa.int32()), ("keys", pa.binary())])

    def fragments(batches):
        held, filled, seen = order.value, wanted.value, OrderedDict()

        def rows():
            for batch in batches:
                if not batch.num_rows:
                    continue
                hashes = batch["text_hash"].to_numpy()
                for i in _bloom_holds(filled, hashes):
                    if not _fresh(seen, int(hashes[i])):
                        continue
                    found = shingles(batch["text"][i].as_py(), n)
                    if not len(found):
                        continue
                    keys, node = np.sort(held.keys(found)), node_of(found)
                    at = [0, *np.searchsorted(keys, cut), len(keys)]
                    for f, (begin, end) in enumerate(zip(at, at[1:], strict=False)):
                        if end > begin:
                            yield {"node": node, "fragment": f, "keys": keys[begin:end].tobytes()}

        yield from as_batches(rows(), schema, rows_at_once=4096)

    cutup = documents.select("text", F.xxhash64("text").alias("text_hash")).mapInArrow(tidied(fragments), "node long, fragment int, keys binary").dropDuplicates(["node", "fragment"])
    cutup = scratch.write(cutup, "fragments")
    each = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))).alias("fragment"))
    left = each.join(cutup.select(F.col("node").alias("a"), "fragment", F.col("keys").alias("keys_a")), ["a", "fragment"])
    met = left.join(cutup.select(F.col("node").alias("b"), "fragment", F.col("keys").alias("keys_b")), ["b", "fragment"]).select("a", "b", "keys_a", "keys_b")

    def overlap(batches):
        for batch in batches:
            common = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(batch["keys_a"].to_pylist(), batch["keys_b"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(common, pa.int64())], names=["a", "b", "common"])

    total = met.mapInArrow(tidied(overlap), "a long, b long, common long").groupBy("a", "b").agg(F.sum("common").alias("common"))
    linked = total.join(pairs, ["a", "b"]).filter(F.col("common") * denominator >= (F.col("n_a") + F.col("n_b") - F.col("common")) * numerator)
    links = scratch.write(linked.select("a", "b"), "links")
    scratch.drop(cutup)
    wanted.destroy()
    return links


def near_duplicates(documents: DataFrame, n: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, cell_bits: int = CELL_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) for every row of (doc_id, text).

    Two documents link from a Jaccard similarity of numerator/denominator of their word n-grams on; fewer
    words than n are one n-gram. A text without words (null, empty, blank) links with nothing. Repeated
    rows and equal texts link; a null doc_id is linked like others and has the least id of its group.
    An empty table gives no rows; texts may have any length. n-grams are compared as 64-bit hashes (57 bits
    and the class where overlaps are counted). The result is a written table; all others are deleted.
    """
    spark = documents.sparkSession
    range_bits = min(20, power_of_two(input_bytes(documents) / RANGE_BYTES).bit_length() - 1)
    with Scratch() as scratch:
        both = scratch.write(described(documents, n, range_bits), "shingles")
        each = scratch.write(both.filter("kind = 0").select("doc_id", "n_shingles", "node", "text_hash", "parity"), "described")
        order, cuts = order_of(both.filter("kind = 1"), range_bits, scratch, cell_bits)
        scratch.drop(both)
        shared = spark.sparkContext.broadcast(order)
        nodes = scratch.write(each.filter("node is not null").groupBy("node").agg(F.min_by("parity", "text_hash").alias("parity"), F.min("text_hash").alias("text_hash"), F.min("doc_id").alias("least")), "nodes")
        found = scratch.write(shared_prefixes(documents, n, shared, range_bits, numerator, denominator), "postings")

        own = found.filter(_own(numerator, denominator))
        hubs = own.groupBy("key").agg(F.min(F.struct("place", "n", "node")).alias("hub")).select("key", "hub.*")
        starred = own.alias("m").join(hubs.alias("h"), (F.col("m.key") == F.col("h.key")) & (F.col("m.node") != F.col("h.node")) & _may_link("m", "h", numerator, denominator))
        stars = scratch.write(_similar_parity(_pairs(starred, "m", "h"), nodes, numerator, denominator), "pairs")
        links = verified(stars, documents, n, shared, cuts, numerator, denominator, scratch)

        # pairs that the stars left apart
        labels = connected_components(links)
        scratch.tables.append(labels)
        labelled = scratch.write(own.join(labels, "node", "left").select("key", "node", "n", "place", F.coalesce("label", "node").alias("label")), "labelled")
        apart = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
        mixed = scratch.write(labelled.join(apart, "key", "left_semi"), "mixed")
        scratch.drop(labelled)
        crossed = _crossed(mixed, found, numerator, denominator, scratch)
        rest = scratch.write(_similar_parity(crossed, nodes, numerator, denominator).join(stars.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        scratch.drop(mixed, found)
        if not rest.isEmpty():
            more = verified(rest, documents, n, shared, cuts, numerator, denominator, scratch)
            scratch.drop(labels)
            labels = connected_components(links.union(more))
            scratch.tables.append(labels)
        shared.destroy()

        # the least id of a node, then of a component: copies meet before they are dealt by component
        lowest = scratch.write(labels.join(nodes.select("node", "least"), "node").groupBy("label").agg(F.min("least").alias("component_id")), "components")
        known = scratch.write(nodes.select("node", "least").join(labels, "node", "left").join(lowest, "label", "left").select("node", F.coalesce("component_id", "least").alias("component_id")), "known")
        grouped = each.select("doc_id", "n_shingles", "node").join(known, "node", "left")
        return written(grouped.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "near-duplicates")


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents: four-word shingles, similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
