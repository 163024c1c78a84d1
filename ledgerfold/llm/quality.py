"""Quality: heuristic labellers, a weak-label model of their votes, and a hashed linear scorer.

1. Labellers vote on each text: good, bad or no vote.
2. Expectation-maximisation over the counts of all vote patterns of the corpus estimates each
   labeller's accuracy on good and on bad texts, and the share of good texts.
3. The posterior of each pattern labels a bounded sample of documents, from which a linear scorer learns
   over hashed features: the distinct words of the whole text, cuts of the labellers' measures and shapes
   of words; it then scores every document.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowest_hashes, small_batches, table, tidied
from .linear import Rows, fit, sigmoid

BITS, L2, THRESHOLD = 18, 1e-5, 0.5
#: Documents that the linear scorer learns from, about.
SAMPLE = 12000
#: Features of those documents at most (256 MB in the task that learns): documents are taken by a hash of their id
#: until that many are there.
LEARNT = 32 << 20
COUNTERS = 16

#: Name, then (good at or below, bad at or above); between them a labeller doesn't vote. The
#: labellers overlap: each kind of fault shows in two or three of them.
LABELLERS = {
    "symbols": (0.02, 0.10),  # symbol characters per word
    "marked": (0.01, 0.06),  # words that end with a symbol, or are only symbols
    "noise": (0.06, 0.12),  # share of characters that are neither letters, digits nor white space
    "capitals": (0.15, 0.30),  # share of cased letters that are capitals
    "shouts": (0.02, 0.08),  # words that end with an exclamation mark
    "loud": (0.05, 0.20),  # words of two letters or more, all capitals
    "stutters": (0.01, 0.06),  # words equal to the word before
    "monotony": (0.20, 0.35),  # share of the commonest word, from ten words on
    "poverty": (0.40, 0.60),  # share of words, in windows of 40, that occurred in their window before
    "repeats": (0.20, 0.50),  # share of lines equal to an earlier line
}


def measures(text: str | None) -> dict[str, float]:
    """What the labellers look at; all 0 for a text without words."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return dict.fromkeys(LABELLERS, 0.0) | {"n": 0}
    kind = _kinds()[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
    count = np.bincount(kind, minlength=6)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths)
    last = kind[ends - 1]
    lower, upper = (np.add.reduceat(kind == k, ends - lengths, dtype=np.int64) for k in (_LOWER, _UPPER))
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    windows = [words[i : i + 40] for i in range(0, n, 40)]
    return {
        "symbols": count[_MARK] / n,
        "marked": np.count_nonzero(last == _MARK) / n,
        "noise": (count[_MARK] + count[_SHOUT] + count[_POINT]) / len(kind),
        "capitals": count[_UPPER] / max(1, count[_UPPER] + count[_LOWER]),
        "shouts": np.count_nonzero(last == _SHOUT) / n,
        "loud": np.count_nonzero((upper > 0) & (lower == 0) & (lengths > 1)) / n,
        "stutters": sum(map(str.__eq__, words, words[1:])) / n,
        "monotony": max(Counter(words).values()) / n if n >= 10 else 0.0,
        "poverty": sum(len(x) - len(set(x)) for x in windows) / n,
        "repeats": 1 - len(set(lines)) / len(lines),
        "n": n,
        "words": set(text.lower().split()),
        "shapes": np.bincount(kind[ends - lengths] * np.int64(6) + last, minlength=36),  # kinds of the first and the last character
    }


_OTHER, _LOWER, _UPPER, _MARK, _SHOUT, _POINT = range(6)


@cache
def _kinds() -> np.ndarray:
    """The kind of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        out[c] = _LOWER if kind == "Ll" else _UPPER if kind == "Lu" else _POINT if kind[0] in "PS" else _OTHER
    out[[ord(c) for c in "#*$%&|<>^~=\\{}@_"]] = _MARK
    out[ord("!")] = _SHOUT
    return out


def votes(m: dict[str, float]) -> str:
    """One character per labeller: g, b or -. A text without words gets no votes."""
    if not m["n"]:
        return "-" * len(LABELLERS)
    return "".join("g" if m[k] <= good else "b" if m[k] >= bad else "-" for k, (good, bad) in LABELLERS.items())


def features(m: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: the text's distinct words, together of length 1, cuts of the measures, and shares of word shapes."""
    names, cut_at, shape_at = _buckets()
    mask = (1 << BITS) - 1
    cuts = cut_at[np.array([m[k] for k in names])[:, None] >= CUTS]
    if not m["n"]:
        words, shapes = np.zeros(0, np.int32), np.zeros(0)
    else:
        words = np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) & mask for w in m["words"]), np.int32, len(m["words"])))
        shapes = m["shapes"] / m["n"]
    there = np.flatnonzero(shapes)
    index = np.concatenate([cuts, shape_at[there], words])
    value = np.concatenate([np.ones(len(cuts)), shapes[there], np.full(len(words), 1 / np.sqrt(max(1, len(words))))])
    if not len(index):  # no row may be empty
        index, value = np.zeros(1), np.zeros(1)
    return index.astype(np.int32), value.astype(np.float32)


CUTS = np.array([0.01, 0.02, 0.05, 0.1, 0.2, 0.4])


@cache
def _buckets() -> tuple[list[str], np.ndarray, np.ndarray]:
    bucket = lambda name: zlib.crc32(name.encode()) & ((1 << BITS) - 1)
    return list(LABELLERS), np.array([[bucket(f"{k}>{c}") for c in CUTS] for k in LABELLERS]), np.array([bucket(f"shape {i}") for i in range(36)])


class WeakLabels:
    """Naive Bayes over votes: P(good), and P(vote | good) and P(vote | bad) of each labeller, for g, b and -."""

    def __init__(self, prior: float, good: np.ndarray, bad: np.ndarray):
        self.prior, self.good, self.bad = prior, good, bad

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """P(good | votes) of each pattern."""
        v = _one_hot(patterns)
        odds = np.log(self.prior / (1 - self.prior)) + np.tensordot(v, np.log(self.good / self.bad), 2)
        return sigmoid(odds)


def _one_hot(patterns: list[str]) -> np.ndarray:
    return np.array([[[c == k for k in "gb-"] for c in p] for p in patterns], np.float64).reshape(len(patterns), len(LABELLERS), 3)


def estimate(counts: dict[str, int], steps: int = 200) -> WeakLabels:
    """Expectation-maximisation over pattern counts.

    It starts from labellers that recognise nearly all good texts and a third of the bad ones (each
    knows one fault), and so keeps the meaning of good and bad; no estimate lets a bad vote speak for
    a good text. A few pseudo-counts keep every probability above 0.
    """
    k = len(LABELLERS)
    good, bad = np.tile([0.95, 0.01, 0.04], (k, 1)), np.tile([0.62, 0.33, 0.05], (k, 1))
    model = WeakLabels(0.8, good, bad)
    patterns = sorted(counts)
    if not patterns:
        return model
    n, v = np.array([counts[p] for p in patterns], np.float64), _one_hot(patterns)
    for _ in range(steps):
        q = model.posterior(patterns)
        p_good, p_bad = (np.tensordot(x, v, (0, 0)) + 4 * start for x, start in ((n * q, good), (n * (1 - q), bad)))
        p_good, p_bad = p_good / p_good.sum(1, keepdims=True), p_bad / p_bad.sum(1, keepdims=True)
        p_good[:, 1] = np.minimum(p_good[:, 1], p_bad[:, 1])
        p_good /= p_good.sum(1, keepdims=True)
        new = WeakLabels(float((n @ q + 8) / (n.sum() + 10)), p_good, p_bad)
        moved = max(np.abs(new.good - model.good).max(), np.abs(new.bad - model.bad).max(), abs(new.prior - model.prior))
        model = new
        if moved < 1e-7:
            break
    return model


class Model:
    def __init__(self, weak: WeakLabels, weights: np.ndarray, bias: float):
        self.weak, self.weights, self.bias = weak, weights, bias


def train(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from (doc_id, text) without labels. Votes of all documents are counted; the scorer learns
    from about `sample` of them, those whose doc_id hashes lowest. An empty table leaves the prior."""
    spark = documents.sparkSession
    small_batches(spark)

    def count(batches):
        found: Counter[str] = Counter()
        for batch in batches:
            found.update(votes(measures(t)) for t in batch["text"].to_pylist())
        yield pa.RecordBatch.from_pylist([{"pattern": p, "n": n} for p, n in found.items()], schema=pa.schema([("pattern", pa.string()), ("n", pa.int64())]))

    # patterns: at most 3 to the power of the labellers
    counts = documents.select("text").mapInArrow(tidied(count), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    weak = estimate({r["pattern"]: r["n"] for r in counts})

    ids = lowest_hashes(documents.select("doc_id", F.lit(1).alias("all")).filter(F.col("doc_id").isNotNull()).distinct(), "doc_id", "all", sample).select("doc_id")
    chosen = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").repartition(COUNTERS, "doc_id")

    def describe(batches):
        for batch in batches:
            found = [(m := measures(t), votes(m), *features(m)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array([x[1] for x in found], pa.string()), *(pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (2, 3))], names=["doc_id", "pattern", "index", "value"])

    def learn(batches):
        rows, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if size < LEARNT:
                    rows.append(row)
                    size += len(row["index"]) // 4
        rows.sort(key=lambda r: (r["doc_id"], r["pattern"]))
        sparse = Rows([np.frombuffer(r["index"], np.int32) for r in rows], [np.frombuffer(r["value"], np.float32) for r in rows])
        target = weak.posterior([r["pattern"] for r in rows])
        weights, bias = fit(sparse, target, np.ones(len(rows)), np.ones(1 << BITS), L2)
        yield pa.RecordBatch.from_pylist([{"weights": weights.astype("<f4").tobytes(), "bias": bias}])

    one = chosen.mapInArrow(tidied(describe), "doc_id long, pattern string, index binary, value binary").repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(31)), "doc_id", "pattern")
    row = one.mapInArrow(tidied(learn), "weights binary, bias double").first()
    if row is None:
        return Model(weak, np.zeros(1 << BITS, np.float32), float(np.log(weak.prior / (1 - weak.prior))))
    return Model(weak, np.frombuffer(row["weights"], "<f4"), row["bias"])


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """documents with votes, quality (0 to 1) and kept (quality at least threshold), in place of columns of those names.

    A text without words (null, empty or blank) is rejected with quality 0. Long texts are read whole; repeated rows
    get the same result each; null ids and columns of other names pass through; an empty table gives no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.bias))
    kept = [c for c in documents.columns if c not in ("votes", "quality", "kept")]
    source = documents.select(*kept)
    schema = source.withColumn("votes", F.lit("")).withColumn("quality", F.lit(0.0)).withColumn("kept", F.lit(True)).schema

    def run(batches):
        weights, bias = shared.value
        for batch in batches:
            names, z = [], []
            for text in batch["text"].to_pylist():
                m = measures(text)
                index, value = features(m)
                names.append(votes(m))
                z.append(float(weights[index].astype(np.float64) @ value) + bias if m["n"] else -np.inf)
            p = sigmoid(np.array(z, np.float64))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(names, pa.string()), pa.array(p, pa.float64()), pa.array(p >= threshold)], names=[*kept, "votes", "quality", "kept"])

    return source.mapInArrow(tidied(run), schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Scores every document; labels are never read."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(documents, train(documents)).drop("text")
