"""Toxicity: a linear classifier over character n-grams that naive Bayes log-count ratios scale."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, lowest_hashes, small_batches, table, tidied
from .grams import CharGrams
from .linear import Rows, fit, sigmoid

ORDERS, BITS, ALPHA, L2, THRESHOLD = (3, 4, 5), 18, 1.0, 1e-4, 0.7
#: An n-gram bucket of fewer sampled documents has no weight.
LEAST = 3
#: Labelled documents of each class that the model learns from, about (see lowest_hashes).
PER_CLASS = 4000
#: N-gram buckets of the documents that it learns from at most (192 MB in the task that learns): documents of the
#: sample are taken by a hash of their id until that many are there.
LEARNT = 48 << 20
COUNTERS = 16


class Model:
    def __init__(self, weights: np.ndarray, bias: float, orders=ORDERS, bits=BITS):
        self.weights, self.bias, self.orders, self.bits = weights, bias, orders, bits


def train(labelled: DataFrame, per_class: int = PER_CLASS, orders=ORDERS, bits=BITS, l2: float = L2) -> Model:
    """Learns from (doc_id, text, toxic); labels other than 0 and 1, null ids and null texts teach nothing.

    A document labelled more than once takes its largest label. About per_class documents of each
    class are used, those whose doc_id hashes lowest. Without both classes every score is the share
    of toxic rows (0 without rows).
    """
    spark = labelled.sparkSession
    small_batches(spark)
    usable = labelled.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    classes = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = lowest_hashes(classes, "doc_id", "toxic", per_class)
    sample = usable.select("doc_id", "text").join(F.broadcast(ids), "doc_id").repartition(COUNTERS, "doc_id")

    def features(batches):
        grams = CharGrams(orders, bits)
        for batch in batches:
            found = [grams.present(t).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), batch["toxic"].cast(pa.int32()), pa.array(found, pa.binary())], names=["doc_id", "toxic", "found"])

    def learn(batches):
        index, y, ids, size = [], [], [], 0
        for batch in batches:
            for found, toxic, doc in zip(batch["found"], batch["toxic"].to_pylist(), batch["doc_id"].to_pylist(), strict=True):
                if size < LEARNT:
                    index.append(np.frombuffer(found.as_py(), np.int32))
                    size += len(index[-1])
                    y.append(toxic)
                    ids.append(doc)
        order = [i for i in np.argsort(np.array(ids, np.int64), kind="stable") if len(index[i])]
        rows, target = Rows([index[i] for i in order]), np.array([y[i] for i in order], np.float64)
        scale, toxic = np.zeros(1 << bits), target == 1
        if toxic.any() and not toxic.all():
            there = [ALPHA + rows.gathered(m.astype(np.float64), 1 << bits) for m in (toxic, ~toxic)]
            scale = np.log(there[0] / there[0].sum()) - np.log(there[1] / there[1].sum())
            scale[rows.gathered(np.ones(rows.n), 1 << bits) < LEAST] = 0
            weights, bias = fit(rows, target, np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum()), scale, l2)
        else:
            share = min(1 - 1e-6, max(1e-6, target.mean())) if rows.n else 1e-6
            weights, bias = np.zeros(1 << bits), float(np.log(share / (1 - share)))
        yield pa.RecordBatch.from_pylist([{"weights": weights.astype("<f4").tobytes(), "bias": bias}])

    # the sample is bounded, so one task may learn from it: a lost executor costs one repeated task
    one = sample.mapInArrow(tidied(features), "doc_id long, toxic int, found binary").repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(31)), "doc_id", "found")
    row = one.mapInArrow(tidied(learn), "weights binary, bias double").first()
    if row is None:
        return Model(np.zeros(1 << bits, np.float32), float(np.log(1e-6)), orders, bits)
    return Model(np.frombuffer(row["weights"], "<f4"), row["bias"], orders, bits)


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """documents with score (0 to 1) and predicted (1 from threshold on), in place of columns of those names.

    A null text counts as empty; an empty text has only the intercept. Long texts are read whole; repeated rows get
    the same score each; null ids and columns of other names pass through; an empty table gives no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.bias, model.orders, model.bits))
    kept = [c for c in documents.columns if c not in ("score", "predicted")]
    source = documents.select(*kept)
    schema = source.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema

    def run(batches):
        weights, bias, orders, bits = shared.value
        grams = CharGrams(orders, bits)
        for batch in batches:
            z = np.array([float(weights[grams.present(t or "")].sum(dtype=np.float64)) for t in batch["text"].to_pylist()], np.float64) + bias
            p = sigmoid(z)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], names=[*kept, "score", "predicted"])

    return source.mapInArrow(tidied(run), schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores every document with a model of the labelled documents outside the held-out fold."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(crc_remainder("doc_id", 3) != 1)
    # which documents are learnt from is settled on ids alone: the texts of a bounded sample are then looked up
    model = train_from_labels(documents, labels)
    held_out = (crc_remainder("doc_id", 3) == 1).alias("held_out")
    return score(documents.select("doc_id", "text", held_out), model).drop("text")


def train_from_labels(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """As train(), with the labels in a table of their own; ids of labels without a document teach nothing."""
    clean = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = lowest_hashes(clean, "doc_id", "toxic", per_class)
    return train(documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), per_class)
