"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_remainder, free, lowest_hashes, small_batches, table, tidied, written
from .grams import CharGrams

ORDERS, BITS, ALPHA = (1, 2, 3), 16, 0.5
#: Documents of each language that the model learns from, about (see lowest_hashes).
PER_LANGUAGE = 4000
#: Languages whose matrix (64 MB of log probabilities) is broadcast at once: more are learnt and compared in blocks. N-grams scored at once.
LANGUAGES, AT_ONCE = 256, 1 << 18
#: Ids of a sample that may be broadcast.
FEW_IDS = 100_000
#: Tasks that count the sample.
COUNTERS = 16


class Model:
    """languages, in order, and log P(n-gram bucket | language), one column per language."""

    def __init__(self, languages: list[str], log_p: np.ndarray, orders=ORDERS, bits=BITS):
        self.languages, self.log_p, self.orders, self.bits = languages, log_p, orders, bits


class Blocks:
    """More languages than one matrix may have: each block of them, by the hash of its name, is learnt when it is needed."""

    def __init__(self, usable: DataFrame, n: int, learn):
        self.n, self.usable, self.learn = n, usable, learn

    def models(self):
        for k in range(self.n):
            yield self.learn(self.usable.filter(F.pmod(F.xxhash64("lang"), F.lit(self.n)) == k))


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, orders=ORDERS, bits=BITS, alpha: float = ALPHA) -> Model | Blocks:
    """Learns from (doc_id, text, lang); rows whose id, text or lang is null, or whose text or lang is empty, teach nothing.

    About per_language documents of each value of lang are used, those whose doc_id hashes lowest. Priors are uniform.
    With no usable row the model knows no language. Of more than LANGUAGES values none is left out: see Blocks.
    """
    small_batches(labelled.sparkSession)
    usable = labelled.filter(F.col("doc_id").isNotNull() & (F.length("lang") > 0) & (F.length("text") > 0)).select("doc_id", "lang", "text")
    n = usable.agg(F.count_distinct("lang")).first()[0]
    learn = lambda rows: _learnt(rows, n, per_language, orders, bits, alpha)
    return learn(usable) if n <= LANGUAGES else Blocks(usable, -(-n * 5 // (4 * LANGUAGES)), learn)


def _learnt(usable: DataFrame, n_languages: int, per_language: int, orders, bits: int, alpha: float) -> Model:
    ids = lowest_hashes(usable.select("doc_id", "lang"), "doc_id", "lang", per_language).distinct()
    few = min(n_languages, LANGUAGES) * per_language <= FEW_IDS
    sample = usable.join(F.broadcast(ids) if few else ids, ["doc_id", "lang"]).repartition(COUNTERS, "doc_id")
    schema = pa.schema([("lang", pa.string()), ("index", pa.binary()), ("count", pa.binary())])

    def count(batches):
        grams, totals = CharGrams(orders, bits), {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                index, n = grams.counts(text)
                totals.setdefault(lang, np.zeros(1 << bits, np.int64))[index] += n
        for lang, total in totals.items():
            index = np.flatnonzero(total)
            yield pa.RecordBatch.from_pylist([{"lang": lang, "index": index.astype("<i4").tobytes(), "count": total[index].astype("<i8").tobytes()}], schema=schema)

    totals: dict[str, np.ndarray] = {}
    for row in sample.select("lang", "text").mapInArrow(tidied(count), "lang string, index binary, count binary").toLocalIterator():
        totals.setdefault(row["lang"], np.zeros(1 << bits, np.int64))[np.frombuffer(row["index"], "<i4")] += np.frombuffer(row["count"], "<i8")
    languages = sorted(totals)
    counts = np.array([totals[x] for x in languages], np.float64).reshape(len(languages), 1 << bits) + alpha
    return Model(languages, np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32).copy(), orders, bits)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """documents with lang_pred and score (the posterior of lang_pred), in place of columns of those names.

    A text that is null or has no letter, or a model without languages, gives 'und' and score 0.
    Ties go to the language that sorts first. Long texts are read whole, in windows; repeated rows get the same
    result each; null ids and columns of other names pass through; an empty table gives no rows.
    """
    if isinstance(model, Blocks):
        return _predicted_by_blocks(documents, model)
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.languages, np.ascontiguousarray(model.log_p.T), model.orders, model.bits))
    kept = [c for c in documents.columns if c not in ("lang_pred", "score")]
    (letter,) = free(documents, "__letter")
    marked = documents.select(*kept, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(letter))
    schema = documents.select(*kept).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def score(batches):
        languages, log_p, orders, bits = shared.value
        grams = CharGrams(orders, bits)
        names = np.array([*languages, "und"], object)
        for batch in batches:
            known = np.array(batch[letter].to_pylist(), bool) & bool(languages)
            z = _log_likelihoods(grams, log_p, batch, known)
            best = np.where(known, z.argmax(1), len(languages)) if languages else np.zeros(len(known), np.int64)
            rest = z - z.max(1, keepdims=True) if languages else z
            posterior = np.where(known, 1.0 / np.maximum(1.0, np.exp(rest).sum(1)), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(names[best].tolist(), pa.string()), pa.array(posterior, pa.float64())], names=[*kept, "lang_pred", "score"])

    return marked.mapInArrow(tidied(score), schema)


def _log_likelihoods(grams: CharGrams, log_p: np.ndarray, batch: pa.RecordBatch, known: np.ndarray) -> np.ndarray:
    z = np.zeros((batch.num_rows, len(log_p)))
    for owner, starts, ids in _sparse(grams, batch["text"], np.flatnonzero(known)):
        for i, row in enumerate(log_p):  # the n-grams of many texts against one row of the matrix
            np.add.at(z[:, i], owner, np.add.reduceat(row[ids], starts, dtype=np.float64))
    return z


def _predicted_by_blocks(documents: DataFrame, model: Blocks) -> DataFrame:
    """predict() with one matrix after another: a table between them has the best language so far, its log likelihood,
    and the log of the sum of all likelihoods."""
    spark = documents.sparkSession
    small_batches(spark)
    kept = [c for c in documents.columns if c not in ("lang_pred", "score")]
    letter, name, best, total = free(documents, "__letter", "__name", "__best", "__total")
    so_far = documents.select(*kept, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(letter), F.lit(None).cast("string").alias(name), F.lit(float("-inf")).alias(best), F.lit(float("-inf")).alias(total))
    with Scratch() as scratch:
        for part in model.models():
            if not part.languages:
                continue
            shared = spark.sparkContext.broadcast((np.array(part.languages, object), np.ascontiguousarray(part.log_p.T), part.orders, part.bits))
            before = list(scratch.tables)
            so_far = scratch.write(so_far.mapInArrow(tidied(_block_scorer(shared, letter, name, best, total)), so_far.schema), "languages")
            scratch.drop(*before)
            shared.unpersist()
        found = F.col(name).isNotNull()
        return written(so_far.select(*kept, F.when(found, F.col(name)).otherwise("und").alias("lang_pred"), F.when(found, F.exp(F.col(best) - F.col(total))).otherwise(0.0).alias("score")), "languages")


def _block_scorer(shared, letter: str, name: str, best: str, total: str):
    def score(batches):
        languages, log_p, orders, bits = shared.value
        grams = CharGrams(orders, bits)
        for batch in batches:
            known = np.array(batch[letter].to_pylist(), bool)
            z = _log_likelihoods(grams, log_p, batch, known)
            at, top = z.argmax(1), z.max(1)
            names, tops, totals = np.array(batch[name].to_pylist(), object), batch[best].to_numpy(), batch[total].to_numpy()
            first = np.array([a is None or n < a for a, n in zip(names, languages[at], strict=True)])
            wins = known & ((top > tops) | (top == tops) & first)
            names[wins] = languages[at][wins]
            with np.errstate(invalid="ignore"):
                sums = np.where(known, np.logaddexp(totals, top + np.log(np.exp(z - top[:, None]).sum(1))), totals)
            columns = {name: pa.array(names.tolist(), pa.string()), best: pa.array(np.where(wins, top, tops)), total: pa.array(sums)}
            yield pa.RecordBatch.from_arrays([columns.get(c, batch[c]) for c in batch.schema.names], names=batch.schema.names)

    return score


def _sparse(grams: CharGrams, texts, rows: np.ndarray):
    """The n-grams of these rows end to end, AT_ONCE or a little more at a time: the row of each run, its start, and the buckets."""
    owner, held, size = [], [], 0
    for i in rows:
        for ids in grams.ids(texts[int(i)].as_py()):
            if len(ids):
                owner.append(i)
                held.append(ids)
                size += len(ids)
        if size >= AT_ONCE:
            yield np.array(owner), np.cumsum([0, *map(len, held[:-1])]), np.concatenate(held)
            owner, held, size = [], [], 0
    if held:
        yield np.array(owner), np.cumsum([0, *map(len, held[:-1])]), np.concatenate(held)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicts every document's language with a model of the documents outside the held-out fold."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_remainder("doc_id", 4) == 2
    model = train(documents.filter(~held_out))
    return predict(documents.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")
