"""A corpus pipeline of five stages over `documents`: quality, language, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. run() writes each result as Parquet and gives it to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm import language, mixing, near_duplicates, packing, quality
from ledgerfold.llm.common import Scratch, crc_remainder, table

#: Least posterior of the predicted language, and shingle length and similarity of the near-duplicate stage.
LEAST_LANGUAGE, WORDS, NUMERATOR, DENOMINATOR = 0.5, 5, 80, 100


def _hidden(docs: DataFrame, *needed: str) -> DataFrame:
    """docs with all columns but the needed ones renamed, so that no operator's column can replace one."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in needed else f"__column_{i}") for i, c in enumerate(docs.columns)))


def _shown(out: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    """The columns of docs again, from an operator's result over _hidden()."""
    return out.select(*(F.col(c if c in needed else f"__column_{i}").alias(c) for i, c in enumerate(docs.columns)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is 0.5 or more. The model learns from all documents, without labels.

    A text without words (null, empty, blank) goes. Repeated rows are judged alike, long texts whole, a null
    doc_id like any other. An empty table stays empty; columns of any name stay as they are.
    """
    needed = ("doc_id", "text")
    scored = quality.score(_hidden(docs, *needed), quality.train(docs.select(*needed)))
    return _shown(scored.filter("kept"), docs, *needed)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is predicted, with a posterior of 0.5 or more.

    The model learns from text and lang of this stage's own documents outside the held-out fold. A text without
    a letter goes, and so does every one if no row has a language to learn from. Repeated rows, long texts, null
    ids, empty tables and other columns are as in quality_stage.
    """
    needed = ("doc_id", "text")
    model = language.train(docs.select("doc_id", "text", "lang").filter(crc_remainder("doc_id", 4) != 2))
    found = language.predict(_hidden(docs, *needed), model)
    return _shown(found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)), docs, *needed)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the least doc_id; one without an id only where none has an id.

    Groups are linked by five-word shingles with a similarity of 0.8 or more. Rows are told apart by id and
    text: of those that repeat both, one stays, and an id with two texts is two documents. Texts without words
    are copies only of their own id. Long texts are compared whole; an empty table stays empty; columns of any
    name stay as they are.
    """
    needed = ("doc_id", "text")
    keyed = _hidden(docs, *needed).withColumn("__row", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))
    groups = near_duplicates.near_duplicates(keyed.select(F.col("__row").alias("doc_id"), "text"), WORDS, NUMERATOR, DENOMINATOR)
    members = groups.select(F.col("doc_id").alias("__row"), "component_id").join(keyed.select("__row", "doc_id").distinct(), "__row")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "__row")).alias("first"))
    return _shown(keyed.join(first.select("first.__row"), "__row", "left_semi").dropDuplicates(["__row"]), docs, *needed)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's weight asks for, within as many tokens as there are.

    Documents without a source are a source of their own; for null ids, texts without words and repeated rows
    see mixing.mix. An empty table stays empty; columns of any name stay as they are.
    """
    needed = ("doc_id", "text", "source")
    return _shown(mixing.mix(_hidden(docs, *needed)), docs, *needed)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids, packed into sequences of 4096 tokens.

    A null or empty text is its end mark alone, repeated rows are packed each on their own, a long text is cut.
    An empty table gives no rows. Only doc_id and text are read.
    """
    return packing.pack(docs.select("doc_id", "text"), packing.tokenizer_path(), remembered=packing.FEWER, split=4)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", duplicates_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: Learnt models, hashed permutations and a tokenizer: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table goes once the next one is written; the last is read by the result."""
    scratch, docs, before = Scratch(), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
