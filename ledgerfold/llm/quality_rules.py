"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio. DataFrame functions only.

Unigrams and bigrams of words are hashed into buckets. A multinomial over the buckets is fitted to a
trusted target and one to the raw corpus; a document's score is the log-likelihood ratio of its
n-grams, divided by their number, and it is kept from a threshold on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, free, table

BUCKETS, ALPHA, THRESHOLD = 1 << 16, 1.0, -0.1
#: Trusted ids that may be broadcast (some 30 bytes each); more are joined by a shuffle of the texts.
FEW_TRUSTED = 2_000_000
#: Fixed values of the contract: fewer words fail, and so does a larger percentage of repeated words.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Bits of a sorted number that hold a window's place.
PLACE_BITS = 24


def words(text: str = "text") -> Column:
    """The words of a text; none for a null."""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), "")


def hashes(ws: Column) -> Column:
    """64-bit hashes of words: windows and buckets are made of them, so that a word is hashed once."""
    return F.transform(ws, lambda w: F.xxhash64(w))


def with_repeated_words(hashed: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with __hashes: the words that lie in a 3-word window which occurs
    twice or more, the first occurrence included.

    Windows are sorted as numbers, the upper bits of their hash above their place. Those whose upper
    bits equal a neighbour's, few in most texts, are sorted again by their full hash and place; the
    places of those with an equal neighbour are then merged, each covering three words. A text with
    more windows than PLACE_BITS can number sorts all of them in full. Each step is a column of its
    own: numbers are sorted faster outside a lambda.
    """
    h, places = F.col("__hashes"), (1 << PLACE_BITS) - 1
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
    packed = F.sort_array(F.transform("__windows", lambda x, i: x.bitwiseAND(F.lit(~places)).bitwiseOR(i.cast("long"))))

    def upper(x: Column) -> Column:
        return F.shiftright(x, PLACE_BITS)

    p = F.col("__packed")
    alike = F.filter(p, lambda x, i: (upper(x) == upper(F.get(p, i - 1))) | (upper(x) == upper(F.get(p, i + 1))))
    near = F.when(F.size(p) > places, F.sequence(F.lit(0), F.size(p) - 1)).otherwise(F.transform(alike, lambda x: x.bitwiseAND(F.lit(places)).cast("int")))
    full = F.sort_array(F.transform("__near", lambda i: F.struct(F.get(F.col("__windows"), i).alias("h"), i.alias("at"))))

    def repeated(s: Column) -> Column:
        return F.filter(F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["at"])), lambda x: x.isNotNull())

    def spread(at: Column) -> Column:
        return F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])

    steps = hashed.withColumn("__windows", windows).withColumn("__packed", packed).withColumn("__near", near)
    return steps.withColumn("n_repeat_words", spread(F.sort_array(_let(full, repeated))).cast("long")).drop("__windows", "__packed", "__near")


def _let(value: Column, use) -> Column:
    """use(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with the counts of the contract and the words' hashes (array __hashes)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = documents.withColumns({"__words": words(text), "__lines": lines})
    counted = split.withColumns(
        {
            "__hashes": hashes(F.col("__words")),
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        }
    )
    return with_repeated_words(counted.drop("__words", "__lines"))


def unigram(x: Column, n: int) -> Column:
    """Bucket number of a hashed word."""
    return F.pmod(x, F.lit(n)).cast("int")


def bigram(x: Column, y: Column, n: int) -> Column:
    """Bucket number of two hashed words; null where there is no second."""
    return F.when(y.isNotNull(), F.pmod(F.xxhash64(x, y), F.lit(n)).cast("int"))


def buckets(h: Column, n: int = BUCKETS) -> Column:
    """Bucket numbers of the unigrams and bigrams of hashed words, and a null for the bigram that the last word lacks."""
    return F.concat(F.transform(h, lambda x: unigram(x, n)), F.transform(h, lambda x, i: bigram(x, F.get(h, i + 1), n)))


def log_ratios(documents: DataFrame, trusted_ids: DataFrame, n: int = BUCKETS, alpha: float = ALPHA) -> DataFrame:
    """One row with an array of n log ratios: smoothed P(bucket | trusted) over P(bucket | all documents).

    Every document of trusted_ids (doc_id) counts, however many there are. Without trusted documents all ratios are 0.
    """
    trusted = trusted_ids.filter("doc_id is not null").select("doc_id").distinct().withColumn("t", F.lit(1))
    few = trusted.limit(FEW_TRUSTED + 1).count() <= FEW_TRUSTED
    flagged = documents.select("doc_id", "text").join(F.broadcast(trusted) if few else trusted.hint("merge"), "doc_id", "left").select("t", hashes(words()).alias("h"))
    grams = flagged.select(F.explode(buckets(F.col("h"), n)).alias("bucket"), "t").filter("bucket is not null")
    found = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("t").alias("trusted"))
    # buckets that don't occur are filled in from a range of a fixed size
    spark = documents.sparkSession
    dense = spark.range(n).select(F.col("id").cast("int").alias("bucket")).join(found, "bucket", "left").na.fill(0, ["raw", "trusted"])
    sums = dense.agg(F.sum("raw").alias("all_raw"), F.sum("trusted").alias("all_trusted"), F.sort_array(F.collect_list(F.struct("bucket", "raw", "trusted"))).alias("cells"))
    ratio = F.transform("cells", lambda c: F.when(F.col("all_trusted") == 0, F.lit(0.0)).otherwise(F.log((c["trusted"] + alpha) / (F.col("all_trusted") + alpha * n)) - F.log((c["raw"] + alpha) / (F.col("all_raw") + alpha * n))))
    return sums.select(ratio.alias("ratios"))


def judge(documents: DataFrame, ratios: DataFrame, n: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """documents with the counts, base_failed, llr (0 for a text without words) and kept, in place of columns of those names.

    Every text is read whole. A null, empty or blank one has no words and fails; repeated rows are judged alike;
    a score equal to the threshold is kept; null ids and other columns pass through; an empty table gives no rows.
    """
    h = F.col("__hashes")
    inner = [c for c in documents.columns if c.startswith("__")]  # out of the way of the columns made in between
    aside = dict(zip(inner, free(documents, *(f"__aside{i}" for i in range(len(inner)))), strict=True))
    documents = documents.withColumnsRenamed(aside)

    def llr(r: Column) -> Column:
        each = F.transform(h, lambda x, i: F.get(r, unigram(x, n)) + F.coalesce(F.get(r, bigram(x, F.get(h, i + 1), n)), F.lit(0.0)))
        return F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / (2 * F.size(h) - 1)

    # the subquery has one row of a fixed size; it is named once, so the optimizer puts it in place of the column
    scored = counts(documents).withColumn("__ratios", ratios.scalar()).withColumn("llr", F.when(F.size(h) == 0, F.lit(0.0)).otherwise(_let(F.col("__ratios"), llr))).drop("__ratios")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold)).drop("__hashes").withColumnsRenamed({v: k for k, v in aside.items()})


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Judges every document; the trusted target is all documents labelled good."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    return judge(documents, log_ratios(documents, trusted)).drop("text")
