"""Mixing sources to target weights. DataFrame functions only.

Source token shares p become weights p**a / sum(p**a). The exponent a is the largest (the mix nearest
to the corpus) whose weights have the target entropy, unless that would repeat a source more often
than allowed; then it is the least that keeps the limit. Weights times the token budget give each
source a quota, which whole passes over the source and a part of one more pass fill. A pass is a
permutation of blocks of documents and of the documents within each block; the sources' passes are
read interleaved, each at the speed of its quota.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, free, table, written

#: Target entropy as a share of the largest possible one, most passes over a source, documents of a block, and
#: blocks of a source at most: those of a larger source are larger.
ENTROPY, PASSES, BLOCK, MOST_BLOCKS = 0.95, 4.0, 512, 1 << 16
SEED = 7
#: Exponents tried in one step of the search, and steps: 17**8 > 2**32 parts of the interval.
TRIED, STEPS = 16, 8


def tokens(text: str = "text") -> Column:
    """Words of a text (runs of other characters than white space); a text without words counts 1."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\x20\x09-\x0D]+", "x"), SPACE, "")
    return F.greatest(F.lit(1), F.length(bare)).cast("long")


def exponent(totals: DataFrame, budget_share: float = 1.0, entropy: float = ENTROPY, passes: float = PASSES) -> float:
    """The exponent, between 0 (equal weights) and 1 (the corpus as it is), found to about 1e-9.

    Both conditions are monotone in it: entropy falls and the largest number of passes rises towards 1
    and 0. Each step of the bisection tries TRIED exponents in one aggregate, so no source list comes to
    the driver. With one source, or none, it is 1.
    """
    stats = totals.agg(F.count("*").alias("k"), F.sum("n_tokens").alias("t")).first()
    if stats["k"] < 2:
        return 1.0
    p = F.col("n_tokens") / F.lit(float(stats["t"]))
    goal = entropy * math.log(stats["k"])

    def tried(points: list[float]) -> list[tuple[float, float]]:
        """Entropy and largest number of passes at each exponent."""
        sums = [x for i, a in enumerate(points) for x in (F.sum(F.pow(p, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(p, F.lit(a)) * a * F.log(p)).alias(f"e{i}"), F.max(F.pow(p, F.lit(a)) / p).alias(f"m{i}"))]
        row = totals.agg(*sums).first()
        return [(math.log(row[f"z{i}"]) - row[f"e{i}"] / row[f"z{i}"], budget_share * row[f"m{i}"] / row[f"z{i}"]) for i in range(len(points))]

    def search(holds_at_zero) -> tuple[float, float]:
        """The interval in which the condition, true at 0, turns false."""
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            points = [low + (high - low) * (i + 1) / (TRIED + 1) for i in range(TRIED)]
            holds = [holds_at_zero(x) for x in tried(points)]
            n = holds.index(False) if False in holds else TRIED
            low, high = ([low] + points)[n], (points + [high])[n]
        return low, high

    ends = tried([0.0, 1.0])
    by_entropy = 1.0 if ends[1][0] >= goal else 0.0 if ends[0][0] < goal else search(lambda x: x[0] >= goal)[0]
    by_passes = 0.0 if ends[0][1] <= passes else 1.0 if ends[1][1] > passes else search(lambda x: x[1] > passes)[1]
    return max(by_entropy, by_passes)


def weights(totals: DataFrame, a: float, budget: int) -> DataFrame:
    """source, n_docs, n_tokens, weight, quota (tokens), passes (whole ones) and rest (tokens of the last pass)."""
    powered = totals.withColumn("__p", F.pow(F.col("n_tokens").cast("double"), F.lit(a)))
    # one row, made by an aggregate, goes to every source
    total = powered.agg(F.sum("__p").alias("__z"))
    quota = F.floor(F.col("weight") * F.lit(float(budget)) + 0.5).cast("long")
    out = powered.withColumn("__z", total.scalar()).withColumn("weight", F.col("__p") / F.col("__z")).withColumn("quota", quota)
    return out.withColumn("passes", F.expr("quota div n_tokens")).withColumn("rest", F.col("quota") % F.col("n_tokens")).drop("__p", "__z")


def mix(documents: DataFrame, budget: int | None = None, entropy: float = ENTROPY, passes: float = PASSES, block: int = BLOCK, source: str = "source", text: str = "text", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """documents once for each time that they are in the mix, with mix_pass (from 0), mix_block, mix_place and mix_tokens.

    budget: tokens of the mix, by default as many as there are. mix_block is the place of a document's block in
    the permutation of its pass, which differs from pass to pass; mix_place is the share of its source's tokens
    in the mix that come before that block. The mix is read in the order of (mix_place, source, a hash of the
    id): whatever part is read first, each source has given about that part of its quota. The last pass of a
    source is a prefix of its permutation: blocks up to the rest of the quota and, of the block that this cuts,
    the documents whose first token, by a hash of the id, is within it. So a source exceeds its quota by less
    than the documents of one id. Equal ids of a source are permuted as one. Rows without a source or id are
    documents like any other; a null or empty text counts one token, a very long one all of its own. An empty
    table gives an empty mix. Columns of `documents` with those names are replaced.
    """
    own = ("mix_pass", "mix_block", "mix_place", "mix_tokens")
    documents = documents.select(*(c for c in documents.columns if c not in own))
    h, part = free(documents, "__h", "__part")
    with Scratch() as scratch:
        # ids, hashes and counts, but no texts: all that the plan of the mix needs
        light = scratch.write(documents.select(F.col(source).alias("__source"), F.xxhash64(F.col(key), F.lit(seed)).alias("__h"), tokens(text).alias("__n")).groupBy("__source", "__h").agg(F.sum("__n").alias("__n"), F.count("*").alias("__docs")), "mix-ids")
        totals = scratch.write(light.groupBy(F.col("__source").alias("source")).agg(F.sum("__docs").alias("n_docs"), F.sum("__n").alias("n_tokens")), "mix-sources")
        all_tokens = totals.agg(F.sum("n_tokens")).first()[0] or 0
        budget = all_tokens if budget is None else budget
        a = exponent(totals, budget / max(1, all_tokens), entropy, passes)
        n_blocks = F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(block))))
        plan = scratch.write(weights(totals, a, budget).select(F.col("source").alias("__s"), F.col("n_tokens").alias("__all"), F.col("quota").alias("__quota"), F.col("passes").alias("__passes"), F.col("rest").alias("__rest"), n_blocks.alias("__blocks")), "mix-plan")
        place = lambda h: F.pmod(F.xxhash64(h, F.lit(seed + 1)), F.col("__blocks"))

        # every block of every pass, in the order of the pass; a source has MOST_BLOCKS blocks at most
        spread = light.join(plan, F.col("__source").eqNullSafe(F.col("__s"))).withColumn("__block", place("__h"))
        blocks = spread.groupBy("__source", "__block", "__all", "__quota", "__passes", "__rest").agg(F.sum("__n").alias("__tokens"))
        each = blocks.withColumn("__pass", F.explode(F.sequence(F.lit(0), F.col("__passes").cast("int"))))
        permuted = Window.partitionBy("__source", "__pass").orderBy(F.xxhash64("__block", F.col("__pass"), F.lit(seed + 2)), "__block")
        each = each.withColumns({"__begin": F.sum("__tokens").over(permuted) - F.col("__tokens"), "__at": F.row_number().over(permuted) - 1})
        left = F.col("__rest") - F.col("__begin")  # tokens that the last pass still asks for
        each = each.withColumn("__cut", F.when((F.col("__pass") == F.col("__passes")) & (left < F.col("__tokens")), left))
        each = each.filter("__cut is null or __cut > 0").select(F.col("__source").alias("__bs"), F.col("__block").alias("__bb"), F.col("__pass").alias("__bp"), "__at", ((F.col("__pass") * F.col("__all") + F.col("__begin")) / F.col("__quota")).alias("__place"), "__cut")
        each = written(each, "mix-blocks")
        # one block of each source at most is cut
        inside = spread.join(each.filter("__cut is not null").select("__bs", "__bb", "__cut"), F.col("__source").eqNullSafe(F.col("__bs")) & (F.col("__block") == F.col("__bb")))
        within = Window.partitionBy("__source").orderBy(F.xxhash64("__h", F.lit(seed + 3)), "__h")
        last = inside.withColumn("__first", F.sum("__n").over(within) - F.col("__n")).filter(F.col("__first") < F.col("__cut")).select(F.col("__source").alias("__ls"), F.col("__h").alias("__lh"))
        last = written(last, "mix-last")
        sizes = written(plan.select("__s", "__blocks"), "mix-sizes")

    out = documents.withColumns({"mix_tokens": tokens(text), h: F.xxhash64(F.col(key), F.lit(seed))})
    out = out.join(sizes, F.col(source).eqNullSafe(F.col("__s"))).withColumn(part, place(h))
    out = out.join(each, F.col(source).eqNullSafe(F.col("__bs")) & (F.col(part) == F.col("__bb")))
    out = out.join(last, F.col(source).eqNullSafe(F.col("__ls")) & (F.col(h) == F.col("__lh")), "left")
    out = out.filter(F.col("__cut").isNull() | F.col("__lh").isNotNull())
    return out.withColumns({"mix_pass": F.col("__bp"), "mix_block": F.col("__at"), "mix_place": F.col("__place")}).select(*documents.columns, *own)


def op1_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Mixes all documents within as many tokens as the corpus has; one row for each occurrence in the mix."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
