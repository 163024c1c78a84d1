"""Evaluation: accuracy by bucket, score averages, metric summaries, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.operators import flow
from ledgerfold.sources.ranges import running


def bucket_accuracy(results: DataFrame, bucket: str, decision: str, expected: str) -> DataFrame:
    """bucket, total, correct; a row without a decision (an error) counts as wrong."""
    right = F.coalesce(F.col(decision) == F.col(expected), F.lit(False))
    return results.groupBy(bucket).agg(F.count("*").alias("total"), F.count_if(right).alias("correct"))


def score_summary(scores: DataFrame, score: str, *by: str) -> DataFrame:
    """Average, number, least, largest and sum of the scores that are there; no rows means no scored cases."""
    s = F.col(score)
    return scores.filter(s.isNotNull()).groupBy(*by).agg(F.avg(s).alias("avg_score"), F.count(s).alias("n"), F.min(s).alias("min_score"), F.max(s).alias("max_score"), F.sum(s).alias("sum_score"))


def judged(results: DataFrame) -> DataFrame:
    """Cases for the two scorers: judge_match where a match has an expectation, judge_grounding where such a case also
    has an explanation and findings. A case with an error, without a match or without an expectation has neither."""
    match = F.col("error").isNull() & F.col("match").isNotNull() & F.col("expected_entity_match").isNotNull()
    return results.withColumn("judge_match", match).withColumn("judge_grounding", match & F.col("explanation").isNotNull() & F.col("findings").isNotNull())


#: Percentiles of a metric.
PERCENTILES = (50, 95, 99)


def metrics(events: DataFrame, value: str, *tags: str) -> DataFrame:
    """tags, min, max, mean, sum, n and percentiles, which are exact: the least value that so many percent of the values
    don't exceed (null where there is none).

    Ranks are running sums of the counts of distinct values, so no task holds the values of a tag.
    """
    v, c = F.col(value), F.col
    plain = events.groupBy(*tags).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.sum(v).alias("sum"), F.count(v).alias("n"))
    counted = events.filter(v.isNotNull()).groupBy(*tags, v.alias("__v")).agg(F.count("*").alias("__n"))
    ranks = running(counted, list(tags), ["__v"], "__n", "__upto")
    sizes = ranks.groupBy(*(c(t).alias(f"__of_{t}") for t in tags)).agg(F.sum("__n").alias("__all"))
    placed = ranks.join(sizes, [c(t).eqNullSafe(c(f"__of_{t}")) for t in tags]) if tags else ranks.crossJoin(sizes)
    least = F.array(*(F.min(F.when(c("__upto") * 100 >= c("__all") * p, c("__v"))) for p in PERCENTILES))
    found = placed.groupBy(*(c(t).alias(f"__of_{t}") for t in tags)).agg(least.alias("percentiles"))
    out = plain.join(found, [c(t).eqNullSafe(c(f"__of_{t}")) for t in tags], "left") if tags else plain.crossJoin(found)
    return out.select(*tags, "min", "max", "mean", F.when(c("n") > 0, c("percentiles")).alias("percentiles"), "sum", "n")


#: Size of a sketch: quantiles are within SKETCH_ERROR of their rank, and a sketch has some kilobytes however many values it saw.
SKETCH_K, SKETCH_ERROR = 800, 0.01


def summarised(events: DataFrame, value: str, *tags: str) -> DataFrame:
    """Mergeable summaries of a whole-number value: tags, n, sum, min, max and a KLL sketch. They are stored for each
    batch or period (one of the tags) and merged later; the events aren't needed again."""
    v = F.col(value).cast("long")
    return events.groupBy(*tags).agg(F.count(v).alias("n"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.kll_sketch_agg_bigint(v, SKETCH_K).alias("sketch"))


def merged(summaries: DataFrame, *tags: str) -> DataFrame:
    """Summaries of fewer tags from those of more: of a day from its hours, of all days from each."""
    return summaries.groupBy(*tags).agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_bigint("sketch").alias("sketch"))


def quantiles(summaries: DataFrame, at: dict[str, float]) -> DataFrame:
    """summaries with a column for each named quantile, and mean; null where no value was counted."""
    read = {name: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(q).cast("double"))) for name, q in at.items()}
    return summaries.withColumns(read | {"mean": F.col("sum") / F.nullif(F.col("n"), F.lit(0))})


def report(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Each row as one line of fixed-width columns."""
    return rows.select(F.rtrim(F.concat_ws(" ", *(F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), w, " ") for c, w in widths.items()))).alias("line"))


#: Titles and widths of the report's columns, and the heading of its last part.
REPORT = {"fixture": 16, "bucket": 12, "decision": 14, "expected": 14, "entity_match": 14, "tax_id_ok": 11, "error": 0}
JUDGE_HEADING = "--- LLM-judge tier (Claude Sonnet) ---"


def _padded(c: Column, width: int) -> Column:
    """At least so wide: a longer text stays whole."""
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(c))))


def eval_report(results: DataFrame, scores: DataFrame, names: tuple[str, ...] = ("entity_match", "groundedness")) -> DataFrame:
    """The whole report as (part, key, line), to be sorted by the first two: a header, a line for each case, one for each
    bucket, a heading and one for each scorer, with empty lines between the parts.

    results: id, bucket, decision, expected_decision, match, tax_id_verbatim (both boolean) and error. Values that
    aren't there are None, as are those of a case that failed. scores: metric and score.
    """
    shown = lambda c: F.coalesce(F.initcap(F.col(c).cast("string")) if c in ("match", "tax_id_verbatim") else F.col(c).cast("string"), F.lit("None"))
    cells = dict(zip(REPORT, [*map(shown, ("id", "bucket", "decision", "expected_decision", "match", "tax_id_verbatim")), F.coalesce("error", F.lit(""))], strict=True))
    line = lambda values: F.concat(*(_padded(values[k], w) for k, w in REPORT.items())).alias("line")
    one = results.sparkSession.range(1)
    fixed = lambda part, text: one.select(F.lit(part).alias("part"), F.lit("").alias("key"), text.alias("line"))
    parts = [
        fixed(0, line({k: F.lit(k) for k in REPORT})),
        results.select(F.lit(1), F.col("id").cast("string"), line(cells)),
        fixed(2, F.lit("")),
        bucket_lines(bucket_accuracy(results, "bucket", "decision", "expected_decision")).select(F.lit(3), "line", "line"),
        fixed(4, F.lit("")),
        fixed(5, F.lit(JUDGE_HEADING)),
        score_lines(scores, names).select(F.lit(6), "line", "line"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def eval_thread(case: Column) -> Column:
    """Thread of an evaluation case, apart from those of onboardings."""
    return F.concat(F.lit("eval-"), case.cast("string"))


def run_all(cases: DataFrame, graph: Callable[[DataFrame], DataFrame] = flow.validate_documents) -> DataFrame:
    """Every case through a graph, with its thread; where a case fails, its row has the error and no decision."""
    return graph(cases).withColumn("thread_id", eval_thread(F.col("id")))


def scored(results: DataFrame, scorers: dict[str, tuple[Column, Column]], threshold: float = 0.7) -> DataFrame:
    """metric, score and passed (score at or above threshold) for every case that a metric applies to.

    scorers: metric to (whether it applies, score from 0 to 1); a model is a pandas UDF. Without scorers no row.
    """
    each = [F.when(when, F.struct(F.lit(name).alias("metric"), score.cast("double").alias("score"))) for name, (when, score) in scorers.items()]
    if not each:
        each = [F.lit(None).cast("struct<metric:string,score:double>")]
    out = results.withColumn("__scores", F.filter(F.array(*each), lambda x: x.isNotNull() & x["score"].isNotNull()))
    return out.select("*", F.inline("__scores")).drop("__scores").withColumn("passed", F.col("score") >= threshold)


def bucket_lines(accuracy: DataFrame) -> DataFrame:
    """A line for each bucket of bucket_accuracy()."""
    return accuracy.select(F.concat(F.col("bucket"), F.lit(": decision correct "), F.col("correct").cast("string"), F.lit("/"), F.col("total").cast("string")).alias("line"))


def score_lines(scores: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """A line for each metric: average and number of its scores, or that it has none."""
    each = (F.struct(F.lit(m).alias("metric"), F.avg(F.when(F.col("metric") == m, F.col("score"))).alias("avg"), F.count(F.when(F.col("metric") == m, F.col("score"))).alias("n")) for m in metrics)
    said = F.when(F.col("n") > 0, F.format_string("%s: avg %.2f (n=%d)", "metric", "avg", "n")).otherwise(F.concat("metric", F.lit(": no scored cases")))
    return scores.agg(F.array(*each).alias("each")).select(F.inline("each")).select(said.alias("line"))


def counts(rows: DataFrame, bucket: str, key: str, holds: Column) -> DataFrame:
    """Of each bucket: rows, distinct keys, whether keys are unique, and whether the condition holds for all rows."""
    out = rows.groupBy(bucket).agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_keys"), F.bool_and(F.coalesce(holds, F.lit(False))).alias("all_hold"))
    return out.withColumn("unique", F.col("n") == F.col("n_keys"))
