"""The validation flow: extract, validate, decide, explain; and its resumption by a reviewer."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions import text


#: Entries of a watchlist that an expression may hold; a longer one is a table.
MOST_ENTRIES = 10_000


def screener(watchlist: tuple[str, ...] = text.WATCHLIST) -> Callable[[Column], Column]:
    """A screening step for a list of names: flagged and reason of a name, by a set in the expression. Nothing is shuffled."""
    entries = sorted(set(watchlist))
    if len(entries) > MOST_ENTRIES:
        raise ValueError(f"{len(entries)} entries: give screened() a table of them")

    def step(name: Column) -> Column:
        hit = F.coalesce(text.watch_key(name).isin(*entries), F.lit(False)) if entries else F.lit(False)
        return F.struct(hit.alias("flagged"), F.when(hit, REASON).alias("reason"))

    return step


REASON = "Matched sanctions watchlist entry"
#: Bytes of a watchlist table that is broadcast; a larger one is joined by a shuffle, without the names that nobody has.
BROADCAST_BYTES = 64 << 20


def screened(df: DataFrame, name: Column, watchlist: tuple[str, ...] | DataFrame = text.WATCHLIST) -> DataFrame:
    """df with flagged and reason, for a list of names or a table of them (column entry, lower case, stripped).

    A table is counted before it is broadcast. Beyond the bound, distinct names are looked up, so a name that most
    rows have is looked up once.
    """
    if not isinstance(watchlist, DataFrame):
        return df.withColumn("__hit", screener(watchlist)(name)).withColumns({"flagged": F.col("__hit.flagged"), "reason": F.col("__hit.reason")}).drop("__hit")
    entries = watchlist.select(F.col("entry").alias("__entry")).filter("__entry is not null").distinct()
    size = entries.agg(F.coalesce(F.sum(F.octet_length("__entry") + 16), F.lit(0)).alias("s")).first()["s"]
    named = df.withColumn("__name", text.watch_key(name))
    if size <= BROADCAST_BYTES:
        hit = named.join(F.broadcast(entries), F.col("__name") == F.col("__entry"), "left")
    else:
        found = named.select("__name").distinct().join(entries, F.col("__name") == F.col("__entry")).select("__entry")
        hit = named.join(found, F.col("__name") == F.col("__entry"), "left")
    return hit.withColumn("flagged", F.col("__entry").isNotNull()).withColumn("reason", F.when(F.col("__entry").isNotNull(), REASON)).drop("__name", "__entry")


class Trapped:
    """A step in Python whose failures stay with their rows: function takes and gives pandas series (of the type `gives`).

    Where it raises, the batch is halved until the rows that make it raise are alone; these have the error's text
    ("Type: message") and no value. Rows whose arguments are all null aren't asked.
    """

    def __init__(self, function: Callable, gives: str):
        self.function, self.gives = function, gives

    def __call__(self, *arguments: Column) -> Column:
        """A struct of value and error."""
        function, nested = self.function, self.gives.strip().lower().startswith("struct")

        def results(parts: list) -> list:
            if not len(parts[0]):
                return []
            try:
                out = function(*parts)
                return [(v, None) for v in (out.to_dict("records") if isinstance(out, pd.DataFrame) else out.tolist())]
            except Exception as e:
                if len(parts[0]) == 1:
                    return [(None, f"{type(e).__name__}: {e}")]
                half = len(parts[0]) // 2
                return results([p.iloc[:half] for p in parts]) + results([p.iloc[half:] for p in parts])

        def run(*parts: pd.Series) -> pd.DataFrame:
            asked = ~pd.concat([p.isna() for p in parts], axis=1).all(axis=1)
            found = iter(results([p[asked] for p in parts]))
            rows = [next(found) if a else (None, None) for a in asked]
            values = [json.dumps(v) if nested and v is not None else v for v, _ in rows]
            return pd.DataFrame({"value": pd.Series(values, dtype=object), "error": pd.Series([e for _, e in rows], dtype=object)})

        # a struct within a struct doesn't pass a pandas UDF: it travels as JSON
        out = F.pandas_udf(run, f"struct<value:{'string' if nested else self.gives},error:string>")(*arguments)
        return out if not nested else F.struct(F.from_json(out["value"], self.gives).alias("value"), out["error"].alias("error"))


@dataclass(frozen=True)
class Steps:
    """Replaceable steps: column builders; a model, or any Python that may fail, stands in as a Trapped function."""

    extract_contract: Callable[[Column], Column] = lambda t: text.fields(t, text.CONTRACT_FIELDS)
    extract_w9: Callable[[Column], Column] = lambda t: text.fields(t, text.W9_FIELDS)
    match_names: Callable[[Column, Column], Column] = text.names_match
    explain_match: Callable[[Column, Column], Column] = lambda a, b: F.concat(F.lit("'"), F.coalesce(a, F.lit("")), F.lit("' in the contract, '"), F.coalesce(b, F.lit("")), F.lit("' in the W-9"))
    tax_valid: Callable[[Column], Column] = text.ein_valid
    screen: Callable[[Column], Column] = screener()  # noqa: RUF009
    explain: Callable[[Column], Column] = lambda findings: findings


def validate_documents(documents: DataFrame, steps: Steps = Steps()) -> DataFrame:
    """Rows (contract_text, w9_text) with contract, w9, match, tax_id_valid, flagged, reason, findings,
    decision, explanation and error.

    Only the contract's name is screened. A row's error is that of the first step that fails for it: what a Trapped
    step raised, or that a document lacks a field; its decision and what follows is null, and other rows go on.
    For steps in Python the rows are dealt over all of the session's shuffle partitions: a small file with very many
    rows would else be one task.
    """
    if any(isinstance(s, Trapped) for s in vars(steps).values()):
        documents = documents.repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = documents.withColumn("error", F.lit(None).cast("string"))

    def step(df: DataFrame, name: str, function: Callable, *arguments: Column, missing: str | None = None, when: Column | None = None) -> DataFrame:
        fine = F.col("error").isNull() if when is None else F.col("error").isNull() & when
        if isinstance(function, Trapped):
            df = df.withColumn("__out", function(*(F.when(fine, a) for a in arguments)))
            value, error = F.col("__out.value"), F.col("__out.error")
        else:
            df = df.withColumn("__out", function(*arguments))
            value, error = F.col("__out"), F.lit(None).cast("string")
        said = error if missing is None else F.coalesce(error, F.when(value.isNull(), F.lit(f"ExtractionError: {missing}")))
        return df.withColumns({name: F.when(fine, value), "error": F.coalesce("error", F.when(fine, said))}).drop("__out")

    out = step(out, "contract", steps.extract_contract, F.col("contract_text"), missing="contract")
    out = step(out, "w9", steps.extract_w9, F.col("w9_text"), missing="w9")
    a, b = F.col("contract.company_name"), F.col("w9.company_name")
    out = step(out, "match", steps.match_names, a, b)
    out = step(out, "tax_id_valid", steps.tax_valid, F.col("w9.tax_id"))
    out = step(out, "__hit", steps.screen, a).withColumns({"flagged": F.col("__hit.flagged"), "reason": F.col("__hit.reason")}).drop("__hit")
    found = text.findings(F.col("match"), steps.explain_match(a, b), F.col("tax_id_valid"), F.col("flagged"), F.col("reason"))
    approved = F.col("match") & F.col("tax_id_valid") & ~F.col("flagged")
    out = out.withColumn("__approved", F.when(F.col("error").isNull(), F.coalesce(approved, F.lit(False))))
    out = out.withColumn("findings", F.when(~F.col("__approved"), found))
    out = step(out, "explanation", steps.explain, F.col("findings"), when=F.col("findings").isNotNull())
    return out.withColumn("decision", F.when(F.col("error").isNull(), F.when(F.col("__approved"), "approved").otherwise("needs_review"))).drop("__approved")


def result_patch(validated: DataFrame, onboarding: str = "onboarding_id") -> DataFrame:
    """Callback rows: the fields of each extraction, its status, and thread and explanation for those to review."""
    c = F.col
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    review = c("decision") == "needs_review"
    entries = F.array(
        entry("status", c("decision")),
        entry("company_name", c("contract.company_name")),
        entry("w9_company_name", c("w9.company_name")),
        entry("tax_id", c("w9.tax_id")),
        entry("payment_terms", c("contract.payment_terms")),
        entry("liability_clauses", c("contract.liability_clauses")),
        F.when(review, entry("thread_id", text.thread_id(c(onboarding)))),
        F.when(review, entry("explanation", c("explanation"))),
    )
    return validated.filter("decision is not null").select(c(onboarding).alias("onboarding_id"), F.map_from_entries(F.filter(entries, lambda x: x.isNotNull())).alias("patch"))


def with_texts(work: DataFrame, documents: DataFrame) -> DataFrame:
    """Work (document_paths) with contract_text and w9_text from documents (path, text); null where one is missing."""
    out = work
    for k in ("contract", "w9"):
        found = documents.select(F.col("path").alias(f"__{k}"), F.col("text").alias(f"{k}_text"))
        out = out.join(found, F.col("document_paths")[k] == F.col(f"__{k}"), "left").drop(f"__{k}")
    return out


def run(work: DataFrame, documents: DataFrame, steps: Steps = Steps(), flow: Callable[[DataFrame, Steps], DataFrame] = validate_documents) -> DataFrame:
    """The whole run of a work list (id, document_paths): texts, flow, and for each onboarding its callback and its thread.

    Columns: onboarding_id, thread_id, patch (null where the run failed), error, next (the step that a paused
    thread stands before, else null) and state (what it needs to go on). flow may be another graph of the same columns.
    """
    done = flow(with_texts(work.select(F.col("id").alias("onboarding_id"), "document_paths"), documents), steps)
    patches = result_patch(done).select(F.col("onboarding_id").alias("__id"), "patch")
    c, review = F.col, F.col("decision") == "needs_review"
    state = F.struct(*(c(x).cast("string").alias(x) for x in ("findings", "explanation")))
    kept = done.select("onboarding_id", text.thread_id(c("onboarding_id")).alias("thread_id"), "error", F.when(review, "flag_for_review").alias("next"), F.when(review, F.to_json(state)).alias("state"))
    return kept.join(patches, c("onboarding_id") == c("__id"), "left").drop("__id")


def latest_states(log: DataFrame) -> DataFrame:
    """The last state of every thread in the log of states (thread_id, seq, next, state): what a restart reads."""
    last = F.max_by(F.struct("next", "state"), "seq")
    return log.groupBy("thread_id").agg(last.alias("__last"), F.max("seq").alias("seq")).select("thread_id", "seq", "__last.*")


def resumed(log: DataFrame, decisions: DataFrame, order: str | None = None) -> DataFrame:
    """Decisions (thread_id, decision) on threads of the log, with result, patch, and the seq, next and state to log.

    result: not_found, not_awaiting_review (the thread doesn't stand before the review, or another decision of the
    batch is taken), invalid_decision or ok. Of several good decisions on a thread the first in the order is taken,
    or the least decision. The explanation is the stored one, which the patch always sends; the thread's id isn't
    sent again.
    """
    known = latest_states(log).select(F.col("thread_id").alias("__t"), F.col("seq").alias("__seq"), F.col("next").alias("__next"), F.col("state").alias("__state"))
    c = F.col
    awaiting = F.coalesce(c("__next") == "flag_for_review", F.lit(False))
    result = F.when(~F.coalesce(c("decision").isin("approved", "rejected"), F.lit(False)), "invalid_decision").when(c("__t").isNull(), "not_found").when(~awaiting, "not_awaiting_review").otherwise("ok")
    place = F.struct(*([order] if order else []), "decision", "__row")
    judged = decisions.withColumn("__row", F.monotonically_increasing_id()).join(known, c("thread_id") == c("__t"), "left").withColumn("__good", result).withColumn("__place", place)
    # one for each thread, by an aggregate that is partial first: a thread may have very many decisions
    first = judged.filter("__good = 'ok'").groupBy(c("thread_id").alias("__thread")).agg(F.min("__place").alias("__first"))
    out = judged.join(first, c("thread_id") == c("__thread"), "left").withColumn("result", F.when((c("__good") == "ok") & (c("__place") != c("__first")), "not_awaiting_review").otherwise(c("__good")))
    ok = c("result") == "ok"
    patch = F.create_map(F.lit("status"), c("decision"), F.lit("explanation"), F.get_json_object("__state", "$.explanation"))
    return out.select("thread_id", "decision", *([order] if order else []), "result", F.when(ok, patch).alias("patch"), F.when(ok, c("__seq") + 1).alias("seq"), F.lit(None).cast("string").alias("next"), F.when(ok, c("__state")).alias("state"))
