"""A key's events in order as an automaton: which of them take effect, and which steps are out of the ordinary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.sources.ranges import with_previous

#: Steps of an onboarding's status in the ordinary course; any other is reported, and takes effect nevertheless.
ORDINARY = {
    None: ("received",),
    "received": ("processing",),
    "processing": ("needs_review", "approved", "processing"),
    "needs_review": ("approved", "rejected", "processing"),
    "approved": (),
    "rejected": (),
}
#: What says that an attempt was taken up; it may come after what the attempt itself has reported.
TRIGGERED = "processing"


def ordinary(before: Column, after: Column, steps: dict = ORDINARY) -> Column:
    allowed = F.lit(False)
    for k, v in steps.items():
        if v:
            allowed = allowed | ((before.isNull() if k is None else before.eqNullSafe(F.lit(k))) & after.isin(*v))
    return allowed


def transitions(events: DataFrame, key: str, order: list[str], status: str = "status", attempt: str = "attempt") -> DataFrame:
    """events with previous (the status in effect before), effect and result.

    result is late where an attempt's own trigger comes after something that the attempt has reported: that event
    has no effect, so a fast callback is not put back to processing. Every other event has effect: step where the
    step is ordinary, same where it changes nothing, illegal where the course of things doesn't know it (reported,
    not dropped), and invalid (no effect) where the status is null. A later attempt's trigger is no late one. Equal places in the order are settled
    by attempt and status. Keys of any size are dealt over ranges of their events.
    """
    by = list(dict.fromkeys([*order, attempt, status]))
    trigger = F.col(status) == TRIGGERED
    told = with_previous(events, [key, attempt], [c for c in by if c != attempt], F.when(~trigger, F.lit(1)), "__reported")
    late = F.coalesce(trigger & F.col("__reported").isNotNull(), F.lit(False))
    told = told.withColumn("effect", ~late & F.col(status).isNotNull()).drop("__reported")
    out = with_previous(told, [key], by, F.when(F.col("effect"), F.col(status)), "previous")
    before, after = F.col("previous"), F.col(status)
    result = F.when(after.isNull(), "invalid").when(~F.col("effect"), "late").when(ordinary(before, after), "step").when(before.eqNullSafe(after), "same").otherwise("illegal")
    return out.withColumn("result", result)


def current(told: DataFrame, key: str, order: list[str], status: str = "status", attempt: str = "attempt") -> DataFrame:
    """key and the status in effect after all of its events, with the number of illegal steps and late triggers."""
    by = list(dict.fromkeys([*order, attempt, status]))
    last = F.max_by(status, F.when(F.col("effect"), F.struct(*by)))
    return told.groupBy(key).agg(last.alias(status), F.count_if(F.col("result") == "illegal").alias("n_illegal"), F.count_if(F.col("result") == "late").alias("n_late"))
