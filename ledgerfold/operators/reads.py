"""Read models: latest row per key, status lists, the dashboard, the review page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.functions import payload, text


def latest_per_key(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The row of the latest ts of each key, ties to the largest `tie`. Runs as a partial and a final group limit."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def list_by_status(df: DataFrame, status: str | None = None, limit: int = 50, status_column: str = "status", ts: str = "inserted_at", tie: str = "id") -> DataFrame:
    """The newest rows, of one status if one is given; ties by id, newest first."""
    chosen = df if status is None else df.filter(F.col(status_column) == status)
    return chosen.orderBy(F.desc(ts), F.desc(tie)).limit(limit)


#: Rows of a page up to which it is broadcast; the limit is the caller's.
SMALL_PAGE = 10_000


def rows_of_page(children: DataFrame, page: DataFrame, key: str, page_key: str, limit: int | None = None) -> DataFrame:
    """Children of a page's rows; none for an empty page. A page that is known to be small is broadcast."""
    keys = page.select(F.col(page_key).alias(key)).distinct()
    return children.join(F.broadcast(keys) if limit is not None and limit <= SMALL_PAGE else keys, key, "left_semi")


def dashboard(parents: DataFrame, children: DataFrame, status: str | None = None, limit: int = 50, *, parent_key: str = "id", child_key: str = "onboarding_id", status_column: str = "status", parent_ts: str = "inserted_at", child_ts: str = "inserted_at", child_tie: str = "id", child_columns: tuple[str, ...] = ("company_name",)) -> DataFrame:
    """A page of parents, newest first, each with columns of its latest child (null without one).

    The page is cut first, so only its own children are ranked; the join may lose its order, which is made again.
    """
    page = list_by_status(parents, status, limit, status_column, parent_ts, parent_key)
    own = rows_of_page(children, page, child_key, parent_key, limit)
    latest = latest_per_key(own, child_key, child_ts, child_tie).select(F.col(child_key).alias("__key"), *child_columns)
    return list_by_status(page.join(latest, F.col(parent_key) == F.col("__key"), "left").drop("__key"), None, limit, status_column, parent_ts, parent_key)


def review(run: DataFrame, key: Column | None = None) -> DataFrame:
    """A run in long form, as a reviewer sees it: field, contract value, W-9 value; the explanation belongs to neither.

    key: what the tax id is encrypted with; without one it is shown as it is stored, as text.
    """
    tax = F.col("tax_id").cast("string") if key is None else payload.decrypted(F.col("tax_id"), key)
    none = F.lit(None).cast("string")
    fields = (("company_name", F.col("company_name"), F.col("w9_company_name"), none), ("payment_terms", F.col("payment_terms"), none, none), ("liability_clauses", F.col("liability_clauses"), none, none), ("tax_id", none, tax, none), ("explanation", none, none, F.col("explanation")))
    each = F.array(*(F.struct(F.lit(f).alias("field"), a.alias("contract"), b.alias("w9"), c.alias("agent")) for f, a, b, c in fields))
    return run.select("onboarding_id", F.inline(each))


def with_actions(rows: DataFrame) -> DataFrame:
    return rows.withColumn("badge", text.badge(F.col("status"))).withColumn("reviewable", F.coalesce(F.col("status") == "needs_review", F.lit(False)))


def keyed(df: DataFrame, key: str) -> DataFrame:
    """One row with a map from key to the other columns of the row: for a page, whose keys are distinct and few."""
    rest = F.struct(*(c for c in df.columns if c != key))
    return df.agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), rest))).alias("by_key"))


def existing(asked: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """asked with exists: whether df has a row of that key; a null key has none."""
    return asked.join(df.select(F.col(key).alias("__key")).distinct(), F.col(key) == F.col("__key"), "left").withColumn("exists", F.col("__key").isNotNull()).drop("__key")


def prepended(page: DataFrame, changed: DataFrame, key: str, order: list[str], limit: int = 50) -> DataFrame:
    """A page after some rows have changed: a row of a known key is replaced, one of a new key comes first among its equals.

    Places (from 1) are those of the order (descending, ties by key), cut at the limit again.
    """
    kept = page.join(changed.select(key), key, "left_anti").select(*page.columns)
    newest = Window.orderBy(*(F.desc(c) for c in order), F.desc(key))
    return list_by_status(kept.union(changed.select(*page.columns)), None, limit, ts=order[0], tie=key).withColumn("place", F.row_number().over(newest))
