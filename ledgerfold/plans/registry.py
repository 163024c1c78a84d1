"""Registered queries of the library, and the DuckDB SQL that checks them.

The library's operators run here on the general tables: orders stand for runs of a customer, events
for callbacks, conversations for paused threads, documents for intake payloads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions import payload, text
from ledgerfold.operators import evaluate, flow, reads, state
from ledgerfold.operators.verbatim import verbatim_pairs
from ledgerfold.plans import lifecycle, workflow
from ledgerfold.sources import fixtures, intake
from ledgerfold.sources.intake import table


def list_by_status(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return reads.list_by_status(orders, "O", 50, "o_orderstatus", "o_orderdate", "o_orderkey")


def latest_run_per_parent(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return reads.latest_per_key(orders, "o_custkey", "o_orderdate", "o_orderkey")


def dashboard_read_model(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return reads.dashboard(customers, orders, "BUILDING", 50, parent_key="c_custkey", child_key="o_custkey", status_column="c_mktsegment", parent_ts="c_acctbal", child_ts="o_orderdate", child_tie="o_orderkey", child_columns=("o_orderkey", "o_orderdate", "o_orderstatus"))


def reload_row(spark: SparkSession, sf: str) -> DataFrame:
    customers = intake.by_key(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), "c_custkey", 42)
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return reads.dashboard(customers, orders, None, 1, parent_key="c_custkey", child_key="o_custkey", status_column="c_mktsegment", parent_ts="c_acctbal", child_ts="o_orderdate", child_tie="o_orderkey", child_columns=("o_orderkey", "o_orderstatus"))


def latest_missing_child(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("k"), "quality")
    documents = table(spark, sf, "documents").select("doc_id", "source")
    joined = documents.join(labels, F.col("doc_id") == F.col("k"), "left")
    return joined.select("doc_id", "source", "quality", F.col("k").isNull().alias("missing"))


def orphan_and_cascade(spark: SparkSession, sf: str) -> DataFrame:
    orders, customers = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'")
    gone = intake.orphans(orders, customers, "o_custkey", "c_custkey").select("o_orderkey", F.lit("orphan").alias("fate"))
    return gone.union(intake.cascade(orders, customers, "o_custkey", "c_custkey").select("o_orderkey", F.lit("kept").alias("fate")))


def content_hash_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return documents.groupBy(payload.content_hash(F.col("text")).alias("idempotency_key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_received"))


def verbatim_check(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items that stand word for word in a document."""
    return verbatim_pairs(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", "text"))


def verbatim_names(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct beginnings of labelled documents, of one to four words, as items: short ones, which stand in many texts."""
    begins = F.array_join(F.slice(F.split("text", " "), 1, (F.col("doc_id") % 4 + 1).cast("int")), " ")
    items = table(spark, sf, "labels").select("doc_id").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").groupBy(begins.alias("text")).agg(F.min("doc_id").alias("item_id"))
    return verbatim_pairs(table(spark, sf, "documents").select("doc_id", "text"), items)


def format_check(spark: SparkSession, sf: str) -> DataFrame:
    valid = text.stripped(F.col("c_name")).rlike(r"^Customer#\p{Nd}{8}[02468]$")
    return table(spark, sf, "customer").select("c_custkey", valid.alias("valid"), text.ein_valid(F.concat(F.substring("c_name", 15, 2), F.when(F.col("c_custkey") % 3 > 0, F.lit("-")).otherwise(F.lit(" ")), F.substring("c_name", 12, 7), F.lit("\n"))).alias("ein_valid"))


def watchlist_screen(spark: SparkSession, sf: str) -> DataFrame:
    names = ("customer#000000003", "customer#000000077", "customer#000000140")
    return flow.screened(table(spark, sf, "customer").select("c_custkey", "c_name"), F.col("c_name"), names)


def token_set_match(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    turned = F.concat(F.substring_index("p_name", " ", -1), F.lit(", "), F.upper(F.substring_index("p_name", " ", 1)), F.when(F.col("p_partkey") % 3 == 0, " tech, Inc.").otherwise(" & Co."))
    a, b = F.concat("p_name", F.lit(" technology")), turned
    return parts.select("p_partkey", F.array_join(text.name_tokens(b), " ").alias("tokens"), text.names_match(a, b).alias("matched"))


def regex_extract_fields(spark: SparkSession, sf: str) -> DataFrame:
    found = text.fields(F.col("html"), {"lang": r'<html lang="([a-z]+)"', "title": r"<title>([^<]*)</title>", "h1": r"<h1>([^<]*)</h1>"})
    return table(spark, sf, "pages").select("page_id", found.alias("f")).select("page_id", "f.lang", "f.title", "f.h1")


def json_patch_fold(spark: SparkSession, sf: str) -> DataFrame:
    """props is a patch; k is there in some events only, as the type says, and is explicitly null in some."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    patch = F.when(F.col("event_type") == "view", F.create_map(F.lit("other"), k)).when(F.col("event_type") == "error", F.create_map(F.lit("k"), F.lit(None).cast("string"))).otherwise(F.create_map(F.lit("k"), k, F.lit("status"), F.col("event_type")))
    patched = e.select("user_id", "ts", "event_id", state.allowed(patch, ("k", "status")).alias("patch"))
    return state.fold_patches(patched, "user_id", ["ts", "event_id"], ("k", "status"))


def status_mirror(spark: SparkSession, sf: str) -> DataFrame:
    return state.status_mirror(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")


def decision_and_findings(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    ok, safe, odd = F.col("quality") == 1, F.col("toxic") == 0, F.col("doc_id") % 10 == 0
    found = text.findings(ok, F.lit("low quality"), safe, odd, F.lit("Matched sanctions watchlist entry"))
    return labels.select("doc_id", F.when(ok & safe & ~odd, "approved").otherwise("needs_review").alias("decision"), found.alias("findings"))


def bucket_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("n_chars") >= 300, 1).when(F.col("n_chars") >= 100, 0).alias("guess"))
    return evaluate.bucket_accuracy(documents.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id"), "lang", "guess", "quality")


def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    cents = table(spark, sf, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return evaluate.score_summary(cents, "cents", "event_type")


def paused_latest_turn(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n_chars"))
    last = reads.latest_per_key(turns, "conv_id", "turn", "n_chars")
    return last.select("conv_id", "turn", "role", "n_chars", text.thread_id(F.col("conv_id")).alias("thread_id"), (F.col("role") != "assistant").alias("awaiting"))


def guard_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders are the current state; events are reviewers' decisions on them."""
    status = F.when(F.col("o_orderstatus") == "P", "needs_review").when(F.col("o_orderstatus") == "F", "approved").otherwise("processing")
    current = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"))
    decision = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "error", "rejected").otherwise("maybe")
    decisions = table(spark, sf, "events").select((F.col("event_id") * 3).alias("onboarding_id"), decision.alias("decision"))
    return state.resume_guard(decisions, current)


def badge_and_actions(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "needs_review").when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderkey") % 7 == 0, "rejected").otherwise("received")
    return reads.with_actions(table(spark, sf, "orders").select("o_orderkey", status.alias("status")))


def golden_flow(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty evaluation cases of every supplier, whose name stands before the companies', through the whole flow."""
    cases = fixtures.cases_of(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_suppkey", F.col("s_name"))
    return evaluate.bucket_accuracy(evaluate.run_all(cases), "bucket", "decision", "expected_decision")


def golden_judged(spark: SparkSession, sf: str) -> DataFrame:
    """Of the same cases, those that each scorer gets: eighteen and five of every twenty."""
    cases = fixtures.cases_of(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_suppkey", F.col("s_name"))
    run = evaluate.judged(evaluate.run_all(cases))
    return run.groupBy("s_suppkey").agg(F.count_if("judge_match").alias("n_match"), F.count_if("judge_grounding").alias("n_grounding"), F.min("thread_id").alias("first_thread"))


QUERIES = {f.__name__: f for f in (list_by_status, latest_run_per_parent, dashboard_read_model, reload_row, latest_missing_child, orphan_and_cascade, content_hash_dedupe, verbatim_check, verbatim_names, format_check, watchlist_screen, token_set_match, regex_extract_fields, json_patch_fold, status_mirror, decision_and_findings, bucket_accuracy, score_summary, paused_latest_turn, guard_transitions, badge_and_actions, golden_flow, golden_judged)} | workflow.QUERIES | lifecycle.QUERIES

_LATEST = "SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"

ORACLE = {
    "list_by_status": "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50",
    "latest_run_per_parent": _LATEST,
    "dashboard_read_model": f"WITH p AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 50), l AS ({_LATEST}) SELECT p.*, o_orderkey, o_orderdate, o_orderstatus FROM p LEFT JOIN l ON c_custkey = o_custkey",
    "reload_row": f"WITH l AS ({_LATEST}) SELECT c_custkey, c_name, c_mktsegment, c_acctbal, o_orderkey, o_orderstatus FROM customer LEFT JOIN l ON c_custkey = o_custkey WHERE c_custkey = 42",
    "latest_missing_child": "SELECT d.doc_id, source, quality, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "orphan_and_cascade": "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') THEN 'kept' ELSE 'orphan' END AS fate FROM orders",
    "content_hash_dedupe": "SELECT sha256(text) AS idempotency_key, min(doc_id) AS doc_id, count(*) AS n_received FROM documents GROUP BY 1",
    "verbatim_check": "SELECT d.doc_id, b.item_id FROM documents d, benchmark b WHERE trim(b.text) <> '' AND contains(d.text, trim(b.text))",
    "verbatim_names": "WITH f AS (SELECT array_to_string(string_split(text, ' ')[1:doc_id % 4 + 1], ' ') AS text, min(doc_id) AS item_id FROM labels JOIN documents USING (doc_id) GROUP BY 1), b AS (SELECT item_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM f) SELECT d.doc_id, b.item_id FROM documents d, b WHERE t <> '' AND contains(d.text, t)",
    "format_check": "SELECT c_custkey, regexp_full_match(c_name, 'Customer#[0-9]{8}[02468]') AS valid, c_custkey % 3 > 0 AND regexp_full_match(substr(c_name, 12, 7), '[0-9]{7}') AS ein_valid FROM customer",
    "watchlist_screen": "SELECT *, CASE WHEN flagged THEN 'Matched sanctions watchlist entry' END AS reason FROM (SELECT c_custkey, c_name, lower(trim(c_name)) IN ('customer#000000003', 'customer#000000077', 'customer#000000140') AS flagged FROM customer)",
    "token_set_match": r"""WITH t AS (SELECT p_partkey, p_name || ' technology' AS a, split_part(p_name, ' ', -1) || ', ' || upper(split_part(p_name, ' ', 1)) || CASE WHEN p_partkey % 3 = 0 THEN ' tech, Inc.' ELSE ' & Co.' END AS b FROM part),
n AS (SELECT p_partkey, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(replace(replace(lower(a), '&', ' and '), ',', ' '), '[a-z0-9]+'), lambda x: x NOT IN ('inc', 'llc', 'corp', 'corporation', 'co', 'ltd', 'group')), lambda x: CASE WHEN x = 'tech' THEN 'technology' ELSE x END))) AS ta,
list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(replace(replace(lower(b), '&', ' and '), ',', ' '), '[a-z0-9]+'), lambda x: x NOT IN ('inc', 'llc', 'corp', 'corporation', 'co', 'ltd', 'group')), lambda x: CASE WHEN x = 'tech' THEN 'technology' ELSE x END))) AS tb FROM t)
SELECT p_partkey, array_to_string(tb, ' ') AS tokens, ta = tb AS matched FROM n""",
    "regex_extract_fields": """WITH f AS (SELECT page_id, html, regexp_matches(html, '<html lang="([a-z]+)"') AND regexp_matches(html, '<title>([^<]*)</title>') AND regexp_matches(html, '<h1>([^<]*)</h1>') AS ok FROM pages)
SELECT page_id, CASE WHEN ok THEN regexp_extract(html, '<html lang="([a-z]+)"', 1) END AS lang, CASE WHEN ok THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title, CASE WHEN ok THEN regexp_extract(html, '<h1>([^<]*)</h1>', 1) END AS h1 FROM f""",
    "json_patch_fold": """WITH p AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events),
a AS (SELECT user_id, k FROM p WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
b AS (SELECT user_id, event_type AS status FROM p WHERE event_type NOT IN ('view', 'error') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT u.user_id, a.k, b.status FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN a ON a.user_id = u.user_id LEFT JOIN b ON b.user_id = u.user_id""",
    "status_mirror": "SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "decision_and_findings": "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 AND doc_id % 10 <> 0 THEN 'approved' ELSE 'needs_review' END AS decision, concat_ws('; ', CASE WHEN quality <> 1 THEN 'Entity name mismatch: low quality' END, CASE WHEN toxic <> 0 THEN 'Tax ID failed validation against the mock tax registry.' END, CASE WHEN doc_id % 10 = 0 THEN 'Sanctions screening hit: Matched sanctions watchlist entry' END) AS findings FROM labels",
    "bucket_accuracy": "SELECT lang, count(*) AS total, count(*) FILTER (CASE WHEN n_chars >= 300 THEN 1 WHEN n_chars >= 100 THEN 0 END = quality) AS correct FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "score_summary": "SELECT event_type, avg(c) AS avg_score, count(c) AS n, min(c) AS min_score, max(c) AS max_score, CAST(sum(c) AS BIGINT) AS sum_score FROM (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS c FROM events) WHERE c IS NOT NULL GROUP BY event_type",
    "paused_latest_turn": "SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS n_chars, 'onboarding-' || conv_id AS thread_id, role <> 'assistant' AS awaiting FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, length(text) DESC) = 1",
    "guard_transitions": "WITH c AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'needs_review' WHEN 'F' THEN 'approved' ELSE 'processing' END AS s FROM orders), d AS (SELECT event_id * 3 AS onboarding_id, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'maybe' END AS decision FROM events) SELECT onboarding_id, decision, CASE WHEN decision = 'maybe' THEN 'invalid_decision' WHEN s IS NULL THEN 'not_found' WHEN s <> 'needs_review' THEN 'not_awaiting_review' ELSE 'ok' END AS result FROM d LEFT JOIN c ON id = onboarding_id",
    "badge_and_actions": "SELECT *, CASE status WHEN 'approved' THEN 'badge-success' WHEN 'needs_review' THEN 'badge-warning' WHEN 'rejected' THEN 'badge-error' ELSE 'badge-neutral' END AS badge, status = 'needs_review' AS reviewable FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'needs_review' WHEN o_orderstatus = 'F' THEN 'approved' WHEN o_orderkey % 7 = 0 THEN 'rejected' ELSE 'received' END AS status FROM orders)",
    "golden_flow": "SELECT bucket, n * per AS total, n * per AS correct FROM (SELECT count(*) AS n FROM supplier), (VALUES ('clean', 10), ('mismatch', 5), ('formatting', 3), ('malformed', 2)) t(bucket, per)",
    "golden_judged": "SELECT s_suppkey, CAST(18 AS BIGINT) AS n_match, CAST(5 AS BIGINT) AS n_grounding, 'eval-' || s_suppkey || '/clean-01' AS first_thread FROM supplier",
} | workflow.ORACLE | lifecycle.ORACLE
