"""Registered queries of what lives on between runs, and the DuckDB SQL that checks them: ledgers, snapshots and their
changes, thread logs, transitions, ids, trapped steps, mergeable summaries, streams.

Each runs over whole tables; where a remainder of an id appears, it deals the rows to batches, all of which count.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions import text
from ledgerfold.operators import evaluate, flow, state, transitions
from ledgerfold.operators.snapshots import PatchTable, Subscriber
from ledgerfold.operators.threads import ThreadLog
from ledgerfold.plans import workflow
from ledgerfold.sources import intake
from ledgerfold.sources.buckets import Ids
from ledgerfold.sources.intake import table
from ledgerfold.sources.scratch import scratch_path
from ledgerfold.sources.storage import TableStorage
from ledgerfold.streaming import live
from ledgerfold.streaming.ledger import Ledger


def _whole(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def callbacks_without_status(spark: SparkSession, sf: str) -> DataFrame:
    """Callbacks that patch a name, with no status (kept), an explicit null or blank one (refused) or a good one."""
    orders = table(spark, sf, "orders")
    own = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("onboarding_id"), F.when(F.col("o_orderstatus") == "P", "needs_review").otherwise("processing").alias("status"), F.lit("old").alias("company_name"), F.col("o_orderdate").cast("timestamp").alias("inserted_at"))
    kind, lit = F.col("event_id") % 4, F.lit
    name = F.concat(lit("name "), F.col("event_id").cast("string"))
    patch = F.when(kind == 0, F.create_map(lit("company_name"), name)).when(kind == 1, F.create_map(lit("company_name"), name, lit("status"), lit(None).cast("string"))).when(kind == 2, F.create_map(lit("company_name"), name, lit("status"), lit("  "))).otherwise(F.create_map(lit("status"), lit("approved")))
    calls = table(spark, sf, "events").select(F.col("user_id").alias("onboarding_id"), F.col("event_id").alias("seq"), patch.alias("patch"))
    return state.apply_callbacks(own, calls, ["seq"]).select("id", "status", "company_name")


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as evaluated cases: those of one language have no expectation, toxic ones an error, some no match."""
    c, docs = F.col, table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    met = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    error = F.when(c("toxic") == 1, "ValueError: toxic")
    match = F.when(error.isNull() & c("quality").isNotNull(), c("quality") == 1)
    found = F.when(match.isNotNull() & ~match, F.concat(F.lit("low quality of "), c("doc_id").cast("string")))
    return met.select("doc_id", F.concat(F.lit("case-"), c("doc_id").cast("string")).alias("id"), c("lang").alias("bucket"), error.alias("error"), match.alias("match"), F.when(c("lang") != "de", c("n_chars") > 300).alias("expected_entity_match"), found.alias("findings"), F.when(c("n_chars") % 2 == 0, found).alias("explanation"), F.when(error.isNull(), F.when(F.coalesce(match, F.lit(False)), "approved").otherwise("needs_review")).alias("decision"), F.when(c("n_chars") > 300, "approved").otherwise("needs_review").alias("expected_decision"), F.when(error.isNull(), c("n_chars") % 5 > 0).alias("tax_id_verbatim"))


def judged_cases(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.judged(_cases(spark, sf)).select("doc_id", "judge_match", "judge_grounding")


def _case_scores(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return evaluate.scored(evaluate.judged(_cases(spark, sf)), {"entity_match": (c("judge_match"), F.when(c("match") == c("expected_entity_match"), 0.75).otherwise(0.25)), "groundedness": (c("judge_grounding"), F.lit(0.5))})


def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    """Header, cases, buckets and scorers, as the evaluation prints them; the order is that of part and key."""
    return evaluate.eval_report(_cases(spark, sf), _case_scores(spark, sf).select("metric", "score"), ("entity_match", "groundedness", "never"))


def split_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads in four batches of two streams on one ledger, which is compacted between them: the second stream's
    first batch has number 0 too."""
    book, payloads, out = Ledger(spark, scratch_path(spark, "ledger"), most_parts=3), workflow._payloads(spark, sf), []
    for k, (stream, batch) in enumerate([("a", 0), ("b", 0), ("a", 1), ("b", 1)]):
        out.append(book.ingest(payloads.filter(F.col("seq") % 4 == k), stream, batch).select(F.lit(k).alias("k"), "seq", "result"))
    return _whole(out)


def ledger_keys(spark: SparkSession, sf: str) -> DataFrame:
    """What the ledger holds after batches that were repeated, by its own stream and number."""
    book, payloads = Ledger(spark, scratch_path(spark, "ledger"), most_parts=2), workflow._payloads(spark, sf)
    for stream, batch, k in (("a", 0, 0), ("a", 0, 0), ("b", 0, 1), ("a", 1, 0), ("b", 0, 1)):
        book.ingest(payloads.filter(F.col("seq") % 2 == k), stream, batch)
    return book.keys().groupBy("idempotency_key").agg(F.count("*").alias("n"), F.min("stream").alias("stream"))


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    """Events as statuses of their user: each value of ten starts another attempt."""
    kind = F.col("event_type")
    status = F.when(kind == "view", "processing").when(kind == "click", "needs_review").when(kind == "purchase", "approved").when(kind == "error", "rejected").when(F.col("event_id") % 2 == 0, "received")
    return table(spark, sf, "events").select("event_id", "user_id", "ts", (F.col("event_id") / 1000).cast("long").alias("attempt"), status.alias("status"))


def status_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return transitions.transitions(_steps(spark, sf), "user_id", ["ts", "event_id"]).select("event_id", "previous", "status", "effect", "result")


def status_after_transitions(spark: SparkSession, sf: str) -> DataFrame:
    told = transitions.transitions(_steps(spark, sf), "user_id", ["ts", "event_id"])
    return transitions.current(told, "user_id", ["ts", "event_id"])


def _patches(events: DataFrame) -> DataFrame:
    """Callbacks of events that any store takes up: some have one of the fields only, some an explicit null."""
    kind, lit = F.col("event_type"), F.lit
    name = F.concat(lit("n"), F.round(F.col("value") * 100).cast("long").cast("string"))
    patch = F.when(kind == "view", F.create_map(lit("status"), lit("processing"))).when(kind == "click", F.create_map(lit("company_name"), name)).when(kind == "error", F.create_map(lit("company_name"), lit(None).cast("string"), lit("status"), lit("rejected"))).when(kind == "signup", F.create_map(lit("junk"), lit("x"))).otherwise(F.create_map(lit("company_name"), name, lit("status"), lit("approved")))
    return events.select(F.col("user_id").alias("onboarding_id"), F.col("event_id").alias("seq"), patch.alias("patch"))


def _snapshot(spark: SparkSession, sf: str) -> PatchTable:
    """All events' patches in three appends, the later ones first: two are folded into the snapshot between them, one is repeated."""
    kept, patches = PatchTable(spark, scratch_path(spark, "patches"), buckets=8), _patches(table(spark, sf, "events")).withColumnRenamed("onboarding_id", "key")
    for k in (2, 0, 1):
        kept.append(patches.filter(F.col("seq") % 3 == k), f"batch-{k}")
        kept.append(patches.filter(F.col("seq") % 3 == k), f"batch-{k}")
        if k == 0:
            kept.compact()
    return kept


def snapshot_fold(spark: SparkSession, sf: str) -> DataFrame:
    return _snapshot(spark, sf).read().select("key", "status", "company_name")


def snapshot_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of asked keys, from their buckets alone."""
    asked = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))
    return _snapshot(spark, sf).read(asked).select("key", "status", "company_name")


def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    """What a subscriber has taken that stops twice on the way: every change once, with the row before and after."""
    kept = _snapshot(spark, sf)
    place = scratch_path(spark, "subscriber")

    def once(rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/taken/{version}")
        raise InterruptedError

    for _ in range(2):
        try:
            Subscriber(kept, place).follow(once)
        except InterruptedError:
            continue
    taken = Subscriber(kept, place).take()
    first = {v: k for k, v in enumerate(sorted(r["version"] for r in taken.select("version").distinct().collect()))}  # one of each append
    number = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))
    return taken.select(number[F.col("version").cast("int")].alias("append"), "key", "before.status", F.col("before.company_name").alias("company_name"), F.col("after.status").alias("new_status"), F.col("after.company_name").alias("new_company_name"))


def thread_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Threads pause, two reviewers decide on each in one batch, and others once more in the next; the second batch is repeated."""
    log, c = ThreadLog(spark, scratch_path(spark, "threads"), buckets=8), F.col
    name = lambda col: F.concat(F.lit("onboarding-"), c(col).cast("string")).alias("thread_id")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    waits = c("n_chars") % 3 > 0
    patch = F.create_map(F.lit("status"), F.when(waits, "needs_review").otherwise("approved"))
    log.pause(docs.select(name("doc_id"), F.lit(None).cast("string").alias("error"), F.when(waits, "flag_for_review").alias("next"), F.when(waits, F.concat(F.lit('{"explanation":"e'), c("n_chars").cast("string"), F.lit('"}'))).alias("state"), patch.alias("patch")), "run-0")
    labels = table(spark, sf, "labels")
    first = labels.select(name("doc_id"), F.when(c("quality") == 1, "approved").otherwise("rejected").alias("decision"), (c("doc_id") * 2).alias("at"))
    other = labels.select(name("doc_id"), F.when(c("toxic") == 1, "maybe").otherwise("rejected").alias("decision"), (c("doc_id") * 2 - c("doc_id") % 2 + 1 - 2 * (c("doc_id") % 2)).alias("at"))
    out = [log.decide(first.union(other), "decisions-0", "at")]
    late = docs.select(name("doc_id"), F.lit("approved").alias("decision"), c("doc_id").alias("at"))
    out.append(log.decide(late, "decisions-1", "at"))
    out[-1] = log.decide(late, "decisions-1", "at")
    sent = log.callbacks(1).groupBy("thread_id").agg(F.count("*").alias("n_callbacks"))
    met = _whole([d.select(F.lit(k).alias("batch"), "thread_id", "at", "decision", "result", c("patch")["explanation"].alias("explanation")) for k, d in enumerate(out)])
    return met.join(sent, "thread_id", "left").select("batch", "thread_id", "at", "decision", "result", "explanation", F.coalesce("n_callbacks", F.lit(0)).cast("long").alias("n_callbacks"))


def allocated_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches of orders numbered by one allocator: the second goes on where the first ended."""
    ids, orders = Ids(spark, scratch_path(spark, "ids"), first=101), table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return _whole([ids.numbered(orders.filter(f"o_orderstatus {sign} 'O'"), "o_orderkey") for sign in ("=", "<>")]).select("o_orderkey", "id")


def trapped_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' documents through a flow whose steps are Python that raises for some: an error stays with its row."""
    n, name = F.col("c_custkey"), F.col("c_name")

    def reads(texts):
        if texts.str.contains("0000007").any():
            raise ValueError("simulated extraction failure")
        return texts.map(lambda t: {"company_name": t.strip(), "payment_terms": "Net 30", "liability_clauses": "none"}).apply(dict)

    def screens(names):
        bad = names[names.str.endswith("3")]
        if len(bad):
            raise LookupError(f"no answer for {bad.iloc[0]}")
        return names.map(lambda x: {"flagged": x.endswith("5"), "reason": "listed" if x.endswith("5") else None})

    steps = flow.Steps(extract_contract=flow.Trapped(reads, "struct<company_name:string,payment_terms:string,liability_clauses:string>"), extract_w9=lambda t: F.struct(t.alias("company_name"), F.lit("12-3456789").alias("tax_id")), screen=flow.Trapped(screens, "struct<flagged:boolean,reason:string>"))
    cases = table(spark, sf, "customer").select(n, F.concat(F.lit(" "), name).alias("contract_text"), F.when(n % 4 > 0, name).otherwise("Other").alias("w9_text"))
    return evaluate.run_all(cases.withColumn("id", n), lambda c: flow.validate_documents(c, steps)).select("c_custkey", "decision", "error", "flagged")


def metric_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of every type and day, merged over the days: exact sums, and quantiles within the sketch's bound of their rank."""
    cents = table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    stored = evaluate.summarised(cents, "cents", "event_type", "day")
    out = evaluate.quantiles(evaluate.merged(stored, "event_type"), {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    met = cents.join(F.broadcast(out.select("event_type", "n", "p50", "p95", "p99")), "event_type")  # a row for each type, which are few by the table's design
    near = lambda p, q: (F.abs(F.count_if(F.col("cents") <= F.col(p)) / F.first("n") - q) <= evaluate.SKETCH_ERROR).alias(f"{p}_near")
    return out.select("event_type", "n", "sum", "min", "max", "mean").join(met.groupBy("event_type").agg(near("p50", 0.5), near("p95", 0.95), near("p99", 0.99)), "event_type")


def screen_by_table(spark: SparkSession, sf: str) -> DataFrame:
    """Names against a watchlist that is a table: it is broadcast only if it is small."""
    listed = table(spark, sf, "customer").filter("c_acctbal < 0").select(text.watch_key(F.col("c_name")).alias("entry"))
    return flow.screened(table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("\t"), F.upper("c_name"), F.lit(" ")).alias("name")), F.col("name"), listed).select("c_custkey", "flagged", "reason")


def changeset_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages with their values in place: one that isn't given stays as it is."""
    given = F.create_map(F.lit("count"), F.col("p_size").cast("string"), F.lit("kind"), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", state.interpolated(F.lit("%{kind}: at most %{count} of %{count}, %{other}"), given).alias("message"))


def due_work(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as onboardings, their pending orders as attempts, at a time when some of the last ones are too recent."""
    onboardings = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "processing").otherwise("received").alias("status"), F.col("c_acctbal").alias("inserted_at"))
    tried = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("onboarding_id"), (F.to_timestamp(F.lit("2024-01-01 00:00:00")) - F.make_dt_interval(secs=(F.col("o_orderkey") % 40).cast("decimal(18,6)"))).alias("inserted_at"))
    out = intake.due_work(onboardings, tried, F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    return out.select("id", "attempt", F.date_format("due_at", "yyyy-MM-dd HH:mm:ss").alias("due_at"))


def _stream(spark: SparkSession, sf: str, name: str, files: int | None = None) -> DataFrame:
    """A table's files as a stream, in batches of so many files, or all that are there in one batch.

    A pattern, since a table may be one file, which a stream takes by a pattern only.
    """
    reader = spark.readStream.schema(table(spark, sf, name).schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(f"{sf}/{name}.parque[t]")


def stream_callbacks(spark: SparkSession, sf: str) -> DataFrame:
    """Callbacks as a stream into a table, by batches of files."""
    kept = PatchTable(spark, scratch_path(spark, "patches"), buckets=8)
    live.keep(_patches(_stream(spark, sf, "events", 4)), kept, scratch_path(spark, "checkpoint")).awaitTermination()
    return kept.read().select("key", "status", "company_name")


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads as two streams, one after the other, on one ledger: all that the second brings are duplicates or invalid.

    Of equal payloads the first batch's is created, and within a batch that of the least seq. A table's files come in
    no order of seq, so each stream takes what is there as one batch.
    """
    ledger, out = scratch_path(spark, "ledger"), scratch_path(spark, "outcomes")
    for stream in ("first", "second"):
        payloads = workflow._as_payloads(_stream(spark, sf, "documents"))
        live.ingest(payloads, lambda df, number, s=stream: df.select(F.lit(s).alias("stream"), "seq", "result").write.mode("overwrite").parquet(f"{out}/{s}-{number}"), ledger, scratch_path(spark, "checkpoint")).awaitTermination()
    found = spark.read.option("recursiveFileLookup", "true").schema("stream string, seq long, result string").parquet(out)
    return found


def blob_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents' texts stored by their hash, those of one language once more with another content, and read as texts: a byte that isn't UTF-8 is replaced."""
    kept = TableStorage(spark, scratch_path(spark, "blobs"))
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    path = F.concat(F.sha2("text", 256), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    kept.store(docs.select(path.alias("path"), F.col("text").cast("binary").alias("content")))
    kept.store(docs.filter("lang = 'de'").select(path.alias("path"), F.concat(F.col("text").cast("binary"), F.unhex(F.lit("ff"))).alias("content")))
    asked = docs.filter("lang <> 'fr'").select(path.alias("path"))
    read = intake.texts(kept.load(asked))
    return read.select("path", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


def delivered_requests(spark: SparkSession, sf: str) -> DataFrame:
    """A request for every order, sent to a service that takes some, refuses some and doesn't answer others."""

    def send(row: dict) -> int:
        if row["o_orderkey"] % 7 == 0:
            raise ConnectionError("refused")
        return {"F": 202, "O": 503}.get(row["o_orderstatus"], 404)

    requests = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return intake.delivered(requests, send, "o_orderkey").select("o_orderkey", "http_status", "error", "outcome")


def renamed_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table in a schema of its own, renamed, renamed back, and renamed again."""
    name = f"ledger_{uuid.uuid4().hex}"
    intake.create_schema(spark, name, scratch_path(spark, "schema"))
    intake.create_schema(spark, name)
    table(spark, sf, "nation").select("n_nationkey", "n_name").write.saveAsTable(f"{name}.vendor_rows")
    for old, new in (("vendor_rows", "rows"), ("rows", "vendor_rows"), ("vendor_rows", "rows")):
        intake.rename_table(spark, f"{name}.{old}", f"{name}.{new}")
    return spark.table(f"{name}.rows")


QUERIES = {
    f.__name__: f
    for f in (delivered_requests, renamed_table, blob_round_trip, callbacks_without_status, judged_cases, eval_report, split_ingest, ledger_keys, status_transitions, status_after_transitions, snapshot_fold, snapshot_rows, change_feed, thread_decisions, allocated_ids, trapped_steps, metric_rollup, screen_by_table, changeset_messages, due_work, stream_callbacks, stream_ingest)
}

_CASES = "WITH c AS (SELECT d.doc_id, lang, n_chars, CASE WHEN toxic = 1 THEN 'ValueError: toxic' END AS error, CASE WHEN coalesce(toxic, 0) <> 1 THEN quality = 1 END AS match, CASE WHEN lang <> 'de' THEN n_chars > 300 END AS expected FROM documents d LEFT JOIN labels USING (doc_id))"
_H = workflow._INGESTED.rpartition("g AS (SELECT key FROM h")[0].rstrip().rstrip(",")
_SPLIT = _H + ", i AS (SELECT *, seq % 4 AS part, CASE WHEN k < 4 THEN 'invalid_payload' WHEN row_number() OVER (PARTITION BY key, k > 3 ORDER BY seq % 4, seq) > 1 THEN 'duplicate' ELSE 'created' END AS result FROM h)"
_STEPS = """WITH e AS (SELECT event_id, user_id, ts, event_id // 1000 AS attempt, CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'needs_review' WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE CASE WHEN event_id % 2 = 0 THEN 'received' END END AS status FROM events),
l AS (SELECT *, coalesce(status = 'processing' AND count(*) FILTER (status <> 'processing') OVER (PARTITION BY user_id, attempt ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0, false) AS late FROM e),
t AS (SELECT *, NOT late AND status IS NOT NULL AS effect, last_value(CASE WHEN NOT late THEN status END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM l),
r AS (SELECT *, CASE WHEN status IS NULL THEN 'invalid' WHEN late THEN 'late' WHEN (coalesce(previous, 'none'), status) IN (('none', 'received'), ('received', 'processing'), ('processing', 'needs_review'), ('processing', 'approved'), ('processing', 'processing'), ('needs_review', 'approved'), ('needs_review', 'rejected'), ('needs_review', 'processing')) THEN 'step' WHEN previous = status THEN 'same' ELSE 'illegal' END AS result FROM t)
"""
_CELLS = """WITH p AS (SELECT user_id AS key, event_id AS seq, event_type AS kind, 'n' || CAST(round(value * 100) AS BIGINT) AS name FROM events WHERE event_type <> 'signup'),
s AS (SELECT key, seq, CASE kind WHEN 'view' THEN 'processing' WHEN 'error' THEN 'rejected' ELSE 'approved' END AS v FROM p WHERE kind <> 'click'),
n AS (SELECT key, seq, CASE WHEN kind <> 'error' THEN name END AS v FROM p WHERE kind <> 'view'),
"""
_FOLD = _CELLS + """a AS (SELECT key, arg_max_null(v, seq) AS status FROM s GROUP BY key), b AS (SELECT key, arg_max_null(v, seq) AS company_name FROM n GROUP BY key)
SELECT k.key, status, company_name FROM (SELECT DISTINCT key FROM p) k LEFT JOIN a USING (key) LEFT JOIN b USING (key)"""
_APPENDS = ", ".join(f"i{k} AS (SELECT k.key, (SELECT arg_max_null(v, seq) FROM s WHERE s.key = k.key AND seq % 3 IN ({had})) AS status, (SELECT arg_max_null(v, seq) FROM n WHERE n.key = k.key AND seq % 3 IN ({had})) AS company_name, (SELECT count(*) FROM s WHERE s.key = k.key AND seq % 3 IN ({had})) > 0 AS has_s, (SELECT count(*) FROM n WHERE n.key = k.key AND seq % 3 IN ({had})) > 0 AS has_n FROM k)" for k, had in enumerate(("-1", "2", "2, 0", "2, 0, 1")))

ORACLE = {
    "delivered_requests": "SELECT o_orderkey, CAST(CASE WHEN error IS NULL THEN code END AS INTEGER) AS http_status, error, CASE WHEN error IS NOT NULL THEN 'error: ' || error WHEN code = 202 THEN 'ok' ELSE 'unexpected_status: ' || code END AS outcome FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 202 WHEN 'O' THEN 503 ELSE 404 END AS code, CASE WHEN o_orderkey % 7 = 0 THEN 'ConnectionError: refused' END AS error FROM orders)",
    "renamed_table": "SELECT n_nationkey, n_name FROM nation",
    "blob_round_trip": "SELECT sha256(text) || '/' || doc_id || '.txt' AS path, sha256(text || t) AS text_sha256, CAST(length(text || t) AS BIGINT) AS n_chars FROM (SELECT *, CASE WHEN lang = 'de' THEN chr(65533) ELSE '' END AS t FROM documents WHERE lang <> 'fr')",
    "callbacks_without_status": """WITH l AS (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
n AS (SELECT user_id, max(event_id) AS e FROM events WHERE event_id % 4 = 0 GROUP BY 1), a AS (SELECT DISTINCT user_id FROM events WHERE event_id % 4 = 3)
SELECT o.o_orderkey AS id, CASE WHEN a.user_id IS NOT NULL THEN 'approved' WHEN o_orderstatus = 'P' THEN 'needs_review' ELSE 'processing' END AS status, CASE WHEN n.e IS NULL THEN 'old' ELSE 'name ' || n.e END AS company_name
FROM orders o LEFT JOIN l ON l.o_orderkey = o.o_orderkey LEFT JOIN n ON n.user_id = l.o_custkey LEFT JOIN a ON a.user_id = l.o_custkey""",
    "judged_cases": _CASES + " SELECT doc_id, error IS NULL AND match IS NOT NULL AND expected IS NOT NULL AS judge_match, error IS NULL AND match IS NOT NULL AND expected IS NOT NULL AND NOT match AND n_chars % 2 = 0 AS judge_grounding FROM c",
    "eval_report": _CASES + """, v AS (SELECT *, CASE WHEN error IS NULL THEN CASE WHEN match THEN 'approved' ELSE 'needs_review' END END AS decision, CASE WHEN n_chars > 300 THEN 'approved' ELSE 'needs_review' END AS wanted, error IS NULL AND match IS NOT NULL AND expected IS NOT NULL AS judged FROM c),
e AS (SELECT CASE WHEN match = expected THEN 0.75 ELSE 0.25 END AS s FROM v WHERE judged), g AS (SELECT count(*) AS n FROM v WHERE judged AND NOT match AND n_chars % 2 = 0)
SELECT 0 AS part, '' AS key, 'fixture         bucket      decision      expected      entity_match  tax_id_ok  error' AS line
UNION ALL SELECT 1, 'case-' || doc_id, rpad('case-' || doc_id, 16, ' ') || rpad(lang, 12, ' ') || rpad(coalesce(decision, 'None'), 14, ' ') || rpad(wanted, 14, ' ') || rpad(CASE WHEN match THEN 'True' WHEN NOT match THEN 'False' ELSE 'None' END, 14, ' ') || rpad(CASE WHEN error IS NOT NULL THEN 'None' WHEN n_chars % 5 > 0 THEN 'True' ELSE 'False' END, 11, ' ') || coalesce(error, '') FROM v
UNION ALL SELECT 2, '', '' UNION ALL SELECT 4, '', '' UNION ALL SELECT 5, '', '--- LLM-judge tier (Claude Sonnet) ---'
UNION ALL SELECT 3, line, line FROM (SELECT lang || ': decision correct ' || count(*) FILTER (decision = wanted) || '/' || count(*) AS line FROM v GROUP BY lang)
UNION ALL SELECT 6, line, line FROM (SELECT CASE WHEN count(*) > 0 THEN 'entity_match: avg ' || printf('%.2f', avg(s)) || ' (n=' || count(*) || ')' ELSE 'entity_match: no scored cases' END AS line FROM e)
UNION ALL SELECT 6, line, line FROM (SELECT CASE WHEN n > 0 THEN 'groundedness: avg 0.50 (n=' || n || ')' ELSE 'groundedness: no scored cases' END AS line FROM g)
UNION ALL SELECT 6, 'never: no scored cases', 'never: no scored cases'""",
    "split_ingest": _SPLIT + " SELECT CAST(part AS INTEGER) AS k, seq, result FROM i",
    "ledger_keys": _H + " SELECT key AS idempotency_key, CAST(1 AS BIGINT) AS n, CASE WHEN bool_or(seq % 2 = 0) THEN 'a' ELSE 'b' END AS stream FROM h WHERE k > 3 GROUP BY key",
    "status_transitions": _STEPS + "SELECT event_id, previous, status, effect, result FROM r",
    "status_after_transitions": _STEPS + ", w AS (SELECT user_id, status FROM r WHERE effect QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT u.user_id, w.status, n_illegal, n_late FROM (SELECT user_id, count(*) FILTER (result = 'illegal') AS n_illegal, count(*) FILTER (result = 'late') AS n_late FROM r GROUP BY 1) u LEFT JOIN w USING (user_id)",
    "snapshot_fold": _FOLD,
    "snapshot_rows": f"SELECT * FROM ({_FOLD}) WHERE key IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "change_feed": _CELLS + "k AS (SELECT DISTINCT key FROM p), " + _APPENDS + "".join(
        f" {'UNION ALL' if k else ''} SELECT {k} AS append, key, x.status, x.company_name, y.status AS new_status, y.company_name AS new_company_name FROM i{k} x JOIN i{k + 1} y USING (key) WHERE x.status IS DISTINCT FROM y.status OR x.company_name IS DISTINCT FROM y.company_name OR x.has_s <> y.has_s OR x.has_n <> y.has_n" for k in range(3)
    ),
    "thread_decisions": """WITH t AS (SELECT doc_id, n_chars % 3 > 0 AS waits, n_chars FROM documents),
d AS (SELECT doc_id, 0 AS batch, doc_id * 2 AS "at", CASE WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS decision FROM labels UNION ALL SELECT doc_id, 0, doc_id * 2 - doc_id % 2 + 1 - 2 * (doc_id % 2), CASE WHEN toxic = 1 THEN 'maybe' ELSE 'rejected' END FROM labels UNION ALL SELECT doc_id, 1, doc_id, 'approved' FROM documents),
g AS (SELECT d.*, waits, n_chars, decision <> 'maybe' AND waits AS good FROM d JOIN t USING (doc_id)),
w AS (SELECT *, good AND row_number() OVER (PARTITION BY doc_id, good ORDER BY batch, "at", decision) = 1 AS won FROM g)
SELECT batch, 'onboarding-' || doc_id AS thread_id, "at", decision, CASE WHEN decision = 'maybe' THEN 'invalid_decision' WHEN won THEN 'ok' ELSE 'not_awaiting_review' END AS result, CASE WHEN won THEN 'e' || n_chars END AS explanation, CAST(CASE WHEN waits THEN 1 ELSE 0 END AS BIGINT) AS n_callbacks FROM w""",
    "allocated_ids": "SELECT o_orderkey, 100 + row_number() OVER (ORDER BY o_orderstatus <> 'O', o_orderkey) AS id FROM orders",
    "trapped_steps": """SELECT c_custkey, CASE WHEN error IS NULL THEN CASE WHEN c_custkey % 4 > 0 AND NOT c_name LIKE '%5' THEN 'approved' ELSE 'needs_review' END END AS decision, error, CASE WHEN error IS NULL THEN c_name LIKE '%5' END AS flagged
FROM (SELECT *, CASE WHEN c_name LIKE '%0000007%' THEN 'ValueError: simulated extraction failure' WHEN c_name LIKE '%3' THEN 'LookupError: no answer for ' || c_name END AS error FROM customer)""",
    "metric_rollup": "SELECT event_type, count(c) AS n, CAST(sum(c) AS BIGINT) AS sum, min(c) AS min, max(c) AS max, avg(c) AS mean, true AS p50_near, true AS p95_near, true AS p99_near FROM (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS c FROM events) GROUP BY event_type",
    "screen_by_table": "SELECT c_custkey, c_acctbal < 0 AS flagged, CASE WHEN c_acctbal < 0 THEN 'Matched sanctions watchlist entry' END AS reason FROM customer",
    "changeset_messages": "SELECT p_partkey, p_type || ': at most ' || p_size || ' of ' || p_size || ', %{other}' AS message FROM part",
    "due_work": """WITH r AS (SELECT o_custkey, count(*) AS n, min(o_orderkey % 40) AS ago FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT c_custkey AS id, coalesce(n, 0) + 1 AS attempt, strftime(TIMESTAMP '2024-01-01' + to_seconds(CAST(15 + 2 ** n - ago AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS due_at FROM customer LEFT JOIN r ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' AND coalesce(n, 0) < 5 AND (n IS NULL OR 15 + 2 ** n <= ago)""",
    "stream_callbacks": _FOLD,
    "stream_ingest": _H + ", i AS (SELECT seq, CASE WHEN k < 4 THEN 'invalid_payload' WHEN row_number() OVER (PARTITION BY key, k > 3 ORDER BY seq) > 1 THEN 'duplicate' ELSE 'created' END AS result FROM h) SELECT 'first' AS stream, seq, result FROM i UNION ALL SELECT 'second', seq, CASE WHEN result = 'invalid_payload' THEN result ELSE 'duplicate' END FROM i",
}
