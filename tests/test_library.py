"""Expressions, ingest, flow, state and live paths on literal rows."""

import base64
import json
from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from ledgerfold.functions import payload, text
from ledgerfold.operators import evaluate, flow, reads, runs, state, verbatim
from ledgerfold.plans import registry
from ledgerfold.sources import fixtures, intake
from ledgerfold.streaming import live


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_identifiers(spark):
    values = {"12-3456789": True, "\t12-3456789\n": True, " 12-3456789 ": True, "١٢-3456789": True, "not-an-ein": False, "": False, "12-34567890": False}
    rows = spark.createDataFrame([(k,) for k in values], "v string").select("v", text.ein_valid(F.col("v")).alias("ok")).collect()
    assert {r["v"]: r["ok"] for r in rows} == values


def test_names_and_verbatim(spark):
    assert one(spark, text.names_match(F.col("a"), F.col("b")), a="J&K Supplies", b="J and K Supplies, LLC")
    assert one(spark, text.names_match(F.col("a"), F.col("b")), a="", b=" Inc.")
    assert not one(spark, text.names_match(F.col("a"), F.col("b")), a="Nova", b="Stellar")
    assert not one(spark, text.verbatim(F.col("a"), F.col("b")), a="  ", b="text")
    assert one(spark, text.verbatim(F.col("a"), F.col("b")), a=" ex ", b="text ex")
    assert one(spark, text.same_name(F.col("a"), F.col("b")), a=" ACME ", b="acme")


def test_strict_decoding(spark):
    good = json.dumps({"contract": base64.b64encode(b"hello").decode(), "n": 12, "z": None})
    assert one(spark, payload.strict_base64(payload.json_text(F.col("j"), "contract")), j=good) == b"hello"
    for key in ("n", "z", "missing"):
        assert one(spark, payload.json_text(F.col("j"), key), j=good) is None
    for bad in ("YQ", "Y Q==", "!!!!", "YQ==\n"):
        assert one(spark, payload.strict_base64(F.col("b")), b=bad) is None


def test_encryption(spark):
    key = F.lit("0123456789abcdef0123456789abcdef").cast("binary")
    df = spark.createDataFrame([("12-3456789",), (None,)], "v string").select("v", payload.encrypted(F.col("v"), key).alias("e"))
    rows = df.select("v", "e", payload.decrypted(F.col("e"), key).alias("d")).collect()
    assert all(r["v"] == r["d"] for r in rows) and b"3456789" not in bytes(rows[0]["e"])


def body(contract=b"c", w9=b"w"):
    return json.dumps({"contract": base64.b64encode(contract).decode(), "w9": base64.b64encode(w9).decode()}).encode()


def test_ingest(spark):
    known = spark.createDataFrame([(bytearray(body(b"old")),)], "raw binary").select(payload.content_hash(F.col("raw")).alias("idempotency_key"))
    rows = [(1, body()), (2, body()), (3, b"not json"), (4, b"{}"), (5, body(b"old")), (6, body(b"new")), (7, b"not json"), (8, b"not json")]
    out = intake.ingest(spark.createDataFrame([(s, bytearray(r)) for s, r in rows], "seq long, raw binary"), known)
    found = {r["seq"]: r for r in out.collect()}
    assert {k: v["result"] for k, v in found.items()} == {1: "created", 2: "duplicate", 3: "invalid_payload", 4: "invalid_payload", 5: "duplicate", 6: "created", 7: "invalid_payload", 8: "invalid_payload"}
    assert bytes(found[6]["contract"]) == b"new" and found[6]["document_paths"]["w9"].endswith("/w9.pdf") and found[3]["document_paths"] is None
    made = intake.new_onboardings(out, 10, datetime(2024, 1, 1)).orderBy("id").collect()
    assert [r["id"] for r in made] == [11, 12] and made[0]["status"] == "received"


def test_numbered(spark):
    rows = [(i * 37 % 101,) for i in range(101)] + [(5,), (5,)]
    got = intake.numbered(spark.createDataFrame(rows, "k long"), "k", 11, pieces=7).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(11, 11 + len(rows))) and [r["k"] for r in got] == sorted(k for k, in rows)
    assert intake.numbered(spark.createDataFrame([], "k long"), "k").count() == 0


def test_blobs_and_documents(spark, tmp_path):
    blobs = spark.createDataFrame([("a/contract.pdf", bytearray(b"x\xffy")), ("a/w9.pdf", bytearray(b"z")), ("a/none.pdf", bytearray(b""))], "path string, content binary")
    intake.store_blobs(blobs, str(tmp_path / "blobs"))
    intake.store_blobs(blobs.filter("path like '%w9%'").withColumn("content", F.lit("new").cast("binary")), str(tmp_path / "blobs"))
    assert {r["path"]: r["text"] for r in intake.texts(intake.load_blobs(spark, str(tmp_path / "blobs"))).collect()} == {"a/contract.pdf": "x\ufffdy", "a/w9.pdf": "new", "a/none.pdf": ""}
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.txt").write_bytes(b"x\xffy")
    assert [r["text"] for r in intake.read_documents(spark, str(tmp_path / "files")).collect()] == ["x\ufffdy"]


def test_work_list_and_delivery(spark):
    t = datetime(2024, 1, 1)
    on = spark.createDataFrame([(1, "received", t), (2, "received", t), (3, "approved", t), (4, "received", t)], "id long, status string, inserted_at timestamp")
    ran = spark.createDataFrame([(2,), (4,), (4,)], "onboarding_id long")
    assert [(r["id"], r["attempt"]) for r in intake.pending_work(on, ran).collect()] == [(1, 1)]
    assert [(r["id"], r["attempt"]) for r in intake.pending_work(on, ran, 3).orderBy("id").collect()] == [(1, 1), (2, 2), (4, 3)]
    assert [r["id"] for r in intake.pending_work(on, ran, 5, width=2).collect()] == [1, 2]

    def send(row):
        if row["id"] == 2:
            raise TimeoutError("late")
        return 202 if row["id"] == 1 else 500

    answers = intake.delivered(intake.pending_work(on, ran, 5).select("id", "attempt"), send, "id")
    said = {r["id"]: r["outcome"] for r in answers.collect()}
    assert said == {1: "ok", 2: "error: TimeoutError: late", 4: "unexpected_status: 500"}
    after = {r["onboarding_id"]: (r["run_status"], r["onboarding_status"]) for r in runs.triggered(intake.pending_work(on, ran, 5), answers).collect()}
    assert after == {1: ("processing", "processing"), 2: ("processing", "received"), 4: ("processing", "received")}


def test_requests(spark):
    forms = {'{"onboarding_id": 5, "thread_id": "t", "decision": "approved"}': [], '{"onboarding_id": 5.0, "thread_id": "t", "decision": "x"}': [], '{"onboarding_id": 5.5, "thread_id": "t", "decision": "x"}': ["onboarding_id: should be integer"], '{"onboarding_id": true, "thread_id": 7}': ["onboarding_id: should be integer", "thread_id: should be string", "decision: field required"], "5": ["body: should be a JSON object"], None: ["body: should be a JSON object"]}
    out = runs.accepted(spark.createDataFrame([(k,) for k in forms], "raw string"), runs.RESUME).collect()
    assert {r["raw"]: r["errors"] for r in out} == forms and {r["http_status"] for r in out} == {202, 422}


def test_run_pauses_and_resumes(spark, tmp_path):
    """A paused thread outlives its run: the log is a table, and a decision takes it up once."""
    contract, w9 = fixtures.CONTRACT.format("Acme", "a", "b"), fixtures.W9.format("Else", "12-3456789")
    docs = spark.createDataFrame([("c", contract), ("w", w9), ("v", fixtures.W9.format("Acme", "12-3456789"))], "path string, text string")
    work = spark.createDataFrame([(1, {"contract": "c", "w9": "w"}), (2, {"contract": "c", "w9": "v"}), (3, {"contract": "c", "w9": "gone"})], "id long, document_paths map<string,string>")
    out = flow.run(work, docs).cache()
    by = {r["onboarding_id"]: r for r in out.collect()}
    assert by[1]["next"] == "flag_for_review" and by[1]["patch"]["status"] == "needs_review" and "'Acme'" in by[1]["patch"]["explanation"] and by[1]["patch"]["thread_id"] == "onboarding-1"
    assert by[2]["patch"]["status"] == "approved" and by[2]["next"] is None
    assert by[3]["patch"] is None and by[3]["error"] == "ExtractionError: w9"
    intake.append(out.filter("error is null").select("thread_id", F.lit(1).cast("long").alias("seq"), "next", "state"), str(tmp_path / "log"))
    log = lambda: spark.read.parquet(str(tmp_path / "log"))
    decisions = spark.createDataFrame([("onboarding-1", "rejected"), ("onboarding-2", "approved"), ("onboarding-9", "approved"), ("onboarding-1", "perhaps")], "thread_id string, decision string")
    first = flow.resumed(log(), decisions).cache()
    assert sorted((r["thread_id"], r["result"]) for r in first.collect()) == [("onboarding-1", "invalid_decision"), ("onboarding-1", "ok"), ("onboarding-2", "not_awaiting_review"), ("onboarding-9", "not_found")]
    patch = first.filter("result = 'ok'").first()["patch"]
    assert patch == {"status": "rejected", "explanation": by[1]["patch"]["explanation"]}
    intake.append(first.filter("result = 'ok'").select("thread_id", F.col("seq").cast("long"), "next", "state"), str(tmp_path / "log"))
    again = flow.resumed(log(), decisions.filter("decision = 'rejected'")).first()
    assert again["result"] == "not_awaiting_review"


def test_replaced_steps_and_graph(spark):
    """A step and a whole graph can be replaced; scores come from given scorers."""
    steps = flow.Steps(match_names=text.same_name, explain=lambda f: F.concat(F.lit("drafted: "), f), tax_valid=lambda c: F.lit(True))
    run = evaluate.run_all(fixtures.cases(spark), lambda c: flow.validate_documents(c, steps))
    rows = {r["id"]: r for r in run.collect()}
    assert rows["formatting-01"]["decision"] == "needs_review" and rows["formatting-01"]["explanation"].startswith("drafted: Entity")
    assert rows["malformed-01"]["decision"] == "approved" and rows["clean-01"]["thread_id"] == "eval-clean-01"
    scores = evaluate.scored(evaluate.judged(run), {"entity": (F.col("judge_match"), F.when(F.col("match") == F.col("expected_entity_match"), 0.9).otherwise(0.1))})
    assert scores.filter("passed").count() == 15 and scores.count() == 18
    assert evaluate.scored(run, {}).count() == 0


def test_tables(spark):
    intake.create_schema(spark, "ledger_test")
    spark.sql("DROP TABLE IF EXISTS ledger_test.new_name")
    spark.range(3).write.mode("overwrite").saveAsTable("ledger_test.old_name")
    intake.rename_table(spark, "ledger_test.old_name", "ledger_test.new_name")
    assert spark.table("ledger_test.new_name").count() == 3


def test_flow_on_cases(spark):
    run = flow.validate_documents(fixtures.cases(spark)).cache()
    assert run.filter("decision = expected_decision").count() == 20
    assert run.filter("expected_entity_match is not null and match <> expected_entity_match").count() == 0
    counts = evaluate.judged(run).agg(F.count_if("judge_match").alias("m"), F.count_if("judge_grounding").alias("g")).first()
    assert (counts["m"], counts["g"]) == (18, 5)
    patches = flow.result_patch(run.withColumn("onboarding_id", F.lit(7))).collect()
    assert {len(r["patch"]) for r in patches} == {6, 8}


def test_flow_findings_and_errors(spark):
    rows = [
        ("watched", fixtures.CONTRACT.format("Rogue Exports LLC", "a", "b"), fixtures.W9.format("Else", "x")),
        ("w9 watched", fixtures.CONTRACT.format("Acme", "a", "b"), fixtures.W9.format("North Star Trading Co", "12-3456789")),
        ("broken", "nothing", fixtures.W9.format("Acme", "12-3456789")),
        ("null", None, None),
    ]
    out = {r["id"]: r for r in flow.validate_documents(spark.createDataFrame(rows, "id string, contract_text string, w9_text string")).collect()}
    assert out["watched"]["findings"].count("; ") == 2 and out["watched"]["flagged"]
    assert not out["w9 watched"]["flagged"]
    assert out["broken"]["decision"] is None and "contract" in out["broken"]["error"] and out["null"]["error"]


def test_callbacks(spark):
    t = datetime(2024, 1, 1)
    before = spark.createDataFrame([(1, 5, "processing", "t1", "Old", None, None, None, None, None, t, t), (2, 5, "processing", None, "Kept", None, None, None, None, "why", t, t)], intake.RUNS)
    calls = [(5, 1, {"status": "needs_review", "thread_id": "t2", "junk": "x"}), (5, 2, {"status": "approved", "explanation": None}), (6, 3, {"status": "approved"}), (None, 4, {"status": "approved"}), (5, 5, {"status": "maybe"})]
    events = spark.createDataFrame(calls, "onboarding_id long, seq long, patch map<string,string>")
    results = {r["seq"]: r["result"] for r in state.latest_run_targets(events, before).collect()}
    assert results == {1: "ok", 2: "ok", 3: "not_found", 4: "invalid", 5: "invalid"}
    after = {r["id"]: r for r in state.apply_callbacks(before, events, ["seq"]).collect()}
    assert after[1]["status"] == "processing"  # only the latest run changes
    assert (after[2]["status"], after[2]["thread_id"], after[2]["company_name"], after[2]["explanation"]) == ("approved", "t2", "Kept", None)
    timed = events.withColumn("at", F.expr("timestamp'2024-02-01' + make_interval(0, 0, 0, int(seq))"))
    when = {r["id"]: r["updated_at"] for r in state.apply_callbacks(before, timed, ["seq"], "at").collect()}
    assert when == {1: t, 2: datetime(2024, 2, 3)}
    unchanged = timed.filter("false").union(spark.createDataFrame([(5, 9, {"status": "processing"}, t)], timed.schema))
    assert {r["updated_at"] for r in state.apply_callbacks(before, unchanged, ["seq"], "at").collect()} == {t}


def test_guards(spark):
    row = spark.createDataFrame([(None, "x")], "a string, b string").select(state.required(("a", "b")).alias("e"), state.status_errors(F.col("b")).alias("s")).first()
    assert row["e"] == {"a": ["can't be blank"]} and row["s"] == "is invalid"


def test_review_and_report(spark):
    t = datetime(2024, 1, 1)
    own = spark.createDataFrame([(1, 5, "approved", "t", "A", "B", bytearray(b"12-3456789"), "p", "l", "why", t, t)], intake.RUNS)
    assert {(r["field"], r["contract"], r["w9"], r["agent"]) for r in reads.review(own).collect()} == {("company_name", "A", "B", None), ("payment_terms", "p", None, None), ("liability_clauses", "l", None, None), ("tax_id", None, "12-3456789", None), ("explanation", None, None, "why")}
    lines = evaluate.report(spark.createDataFrame([("clean", 10)], "bucket string, n int"), {"bucket": 8, "n": 3}).collect()
    assert lines[0]["line"] == "clean    10"
    assert evaluate.metrics(spark.createDataFrame([("r", 1.0), ("r", 3.0)], "route string, ms double"), "ms", "route").first()["mean"] == 2.0


def test_percentiles_are_exact(spark):
    """60,000 distinct values of one tag, in no order; a null tag; a tag without values."""
    rows = spark.range(60_000).select(F.lit("r").alias("route"), F.pmod(F.col("id") * 7919, F.lit(60_000)).alias("ms"))
    rows = rows.union(spark.createDataFrame([(None, 5), (None, 7), ("none", None), ("r", None)], "route string, ms long"))
    out = {r["route"]: (r["n"], r["percentiles"]) for r in evaluate.metrics(rows, "ms", "route").collect()}
    assert out == {"r": (60_000, [29_999, 56_999, 59_399]), None: (2, [5, 7, 7]), "none": (0, None)}
    assert evaluate.metrics(rows, "ms").first()["percentiles"] == [29_998, 56_999, 59_399]


def test_live_paths(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    for i, rows in enumerate(([("a", 1, "x"), ("b", 2, "x")], [("a", 3, "y"), ("a", 1, "x")])):
        spark.createDataFrame(rows, "raw string, seq long, status string").withColumn("raw", F.col("raw").cast("binary")).coalesce(1).write.mode("append").parquet(str(folder))
    read = lambda: spark.readStream.schema("raw binary, seq long, status string").parquet(str(folder))
    q = live.deduplicated(read()).writeStream.format("memory").queryName("unique_payloads").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("unique_payloads").count() == 2
    current = live.current_status(read().withColumn("id", F.col("raw").cast("string")), "id", ["seq"], "status")
    live.publish(current, lambda df, _: seen.extend(tuple(r) for r in df.collect()), str(tmp_path / "c2"), "a").awaitTermination()
    assert seen[-1] == ("a", "y") and all(k == "a" for k, _ in seen)


def test_stream_of_payloads(spark, tmp_path):
    """Payloads as files, in batches: duplicates are known across batches and restarts, invalid ones stay invalid."""
    seen = {}

    def send(rows, name):
        spark.createDataFrame([(s, bytearray(r)) for s, r in rows], "seq long, raw binary").coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = spark.readStream.schema("seq long, raw binary").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        live.ingest(stream, lambda df, _: seen.update({r["seq"]: r["result"] for r in df.collect()}), str(tmp_path / "ledger"), str(tmp_path / "at")).awaitTermination()

    send([(1, body()), (2, body()), (3, b"not json")], "a")
    send([(4, body()), (5, b"not json"), (6, body(b"new"))], "b")
    assert seen == {1: "created", 2: "duplicate", 3: "invalid_payload", 4: "duplicate", 5: "invalid_payload", 6: "created"}


def test_verbatim_check_at_neighbours_and_short_items(spark, tmp_path):
    """Against the query's SQL: items after a quote or a bracket, of few words, and within words."""
    long, ten = " ".join(f"w{i}" for i in range(20)), " ".join(f"t{i}" for i in range(10))
    items = [(1, long), (2, f" {ten}\n".rstrip("\n")), (3, "one two three four"), (4, "lone"), (5, " ".join(f"n{i}" for i in range(9))), (6, ""), (7, None), (8, "absent words that nobody wrote")]
    docs = [(1, f'before "{long}" after'), (2, f"before ({ten})after and more words to make it long"), (3, f"pre-{long}s"), (4, "it says:one two three fourteen times over and over and over again"), (5, "a" + "lone" + "ly " + "word " * 30), (6, "x" + items[4][1] + "y " + "word " * 30), (7, None), (8, ""), (9, long.replace(" w9 ", "  w9 ")), (10, ten)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    for name in ("benchmark", "documents"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(db.execute(registry.ORACLE["verbatim_check"]).fetchall())
    assert want == [(1, 1), (2, 2), (3, 1), (4, 3), (5, 4), (6, 5), (10, 2)]
    assert sorted(tuple(r) for r in registry.QUERIES["verbatim_check"](spark, str(tmp_path)).collect()) == want


def test_short_items_are_not_joined_by_their_common_words(spark):
    """Items of up to five words meet no text by the few words between their first and last; longer ones are looked up."""
    docs = spark.createDataFrame([(i, f"x{i} of the y{i} and of the z") for i in range(50)] + [(50, None), (51, "")], "doc_id long, text string")
    short = [(i, f"x{i} of the") for i in range(50)] + [(60, "8 of the y8 and"), (61, " of\tthe "), (62, "of the z")]
    found = verbatim.verbatim_pairs(docs, spark.createDataFrame(short, "item_id long, text string"))
    assert "Join" not in plan_text(found)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = sorted((d, i) for d, t in texts.items() for i, x in short if x.strip() in t)
    assert sorted(tuple(r) for r in found.collect()) == want
    longer = verbatim.verbatim_pairs(docs, spark.createDataFrame([(70, "f the y9 and of the z"), (71, "x9 of the")], "item_id long, text string"))
    assert sorted(tuple(r) for r in longer.collect()) == [(9, 70), (9, 71)]


def plan_text(df):
    return df._jdf.queryExecution().optimizedPlan().toString()
