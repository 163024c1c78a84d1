"""What lives on between runs: several writers, restarts, any order and cut of batches, failures of single rows."""

import random
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import evaluate, flow, reads, state, transitions
from ledgerfold.operators.snapshots import PatchTable, Subscriber
from ledgerfold.operators.threads import ThreadLog
from ledgerfold.plans import lifecycle
from ledgerfold.sources import fixtures, intake, ranges, storage
from ledgerfold.sources.buckets import Conflict, Ids, Versions
from ledgerfold.streaming import live
from ledgerfold.streaming.ledger import Ledger

from test_library import body


def plan_of(df):
    return df._jdf.queryExecution().toString()


# Ledger


def payloads(spark, rows):
    return spark.createDataFrame([(s, bytearray(r)) for s, r in rows], "seq long, raw binary")


def test_second_stream_on_one_ledger(spark, tmp_path):
    """A new checkpoint begins at batch 0 again: it adds to the ledger and finds what the first stream has created."""
    seen = {}

    def stream(name, rows):
        payloads(spark, rows).coalesce(1).write.parquet(str(tmp_path / name / "1"))
        source = spark.readStream.schema("seq long, raw binary").option("recursiveFileLookup", "true").parquet(str(tmp_path / name))
        live.ingest(source, lambda df, _: seen.update({r["seq"]: r["result"] for r in df.collect()}), str(tmp_path / "ledger"), str(tmp_path / f"at-{name}")).awaitTermination()

    stream("x", [(1, body(b"a")), (2, body(b"b"))])
    stream("y", [(3, body(b"a")), (4, body(b"c"))])
    assert seen == {1: "created", 2: "created", 3: "duplicate", 4: "created"}
    assert Ledger(spark, str(tmp_path / "ledger")).keys().count() == 3


def test_failed_batch_is_decided_alike(spark, tmp_path):
    """The receiver fails after the keys are in the ledger: the restarted stream gives the batch's own outcomes again."""
    payloads(spark, [(1, body(b"a")), (2, body(b"a"))]).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    seen = []

    def once(df, number):
        seen.append({r["seq"]: r["result"] for r in df.collect()})
        if len(seen) == 1:
            raise InterruptedError

    for _ in range(2):
        source = spark.readStream.schema("seq long, raw binary").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        try:
            live.ingest(source, once, str(tmp_path / "ledger"), str(tmp_path / "at")).awaitTermination()
        except Exception as e:
            assert "InterruptedError" in str(e)
    assert seen == [{1: "created", 2: "duplicate"}] * 2 and Ledger(spark, str(tmp_path / "ledger")).keys().count() == 1


def test_ledger_writers_at_once(spark, tmp_path, monkeypatch):
    """Another writer commits between a batch's decision and its commit: the batch is decided anew."""
    one, two = Ledger(spark, str(tmp_path / "l")), Ledger(spark, str(tmp_path / "l"))
    commit, first = Versions.commit, []

    def late(self, expected, after):
        if not first:
            first.append(1)
            two.ingest(payloads(spark, [(10, body(b"a")), (11, body(b"z"))]), "two", 0)
        return commit(self, expected, after)

    monkeypatch.setattr(Versions, "commit", late)
    out = one.ingest(payloads(spark, [(1, body(b"a")), (2, body(b"b"))]), "one", 0)
    assert {r["seq"]: r["result"] for r in out.collect()} == {1: "duplicate", 2: "created"}
    assert {(r["stream"], r["n"]) for r in one.table.rows(one.table.versions.latest()[1]["folders"]).groupBy("stream").agg(F.count("*").alias("n")).collect()} == {("one", 1), ("two", 2)}


def test_ledger_reads_touched_buckets_and_compacts(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "l"), buckets=16, most_parts=4)
    for k in range(5):
        book.ingest(payloads(spark, [(100 * k + i, body(f"{k} {i}".encode())) for i in range(40)]), "s", k)
    _, at = book.table.versions.latest()
    assert at["parts"] <= 4 and at["left"] and book.keys().count() == 200
    asked = spark.createDataFrame([(r["idempotency_key"],) for r in book.keys().limit(1).collect()], "idempotency_key string")
    touched = book.table.touched(asked)
    read = book.keys(touched)
    assert len(touched) == 1 and {f.split("bucket=")[1].split("/")[0] for f in read.inputFiles()} == {str(touched[0])}
    book.vacuum()
    assert book.keys().count() == 200 and not book.table.versions.latest()[1]["left"]
    out = book.ingest(payloads(spark, [(1000, body(b"3 7"))]), "t", 0)
    assert out.first()["result"] == "duplicate"


def test_versions_are_written_once(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    assert v.latest() == (0, {}) and v.commit(0, {"a": "é"}) == 1 and v.latest() == (1, {"a": "é"})
    with pytest.raises(Conflict):
        v.commit(0, {"a": 2})
    assert v.change(lambda n, s: s | {"b": n}) == 2 and v.latest()[1] == {"a": "é", "b": 1}
    assert v.change(lambda n, s: None) == 2
    for _ in range(5):
        v.change(lambda n, s: s)
    v.prune(2)
    assert v.numbers() == [6, 7]


# Patches


def patches(n, seed):
    r = random.Random(seed)
    return [(r.randrange(12), i, {f: r.choice([None, f"v{i}", "w"]) for f in r.sample(["status", "company_name", "junk", "explanation"], r.randrange(1, 4))}) for i in range(n)]


def expected(rows, fields):
    out = {}
    for key, _, patch in sorted(rows, key=lambda x: x[1]):
        for f, v in patch.items():
            if f in fields:
                out.setdefault(key, {})[f] = v
    return out


PATCHES = "key long, seq long, patch map<string,string>"
THREE = ("status", "company_name", "explanation")


@pytest.mark.parametrize("seed", [1, 2])
def test_patch_table_in_any_order_and_cut(spark, tmp_path, seed):
    rows, r = patches(300, seed), random.Random(seed)
    want = expected(rows, THREE)
    mixed = rows[:]
    r.shuffle(mixed)
    kept = PatchTable(spark, str(tmp_path / "t"), fields=THREE, buckets=4)
    at = 0
    while at < len(mixed):
        n = r.randrange(1, 120)
        kept.append(spark.createDataFrame(mixed[at : at + n], PATCHES), f"b{at}")
        if r.random() < 0.5:
            kept.compact()
        kept = PatchTable(spark, str(tmp_path / "t"), fields=THREE, buckets=4)  # as after a restart
        at += n
    got = {x["key"]: {f: x[f] for f in THREE} for x in kept.read().collect()}
    assert got == {k: {f: v.get(f) for f in THREE} for k, v in want.items()}
    folded = state.fold_patches(spark.createDataFrame(rows, PATCHES), "key", ["seq"], THREE).collect()
    assert {x["key"]: {f: x[f] for f in THREE} for x in folded if x["key"] in got} == got
    few = kept.read(spark.createDataFrame([(3,), (99,)], "key long")).collect()
    assert [x["key"] for x in few] == ([3] if 3 in got else [])


def test_compaction_rewrites_touched_buckets_only(spark, tmp_path):
    kept = PatchTable(spark, str(tmp_path / "t"), buckets=8)
    kept.append(spark.createDataFrame([(k, 1, {"status": "processing"}) for k in range(200)], PATCHES))
    assert len(kept.compact()) == 8
    before = kept.table.versions.latest()[1]["snapshot"]
    kept.append(spark.createDataFrame([(5, 2, {"status": "approved"})], PATCHES))
    touched = kept.compact()
    after = kept.table.versions.latest()[1]["snapshot"]
    assert len(touched) == 1 and {b for b in before if before[b] != after[b]} == {str(touched[0])}
    assert kept.compact() == [] and kept.read().filter("status = 'approved'").count() == 1
    assert kept.append(spark.createDataFrame([], PATCHES)) == kept.table.versions.latest()[0]


def test_feed_is_taken_once_whatever_stops_it(spark, tmp_path):
    kept = PatchTable(spark, str(tmp_path / "t"), buckets=4)
    for k, rows in enumerate([[(1, 1, {"status": "processing"}), (2, 1, {"status": "processing"})], [(1, 2, {"status": "needs_review"})], [(1, 2, {"status": "needs_review"})], [(1, 0, {"status": "rejected"}), (2, 3, {"status": "approved"})]]):
        kept.append(spark.createDataFrame(rows, PATCHES), f"b{k}")
    want = [(1, {}, {"status": "processing"}), (2, {}, {"status": "processing"}), (1, {"status": "processing"}, {"status": "needs_review"}), (2, {"status": "processing"}, {"status": "approved"})]
    rows = lambda df: [(r["key"], r["before"], r["after"]) for r in df.orderBy("version", "key").collect()]
    assert rows(kept.changes()) == want and rows(kept.changes(after=2)) == want[3:]
    fails = iter([True, False, True, False, False, False, False])

    def receive(df, version):
        df.write.mode("overwrite").parquet(str(tmp_path / "s" / "taken" / str(version)))
        if next(fails):
            raise InterruptedError

    for _ in range(3):
        try:
            Subscriber(kept, str(tmp_path / "s")).follow(receive)
        except InterruptedError:
            pass
    own = Subscriber(kept, str(tmp_path / "s"))
    assert rows(own.take()) == want and own.position() == 4
    kept.append(spark.createDataFrame([(7, 9, {"status": "approved"})], PATCHES))
    only = Subscriber(kept, str(tmp_path / "one"), F.col("key") == 2)
    assert rows(only.take()) == [want[1], want[3]]
    assert [v for v, _ in own._next()] == [5]


@pytest.mark.parametrize("seed", [3, 4])
def test_streams_of_callbacks(spark, tmp_path, seed):
    """A keyed state in RocksDB and a kept table give the fold of all callbacks, in any order and cut, over a restart."""
    r = random.Random(seed)
    statuses = ["processing", "approved", None, " ", "maybe"]
    rows = [(r.randrange(8) if i % 9 else None, i, {f: (r.choice(statuses) if f == "status" else r.choice([None, f"v{i}"])) for f in r.sample(["status", "company_name", "junk"], r.randrange(1, 4))}) for i in range(200)]
    good = [x for x in rows if x[0] is not None and x[2].get("status", "approved") in ("processing", "approved")]
    want = {k: {f: v.get(f) for f in THREE} for k, v in expected(good, THREE).items()}
    mixed = rows[:]
    r.shuffle(mixed)
    schema, seen = "onboarding_id long, seq long, patch map<string,string>", {}
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    live.use_rocksdb(spark)
    try:
        for part in (mixed[:70], mixed[70:80], mixed[80:]):  # each is a run of its own: both streams stop and go on
            spark.createDataFrame(part, schema).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
            source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            live.publish(live.folded(source(), THREE), lambda df, _: seen.update({x["onboarding_id"]: {f: x[f] for f in THREE} for x in df.collect()}), str(tmp_path / "c1")).awaitTermination()
            live.keep(source(), PatchTable(spark, str(tmp_path / "kept"), fields=THREE, buckets=4), str(tmp_path / "c2"), compact_every=3).awaitTermination()
    finally:
        spark.conf.set(provider, before)
    assert {k: v for k, v in seen.items() if k in want} == want
    got = {x["key"]: {f: x[f] for f in THREE} for x in PatchTable(spark, str(tmp_path / "kept"), fields=THREE, buckets=4).read().collect()}
    assert got == want


def test_callbacks_without_a_status(spark):
    t = datetime(2024, 1, 1)
    before = spark.createDataFrame([(1, 5, "needs_review", "t1", "Old", None, None, None, None, None, t, t)], intake.RUNS)
    calls = [(5, 1, {"company_name": "New"}), (5, 2, {"company_name": "No", "status": None}), (5, 3, {"company_name": "No", "status": " "}), (5, 4, {"junk": "x"})]
    events = spark.createDataFrame(calls, "onboarding_id long, seq long, patch map<string,string>").withColumn("at", F.expr("timestamp'2024-02-01' + make_interval(0, 0, 0, int(seq))"))
    assert {r["seq"]: (r["result"], r["errors"]) for r in state.latest_run_targets(events, before).collect()} == {1: ("ok", []), 2: ("invalid", ["status: can't be blank"]), 3: ("invalid", ["status: can't be blank"]), 4: ("ok", [])}
    after = state.apply_callbacks(before, events, ["seq"], "at").first()
    assert (after["status"], after["company_name"], after["updated_at"]) == ("needs_review", "New", datetime(2024, 2, 2))


# Threads


def test_pause_survives_and_one_decision_wins(spark, tmp_path, monkeypatch):
    """A run pauses; another process, knowing the folder only, resumes it. Of two writers with a decision each one wins."""
    contract, w9 = fixtures.CONTRACT.format("Acme", "a", "b"), fixtures.W9.format("Else", "12-3456789")
    docs = spark.createDataFrame([("c", contract), ("w", w9), ("v", fixtures.W9.format("Acme", "12-3456789"))], "path string, text string")
    work = spark.createDataFrame([(1, {"contract": "c", "w9": "w"}), (2, {"contract": "c", "w9": "v"}), (3, {"contract": "c", "w9": "gone"})], "id long, document_paths map<string,string>")
    ThreadLog(spark, str(tmp_path / "log")).pause(flow.run(work, docs), "run-1")
    ThreadLog(spark, str(tmp_path / "log")).pause(flow.run(work, docs), "run-1")  # the run is repeated
    paused = {r["thread_id"]: (r["seq"], r["next"]) for r in ThreadLog(spark, str(tmp_path / "log")).states().collect()}
    assert paused == {"onboarding-1": (1, "flag_for_review"), "onboarding-2": (1, None)}
    one, two = ThreadLog(spark, str(tmp_path / "log")), ThreadLog(spark, str(tmp_path / "log"))
    commit, first, said = Versions.commit, [], {}
    asked = lambda d: spark.createDataFrame([("onboarding-1", d, 1), ("onboarding-9", d, 1), ("onboarding-2", d, 1)], "thread_id string, decision string, at long")

    def late(self, expected, after):
        if not first:
            first.append(1)
            said["two"] = {r["thread_id"]: r["result"] for r in two.decide(asked("rejected"), "two").collect()}
        return commit(self, expected, after)

    monkeypatch.setattr(Versions, "commit", late)
    said["one"] = {r["thread_id"]: r["result"] for r in one.decide(asked("approved"), "one").collect()}
    assert said["two"] == {"onboarding-1": "ok", "onboarding-9": "not_found", "onboarding-2": "not_awaiting_review"}
    assert said["one"] == {"onboarding-1": "not_awaiting_review", "onboarding-9": "not_found", "onboarding-2": "not_awaiting_review"}
    sent = [(r["thread_id"], r["callback"]["status"]) for r in one.callbacks(1).collect()]
    assert sent == [("onboarding-1", "rejected")]
    assert {r["thread_id"]: r["result"] for r in two.decide(asked("rejected"), "two").collect()} == said["two"]  # repeated: the same answer, no second callback
    assert one.callbacks(1).count() == 1 and one.states().filter("thread_id = 'onboarding-1'").first()["seq"] == 2


def test_equal_decisions_in_a_batch(spark):
    log = spark.createDataFrame([("t", 1, "flag_for_review", '{"explanation":"e"}')], "thread_id string, seq long, next string, state string")
    asked = spark.createDataFrame([("t", "approved")] * 5 + [("t", "maybe")], "thread_id string, decision string")
    results = sorted(r["result"] for r in flow.resumed(log, asked).collect())
    assert results == ["invalid_decision"] + ["not_awaiting_review"] * 4 + ["ok"]


# Order


def automaton(rows):
    """Brute force over (key, seq, attempt, status)."""
    out, now, told = {}, {}, set()
    for key, seq, attempt, status in sorted(rows, key=lambda r: r[1]):
        before = now.get(key)
        late = status == "processing" and (key, attempt) in told
        if status is None:
            out[seq] = (before, "invalid")
            continue
        if status != "processing":
            told.add((key, attempt))
        if late:
            out[seq] = (before, "late")
            continue
        out[seq] = (before, "step" if status in transitions.ORDINARY[before] else "same" if status == before else "illegal")
        now[key] = status
    return out, now


@pytest.mark.parametrize("least", [1000, 20])
def test_transitions(spark, monkeypatch, least):
    """Also with a key that most events have, over many ranges."""
    monkeypatch.setattr(ranges, "LEAST_ROWS", least)
    r = random.Random(least)
    rows = [(0 if r.random() < 0.6 else r.choice([None, 1, 2, 3]), i, r.choice([i // 30, None, 1]), r.choice([*transitions.ORDINARY, "processing"])) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, seq long, attempt long, status string").repartition(3)
    told = transitions.transitions(df, "k", ["seq"])
    want, last = automaton(rows)
    assert {x["seq"]: (x["previous"], x["result"]) for x in told.collect()} == want
    now = transitions.current(told, "k", ["seq"]).collect()
    assert {x["k"]: x["status"] for x in now if x["status"]} == last and sum(x["n_illegal"] for x in now) == sum(v[1] == "illegal" for v in want.values())
    assert transitions.transitions(df.filter("false"), "k", ["seq"]).count() == 0


def test_numbers_over_many_partitions(spark, monkeypatch):
    """Thousands of pieces, ties, nulls, an empty table; the input is read once."""
    rows = spark.createDataFrame([(i * 37 % 101 if i % 10 else None,) for i in range(3000)], "k long")
    reads_ = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads_.add(b.num_rows)
            yield b

    got = [(r["k"], r["id"]) for r in intake.numbered(rows.mapInArrow(count, "k long"), "k", 11, pieces=1500).collect()]
    assert sorted(i for _, i in got) == list(range(11, 3011)) and reads_.value == 3000
    assert [k for k, _ in sorted(got, key=lambda x: x[1])] == sorted((r["k"] for r in rows.collect()), key=lambda k: (k is not None, k))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4000")
    try:
        assert sorted(r["id"] for r in intake.numbered(rows, "k").collect()) == list(range(1, 3001))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_allocator(spark, tmp_path):
    """Two allocators on one folder never give a number twice."""
    one, two = Ids(spark, str(tmp_path / "ids")), Ids(spark, str(tmp_path / "ids"))
    assert [one.reserve(3), two.reserve(2), one.reserve(0), one.reserve(4)] == [1, 4, 6, 6]
    assert sorted(r["id"] for r in two.numbered(spark.range(5).withColumnRenamed("id", "k"), "k").collect()) == list(range(10, 15))


def test_dashboard_keeps_its_order_without_broadcasts(spark):
    parents = spark.createDataFrame([(i, "received", i // 2) for i in range(200)], "id long, status string, inserted_at long")
    children = spark.createDataFrame([(i, i % 150, f"c{i}", 1) for i in range(300)], "id long, onboarding_id long, company_name string, inserted_at long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows = reads.dashboard(parents, children, "received", 50).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r["id"] for r in rows] == list(range(199, 149, -1)) and rows[0]["company_name"] is None


def test_stream_ingest_of_files_in_no_order(spark, tmp_path):
    """Against the query's SQL: six files, of which later ones hold the lower ids of equal texts."""
    for k in range(6):
        rows = [(100 * (5 - k) + i, f"text {i} of some length", "en", "src0", 4) for i in range(4)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(db.execute(lifecycle.ORACLE["stream_ingest"]).fetchall())
    got = lifecycle.stream_ingest(spark, str(tmp_path)).select("stream", "seq", "result").collect()
    assert sorted(tuple(r) for r in got) == want
    assert sorted(r["seq"] for r in got if r["result"] == "created") == [0, 1, 2, 3]


# Steps


def test_trapped_step(spark):
    """A batch is halved until the bad rows are alone; others keep their values; null arguments aren't asked."""
    asked = spark.sparkContext.accumulator(0)

    def check(names):
        asked.add(1)
        if names.isna().any():
            raise AssertionError("asked for a null")
        if (names == "bad").any():
            raise ValueError(f"{(names == 'bad').sum()} bad")
        return names.str.upper()

    rows = [(i, "bad" if i in (3, 40, 41) else None if i == 50 else f"n{i}") for i in range(64)]
    df = spark.createDataFrame(rows, "i long, n string").coalesce(1)
    out = {r["i"]: (r["v"]["value"], r["v"]["error"]) for r in df.select("i", flow.Trapped(check, "string")(F.col("n")).alias("v")).collect()}
    assert out == {i: (None, "ValueError: 1 bad") if n == "bad" else (None, None) if n is None else (n.upper(), None) for i, n in rows}
    assert asked.value < 45


def test_rows_of_python_steps_are_dealt_out(spark):
    """A table in one partition goes through Python steps in as many tasks as the session shuffles to; without any it stays."""
    docs = spark.range(400).coalesce(1).select("id", F.lit("a").alias("contract_text"), F.lit("b").alias("w9_text"))
    steps = flow.Steps(screen=flow.Trapped(lambda names: names.map(lambda x: {"flagged": False, "reason": None}), "struct<flagged:boolean,reason:string>"))
    rows = lambda steps: [n for n in flow.validate_documents(docs, steps).select("id").rdd.glom().map(len).collect() if n]
    assert rows(steps) == [100] * 4 and rows(flow.Steps()) == [400]


def test_raising_extractor_is_a_result(spark):
    """One case of twenty meets an extractor that raises: it has the error and no decision, and counts as wrong."""

    def boom(texts):
        if texts.str.contains("Blue Ridge").any():
            raise ValueError("simulated extraction failure")
        found = texts.str.extract(r'and (?P<company_name>.+?) \("Vendor')
        return found.assign(payment_terms="Net 30", liability_clauses="x")

    steps = flow.Steps(extract_contract=flow.Trapped(boom, "struct<company_name:string,payment_terms:string,liability_clauses:string>"))
    run = evaluate.run_all(fixtures.cases(spark), lambda c: flow.validate_documents(c, steps)).cache()
    rows = {r["id"]: r for r in run.collect()}
    assert rows["clean-02"]["error"] == "ValueError: simulated extraction failure" and rows["clean-02"]["decision"] is None and rows["clean-02"]["w9"] is None
    assert sum(r["decision"] == r["expected_decision"] for r in rows.values()) == 19
    assert {r["bucket"]: (r["total"], r["correct"]) for r in evaluate.bucket_accuracy(run, "bucket", "decision", "expected_decision").collect()}["clean"] == (10, 9)


def test_screening(spark):
    df = spark.createDataFrame([(" ROGUE exports LLC\t",), ("acme",), (None,), ("",)], "name string")
    hits = lambda out: {r["name"]: r["flagged"] for r in out.collect()}
    want = {" ROGUE exports LLC\t": True, "acme": False, None: False, "": False}
    plain = flow.screened(df, F.col("name"))
    assert hits(plain) == want and "Join" not in plan_of(plain) and "Exchange" not in plan_of(plain)
    entries = spark.createDataFrame([("rogue exports llc",), (None,), ("rogue exports llc",)], "entry string")
    assert hits(flow.screened(df, F.col("name"), entries)) == want
    assert hits(flow.screened(df, F.col("name"), entries.filter("false"))) == dict.fromkeys(want, False)
    with pytest.raises(ValueError):
        flow.screener(tuple(map(str, range(20_000))))


def test_large_watchlist_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(flow, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "name string")
    out = flow.screened(df, F.col("name"), spark.createDataFrame([("a",)], "entry string"))
    assert sorted((r["name"] or "", r["flagged"]) for r in out.collect()) == [("", False), ("a", True), ("a", True), ("b", False)]


# Summaries, reports, documents


def test_summaries_merge_like_one(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), i % 7, int(r.lognormvariate(3, 2))) for i in range(20_000)] + [("c", 0, None)]
    df = spark.createDataFrame(rows, "tag string, day int, v long")
    got = {x["tag"]: x for x in evaluate.quantiles(evaluate.merged(evaluate.merged(evaluate.summarised(df, "v", "tag", "day"), "tag", "day"), "tag"), {"p50": 0.5, "p99": 0.99}).collect()}
    for tag in "ab":
        own = sorted(v for t, _, v in rows if t == tag)
        assert (got[tag]["n"], got[tag]["sum"], got[tag]["min"], got[tag]["max"]) == (len(own), sum(own), own[0], own[-1])
        for name, q in (("p50", 0.5), ("p99", 0.99)):
            lower, upper = (sum(v < got[tag][name] for v in own) / len(own), sum(v <= got[tag][name] for v in own) / len(own))
            assert lower - evaluate.SKETCH_ERROR <= q <= upper + evaluate.SKETCH_ERROR
    assert got["c"]["n"] == 0 and got["c"]["p50"] is None and got["c"]["mean"] is None


def test_report_of_the_cases(spark):
    run = flow.validate_documents(fixtures.cases(spark)).withColumn("tax_id_verbatim", F.lit(True))
    lines = [r["line"] for r in evaluate.eval_report(run, spark.createDataFrame([("entity_match", 0.9)] * 18, "metric string, score double")).orderBy("part", "key").collect()]
    assert lines[0] == "fixture         bucket      decision      expected      entity_match  tax_id_ok  error" and len(lines) == 1 + 20 + 1 + 4 + 1 + 1 + 2
    assert lines[1] == "clean-01        clean       approved      approved      True          True       "
    assert lines[-3:] == ["--- LLM-judge tier (Claude Sonnet) ---", "entity_match: avg 0.90 (n=18)", "groundedness: no scored cases"]


def test_empty_file_is_an_empty_text(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "none.txt").write_bytes(b"")
    (tmp_path / "d" / "a.txt").write_bytes(b"x")
    assert sorted((r["path"].rsplit("/", 1)[1], r["text"]) for r in intake.read_documents(spark, str(tmp_path / "d")).collect()) == [("a.txt", "x"), ("none.txt", "")]


def test_outcomes_carry_no_content(spark):
    """The outcome of a payload comes from hashes: neither bodies nor fields are shuffled."""
    df = payloads(spark, [(1, body())])
    out = intake.decided(intake.facts(df), spark.createDataFrame([], "idempotency_key string"))
    shuffled = [line for line in plan_of(out).split("== Physical Plan ==")[1].splitlines() if "Exchange" in line]
    assert shuffled and out.first()["result"] == "created"
    assert not any(column in line for line in shuffled for column in ("contract", "raw", "w9"))


@pytest.mark.parametrize("kind", ["table", "files"])
def test_storage_is_swapped_by_configuration(spark, tmp_path, kind):
    """Both adapters keep bytes as they are, replace what is stored again, and say where it is."""
    root = str(tmp_path / kind)
    spark.conf.set(storage.KIND, kind)
    spark.conf.set(storage.ROOT, root)
    try:
        own = storage.storage(spark)
    finally:
        spark.conf.unset(storage.KIND)
        spark.conf.unset(storage.ROOT)
    with pytest.raises(ValueError):
        storage.storage(spark)
    blobs = spark.createDataFrame([("a/contract.pdf", bytearray(b"x\xff")), ("a/w9.pdf", bytearray(b"old"))], "path string, content binary")
    where = {r["path"]: r["kept_at"] for r in own.store(blobs).collect()}
    own.store(blobs.filter("path like '%w9%'").withColumn("content", F.lit("new").cast("binary"))).collect()
    assert {r["path"]: bytes(r["content"]) for r in own.load().collect()} == {"a/contract.pdf": b"x\xff", "a/w9.pdf": b"new"}
    assert [r["path"] for r in own.load(blobs.filter("path like '%w9%'")).collect()] == ["a/w9.pdf"]
    if kind == "files":
        assert where["a/w9.pdf"] == f"{root}/a/w9.pdf" and (tmp_path / kind / "a" / "w9.pdf").read_bytes() == b"new"
        with pytest.raises(Exception, match="not a path below"):
            own.store(spark.createDataFrame([("../x", bytearray(b""))], "path string, content binary"))
