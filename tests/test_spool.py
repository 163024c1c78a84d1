"""Requests from a spool and answers through an outbox, over restarts and repeated tasks."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerfold.sources import spool
from ledgerfold.streaming import live

from test_library import body


def lines(path, bodies, end=b""):
    with open(path, "ab") as f:
        f.writelines(spool.spooled_line(b, 1.0) for b in bodies)
        f.write(end)


def taken(spark, folder, out, at):
    source = spark.readStream.format("spool").option("path", str(folder)).load()
    source.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}")).option("checkpointLocation", str(at)).trigger(availableNow=True).start().awaitTermination()
    return sorted((r["file"], bytes(r["raw"])) for r in spark.read.option("recursiveFileLookup", "true").schema("file string, position long, at double, raw binary").parquet(str(out)).collect())


def test_spool_over_restarts(spark, tmp_path, monkeypatch):
    """Files grow in any order; an unfinished line waits; nothing is read twice."""
    spool.register(spark)
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in" / "b", [b"one", b"two"], end=b'{"at": 2.0, "raw": "')
    assert taken(spark, tmp_path / "in", tmp_path / "out", tmp_path / "at") == [("b", b"one"), ("b", b"two")]
    with open(tmp_path / "in" / "b", "ab") as f:
        f.write(b'dGhyZWU="}\n')  # the line is finished: three
    lines(tmp_path / "in" / "a", [b"four \xff\x00" * 30_000, b""])
    want = sorted([("b", b"one"), ("b", b"two"), ("b", b"three"), ("a", b"four \xff\x00" * 30_000), ("a", b"")])
    assert taken(spark, tmp_path / "in", tmp_path / "out", tmp_path / "at") == want
    assert taken(spark, tmp_path / "in", tmp_path / "out", tmp_path / "at") == want


@pytest.mark.parametrize("size", [1, 7, 40, 64, 1000])
def test_ranges_have_each_line_once(tmp_path, monkeypatch, size):
    monkeypatch.setattr(spool, "RANGE_BYTES", size)
    bodies = [b"x" * k for k in range(12)]
    lines(tmp_path / "f", bodies)
    reader = spool.SpoolReader(str(tmp_path))
    end = reader.latestOffset()
    assert end == {"f": (tmp_path / "f").stat().st_size}
    assert [raw for p in reader.partitions({}, end) for _, _, _, raw in reader.read(p)] == bodies
    assert reader.partitions(end, end) == []


def test_spooled_payloads_are_ingested(spark, tmp_path):
    spool.register(spark)
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in" / "a", [body(b"x"), body(b"x"), b"not json"])
    source = spark.readStream.format("spool").option("path", str(tmp_path / "in")).load().select(F.col("position").alias("seq"), "raw")
    seen = []
    live.ingest(source, lambda df, _: seen.extend(r["result"] for r in df.orderBy("seq").collect()), str(tmp_path / "ledger"), str(tmp_path / "at")).awaitTermination()
    assert seen == ["created", "duplicate", "invalid_payload"]


def test_outbox_sends_once(spark, tmp_path):
    """A row that isn't accepted fails its batch; the repeated batch sends that row alone, and a later copy of a key isn't sent."""
    (tmp_path / "calls").mkdir()

    def send(row, key):
        name = tmp_path / "calls" / f"{key}-{len(list((tmp_path / 'calls').glob(key + '-*')))}"
        name.write_text(row["what"])
        if key == "k2" and not (tmp_path / "open").exists():
            return 503
        if key == "k3" and not (tmp_path / "open").exists():
            raise TimeoutError("late")
        return 202

    spark.dataSource.register(spool.outbox(send, "outbox_test"))
    spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k3", "c")], "key string, what string").coalesce(1).write.parquet(str(tmp_path / "in" / "1"))

    def run():
        stream = spark.readStream.schema("key string, what string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        stream.writeStream.format("outbox_test").option("path", str(tmp_path / "box")).option("key", "key").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="2 rows weren't sent"):
        run()
    (tmp_path / "open").write_text("")
    run()
    calls = sorted(p.name.split("-")[0] for p in (tmp_path / "calls").iterdir())
    assert calls.count("k1") == 1 and calls.count("k2") >= 2 and calls.count("k3") >= 2
    assert json.loads((tmp_path / "box" / "batches" / "0.json").read_text()) == {"sent": 2, "known": 1}
    spark.createDataFrame([("k1", "again"), ("k4", "d")], "key string, what string").coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    run()
    assert json.loads((tmp_path / "box" / "batches" / "1.json").read_text()) == {"sent": 1, "known": 1}
