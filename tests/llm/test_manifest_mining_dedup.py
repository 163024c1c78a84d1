"""Merkle manifest, hard negatives and exact duplicates against brute force, on awkward rows too."""

import hashlib
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerfold.llm import exact_duplicates, hard_negatives, merkle
from ledgerfold.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_hard_negatives", "op13_exact_dedup"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    out = QUERIES[name](spark, SF)
    assert sorted(out.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in out.collect()) == sorted(want.fetchall())


# Merkle manifest


def proved(rows):
    """Brute force over (id, group, leaf, shown)."""
    by = {}
    for id_, group, leaf, shown in rows:
        by.setdefault(group, []).append((id_ is not None, id_ if id_ is not None else 0, leaf, shown, id_))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
        return levels

    own = {g: sorted(v) for g, v in by.items()}
    trees = {g: tree([x[2] for x in v]) for g, v in own.items()}
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for at_group, g in enumerate(order):
        for at_leaf, (_, _, leaf, shown, id_) in enumerate(own[g]):
            node, siblings = shown, ""
            for levels, at in ((trees[g], at_leaf), (top, at_group)):
                for nodes in levels[:-1]:
                    run, k = nodes[at // 16 * 16 :][:16], at % 16
                    siblings += "".join(run[:k] + run[k + 1 :])
                    node = sha("".join([*run[:k], node, *run[k + 1 :]]))
                    at //= 16
            out.append((id_, leaf, trees[g][-1][0], top[-1][0], sha(siblings), node, node == top[-1][0]))
    return out


def leaves_of(rows):
    enc = lambda *f: "".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in f)
    return [(i, g, sha(enc(i, g, t)), sha(enc(i, g, None if t is None else t + "!" if i is not None and i % 3 == 0 else t))) for i, g, t in rows]


def shown_columns():
    whole = merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("text"))
    other = merkle.leaf_of(F.col("doc_id"), F.col("source"), F.concat("text", F.lit("!")))
    return whole, F.when(F.col("doc_id") % 3 == 0, other)


@pytest.mark.parametrize("pairs", [merkle.PAIRS, 0])
@pytest.mark.parametrize("n", [1, 16, 17, 256, 257, 5000])
def test_proofs(spark, monkeypatch, n, pairs):
    """Groups of one leaf to several levels, over many partitions whose ends cut subtrees; offsets broadcast or shuffled."""
    if pairs == 0 and n not in (17, 5000):
        pytest.skip("one size of each kind")
    monkeypatch.setattr(merkle, "LEAST_ROWS", 8)
    monkeypatch.setattr(merkle, "PAIRS", pairs)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        r = random.Random(n)
        rows = [(i, "big", f"text {i} é") for i in range(n)] + [(10**6 + i, f"s{i % 21}" if i % 5 else None, None if i % 4 == 0 else "x" * i) for i in range(min(n, 300) - 1)]
        r.shuffle(rows)
        out = merkle.proofs(spark.createDataFrame(rows, "doc_id long, source string, text string"), *shown_columns())
        assert sorted(map(tuple, out.collect())) == sorted(proved(leaves_of(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_proofs_of_awkward_rows(spark):
    rows = [(None, None, None), (None, None, "a"), (None, "s", ""), (1, "s", "one"), (1, "s", "one"), (1, "s", "other"), (2, "", "empty name"), (3, "é", "x " * 200_000), (4, "z", "4:wxyz")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit("clash") for c in ("g", "i", "total", "leaf", "shown", "row", "p", "place", "id", "root")})
    found = merkle.proofs(docs, *shown_columns()).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found), key=key) == sorted(proved(leaves_of(rows)), key=key)
    assert merkle.proofs(docs.filter("false"), *shown_columns()).collect() == []
    sizes = {r["source"]: (r["n_rows"], r["root"]) for r in merkle.manifest(docs, shown_columns()[0]).collect()}
    assert {k: v[0] for k, v in sizes.items()} == {None: 2, "s": 4, "": 1, "é": 1, "z": 1} and {v[1] for v in sizes.values()} == {found[0]["root"]}
    assert merkle.manifest(docs.filter("false"), shown_columns()[0]).collect() == []


# Hard negatives


def mined(rows, every, k=5):
    """Brute force in whole numbers over (id, label, vector)."""
    good = [(i, y, [int(np.floor(256 * float(x))) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot, out = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)), []
    anchors = {}
    for i, y, v in good:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    for i, (y, v) in anchors.items():
        others = sorted(((dot(v, u), -j, z) for j, z, u in good if j != i and len(u) == len(v)), reverse=True)
        for p, j, _ in [x for x in others if x[2] == y][:k]:
            fit = [x for x in others if x[2] != y and 80 * p <= 100 * x[0] <= 100 * p][:k]
            out += [(i, -j, n + 1, -x[1], p, x[0]) for n, x in enumerate(fit)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>"


def vectors(n, d, seed, scale=1.0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(6, d))
    return [(i, int(r.integers(0, 4)), [float(np.float32(x)) for x in scale * (base[r.integers(0, 6)] + 0.3 * r.normal(size=d))]) for i in range(n)]


def test_hard_negatives(spark, monkeypatch):
    """Several blocks of anchors and tiles, and a vector that very many rows have."""
    rows = vectors(1500, 8, 1) + [(2000 + i, i % 3, [1.0] * 8) for i in range(400)]
    want = mined(rows, 10)
    df = spark.createDataFrame(rows, VECTORS).repartition(7)
    assert sorted(map(tuple, hard_negatives.mined(df, 10).collect())) == want and len(want) > 1000
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 60)
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 33)
    assert sorted(map(tuple, hard_negatives.mined(df, 10).collect())) == want


def test_hard_negatives_of_awkward_rows(spark):
    rows = vectors(60, 4, 2)
    rows += [(None, 1, [1.0] * 4), (100, None, [1.0] * 4), (101, 1, None), (102, 1, [1.0, None, 1.0, 1.0]), (103, 1, [1.0, float("nan"), 1.0, 1.0]), (104, 1, [float("inf")] * 4), (105, 1, []), (110, 1, []), (111, 0, []), (112, 1, [1.0]), (120, 0, [0.0] * 4), (121, 0, [0.0] * 4), (122, 1, [0.0] * 4)]
    rows += [rows[10], rows[10], (10, 2, [2.0] * 4), rows[11]]  # an anchor that repeats, with another vector too, and a candidate that does
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("clash") for c in ("vector", "rank", "score", "row_id", "anchor_id")})
    assert sorted(map(tuple, hard_negatives.mined(df, 10).collect())) == mined(rows, 10)
    assert hard_negatives.mined(df.filter("false"), 10).collect() == []
    assert hard_negatives.mined(df.filter("vec_id % 10 > 0"), 10).collect() == []


def test_products_are_exact_beyond_floats(spark):
    """Components near 2^29: sums pass 2^53, where float64 would round; beyond 64 bits the result is held to them."""
    r = random.Random(4)
    rows = [(i, i % 2, [float(r.randrange(2**21)) for _ in range(3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, hard_negatives.mined(df, 10).collect())) == mined(rows, 10)
    a, b = np.array([[2.0**40 + 1, 3.0]]), np.array([[2.0**40 + 1, 5.0]])
    assert hard_negatives.product(a, b)[0, 0] == (2**40 + 1) ** 2 + 15
    huge = spark.createDataFrame([(0, 0, [1e30]), (1, 0, [1e30]), (2, 1, [0.9e30])], "vec_id long, label int, embedding array<double>")
    assert [(x["positive_id"], x["negative_id"], x["positive_score"]) for x in hard_negatives.mined(huge).collect()] == [(1, 2, 2**63 - 1)]


# Exact duplicates


def test_cuckoo_index():
    """Insertions and deletions against a dict, from a table so small that it overflows many times."""
    index, there, r = exact_duplicates.CuckooIndex(1), {}, random.Random(1)
    for step in range(20_000):
        text = str(r.randrange(3000)).encode()
        digest = exact_duplicates.digest_of(text)
        assert index.find(digest, text) == there.get(text)
        if text in there and r.random() < 0.6:
            assert index.delete(digest, text) == there.pop(text)
        elif text not in there:
            index.insert(digest, text, step)
            there[text] = step
    assert len(index) == len(there) and sorted(index.values()) == sorted(there.values())
    assert sum(x > 0 for x in index.table) == len(there)  # every live digest once, no other one
    assert all(index.maybe(exact_duplicates.digest_of(t)) for t in there)
    gone = [str(i).encode() for i in range(3000, 60_000)]
    assert sum(index.maybe(exact_duplicates.digest_of(t)) for t in gone) < 0.01 * len(gone)
    assert index.delete(exact_duplicates.digest_of(b"never"), b"never") is None


def test_hits_are_verified():
    """Texts of one digest, and digests of one fingerprint and bucket, are told apart by their content."""
    index = exact_duplicates.CuckooIndex(4)
    weak = lambda t: bytes([len(t)]) * 32
    for t in (b"aa", b"bb", b"cc", b"d"):
        index.insert(weak(t), t, t)
    assert index.find(weak(b"xx"), b"xx") is None and index.find(weak(b"bb"), b"bb") == b"bb"
    assert index.delete(weak(b"aa"), b"aa") == b"aa" and index.find(weak(b"cc"), b"cc") == b"cc" and index.maybe(weak(b"aa"))
    assert index.delete(weak(b"bb"), b"bb") and index.delete(weak(b"cc"), b"cc") and not index.maybe(weak(b"aa"))
    same = [bytes([1] * 10 + [i] * 22) for i in range(8)]  # one fingerprint and both buckets of it are full
    for d in same:
        index.insert(d, d, d)
    assert all(index.find(d, d) == d for d in same)


def kept(rows):
    """Brute force over (id, text): the result without kept, and how many rows of each text are kept."""
    bare = lambda t: "".join(c for c in t or "" if c not in " \t\n\v\f\r")
    by = {}
    for i, t in rows:
        by.setdefault(bare(t), []).append((-len(t or ""), i is None, i or 0, i))
    best = {t: min(v)[3] for t, v in by.items()}
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(((i, best[bare(t)], len(by[bare(t)]), sha(bare(t))) for i, t in rows), key=key), key


@pytest.mark.parametrize("window", [exact_duplicates.WINDOW, 3000])
def test_exact_duplicates(spark, monkeypatch, window):
    """A text that a third of the rows have, rows that repeat, ids that are null; a window that deletes texts all the time."""
    monkeypatch.setattr(exact_duplicates, "WINDOW", window)
    r = random.Random(6)
    rows = [(i, ("hot  text" if i % 2 else "hot text\n") if i % 3 == 0 else f"text {r.randrange(300)}" + " \t\v\f\r\n"[: r.randrange(7)] + "é") for i in range(1200)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (None, ""), (None, "only without id"), (None, "only without id"), (None, "text 1"), (2003, "a b"), (2003, "a b"), (2003, "ab"), (2004, "non breaking"), (2005, "nonbreaking"), (2006, "long " * 300_000), (2007, "long" * 300_000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "points", "raw", "digest", "row", "n", "keep_id", "kept")}).repartition(5)
    want, key = kept(rows)
    out = exact_duplicates.deduplicated(df, parts=3).collect()
    assert sorted(((x["doc_id"], x["keep_id"], x["group_size"], x["text_sha256"]) for x in out), key=key) == want
    stays = {}
    for x in out:
        if x["kept"]:
            assert x["doc_id"] == x["keep_id"] and x["text_sha256"] not in stays
            stays[x["text_sha256"]] = x
    assert len(stays) == len({w[3] for w in want})
    assert exact_duplicates.deduplicated(df.filter("false")).collect() == []


def test_replayed_changes(spark):
    r, live, want = random.Random(8), {}, {}
    changes = [(i, r.choice(["insert", "insert", "delete"]), f"t {r.randrange(25)}" + " " * r.randrange(2)) for i in range(1500)] + [(1500, "insert", None), (1501, "delete", " "), (1502, "delete", ""), (1503, "replace", "t 1"), (1504, None, "t 1")]
    for i, what, t in changes:
        bare = "".join((t or "").split())
        n = live.get(bare, 0)
        if what == "insert":
            live[bare] = n + 1
            want[i] = ("copy" if n else "new", n + 1)
        elif what == "delete":
            live[bare] = max(0, n - 1)
            want[i] = ("absent" if not n else "deleted" if n == 1 else "one_less", live[bare])
        else:
            want[i] = ("invalid", n)
    df = spark.createDataFrame(changes, "seq long, action string, text string").repartition(4)
    assert {x["seq"]: (x["result"], x["copies"]) for x in exact_duplicates.replayed(df, 3).collect()} == want
