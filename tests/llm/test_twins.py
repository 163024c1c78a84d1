"""Learnt operators against plain numpy over dictionaries of the same n-grams."""

import math
import random
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerfold.llm import language, linear, near_duplicates, quality, toxicity
from ledgerfold.llm.grams import CharGrams
from ledgerfold.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def tongues(n, per, seed=1):
    """Languages of their own few syllables."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        syllables = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(12)]
        rows += [(k * per + i, " ".join(r.choice(syllables) + r.choice(syllables) for _ in range(25)), f"l{k:03d}") for i in range(per)]
    return rows


def naive_bayes(rows, asked, orders, bits, alpha):
    """Name and posterior for each asked text, from counts in dictionaries."""
    grams, counts = CharGrams(orders, bits), {}
    bag = lambda t: Counter(int(x) for ids in grams.ids(t) for x in ids)
    for _, text, lang in rows:
        counts.setdefault(lang, Counter()).update(bag(text))
    out = []
    for text in asked:
        own = bag(text)
        z = {lang: sum(n * math.log((c[x] + alpha) / (sum(c.values()) + alpha * 2**bits)) for x, n in own.items()) for lang, c in counts.items()}
        best = max(sorted(z), key=lambda k: z[k])
        out.append((best, 1 / sum(math.exp(v - z[best]) for v in z.values())))
    return out


def test_language_model_equals_naive_bayes(spark):
    rows = tongues(5, 8)
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = [t for _, t, _ in tongues(5, 3)] + ["abc xyz", "Zz " * 40]
    got = language.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), language.train(train, bits=10)).orderBy("doc_id").collect()
    want = naive_bayes(rows, asked, language.ORDERS, 10, language.ALPHA)
    assert [r["lang_pred"] for r in got] == [w[0] for w in want]
    assert np.allclose([r["score"] for r in got], [w[1] for w in want], rtol=1e-3, atol=1e-6)


def test_every_language_is_learnt(spark):
    """300 values of lang, in blocks; rows without an id, a text or a language teach nothing."""
    rows = tongues(300, 3)
    awkward = [(None, "text", "zz"), (9001, None, "zz"), (9002, "text", None), (9003, "text", ""), (9004, "", "zz")]
    model = language.train(spark.createDataFrame(rows + awkward, "doc_id long, text string, lang string"))
    assert isinstance(model, language.Blocks) and model.n > 1
    asked = spark.createDataFrame([(i, t, lang) for i, t, lang in rows] + [(9005, None, "und"), (9006, "12 !", "und"), (None, rows[0][1], "l000")], "doc_id long, text string, want string").withColumns({c: F.lit("clash") for c in ("__name", "__best", "score")})
    out = language.predict(asked, model)
    assert out.columns == ["doc_id", "text", "want", "__name", "__best", "lang_pred", "score"]
    found = out.collect()
    assert len(found) == 903 and all(r["lang_pred"] == r["want"] and r["__name"] == "clash" for r in found)
    assert all(r["score"] == 0 if r["want"] == "und" else 0.9 < r["score"] <= 1.000001 for r in found)
    assert language.predict(asked.filter("false"), model).count() == 0


def test_blocks_give_what_one_matrix_gives(spark, monkeypatch):
    rows = tongues(9, 4)
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(i, t[: 5 + i % 30]) for i, t, _ in rows] + [(99, "q")], "doc_id long, text string")
    whole = {r["doc_id"]: r for r in language.predict(asked, language.train(train)).collect()}
    monkeypatch.setattr(language, "LANGUAGES", 3)
    parts = {r["doc_id"]: r for r in language.predict(asked, language.train(train)).collect()}
    assert {k: r["lang_pred"] for k, r in whole.items()} == {k: r["lang_pred"] for k, r in parts.items()}
    assert all(math.isclose(whole[k]["score"], parts[k]["score"], rel_tol=1e-6) for k in whole)


def newton(x, y, weight, l2):
    """Weights and bias of the least weighted log loss plus l2/2 of the squared weights, by Newton's method on a dense matrix."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x1.shape[1]), np.diag([l2] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x1 @ w))
        gradient = x1.T @ (weight * (p - y)) + ridge @ w
        hessian = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 + ridge
        w = w - np.linalg.solve(hessian + 1e-12 * np.eye(len(w)), gradient)
    return w[:-1], w[-1]


def test_toxicity_equals_plain_naive_bayes_scaled_regression(spark):
    """Log-count ratios from dictionaries, the regression by Newton's method: the same scores."""
    bits, r = 8, random.Random(2)
    mild, rude = ["calm", "river", "stone", "green", "bread"], ["vile", "hateful", "scum", "stupid"]
    rows = [(i, " ".join(r.choice(mild + (rude if i % 3 == 0 else [])) for _ in range(6)), int(i % 3 == 0)) for i in range(60)]
    grams, there = CharGrams(toxicity.ORDERS, bits), []
    for _, text, _ in rows:
        there.append({int(x) for ids in grams.ids(text) for x in ids})
    y = np.array([t for _, _, t in rows], float)
    count = [Counter(x for f, t in zip(there, y, strict=True) if t == label for x in f) for label in (1, 0)]
    size = 2**bits
    share = [{x: (c[x] + toxicity.ALPHA) / (sum(c.values()) + toxicity.ALPHA * size) for x in range(size)} for c in count]
    scale = np.array([math.log(share[0][x] / share[1][x]) if count[0][x] + count[1][x] >= toxicity.LEAST else 0.0 for x in range(size)])
    dense = np.array([[float(x in f) for x in range(size)] for f in there]) * scale
    w, bias = newton(dense, y, np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())), toxicity.L2)
    want = 1 / (1 + np.exp(-(dense @ w + bias)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, bits=bits)).orderBy("doc_id").collect()
    assert np.abs(np.array([x["score"] for x in got]) - want).max() < 0.02
    assert [x["predicted"] for x in got] == [int(x["score"] >= 0.7) for x in got] and ((want > 0.5) == (y == 1)).mean() > 0.9


def test_fit_finds_the_least_loss():
    """The sparse solver against Newton's method, with soft targets, weights and scales."""
    r = np.random.default_rng(5)
    dense = (r.random((80, 20)) < 0.3) * r.random((80, 20))
    dense[:, 0] = 0.5  # no row is empty
    y, weight, scale = r.random(80), r.random(80), r.normal(size=20)
    rows = linear.Rows([np.flatnonzero(x).astype(np.int32) for x in dense], [x[np.flatnonzero(x)] for x in dense])
    got, bias = linear.fit(rows, y, weight, scale, 0.01, steps=200)
    w, b = newton(dense * scale, y, weight / weight.sum(), 0.01)
    p = lambda w, b: 1 / (1 + np.exp(-(dense @ w + b)))
    assert np.abs(p(got, bias) - p(w * scale, b)).max() < 0.01


def test_weak_labels_equal_plain_em():
    """Expectation-maximisation by loops over single documents, not over counted patterns."""
    k, r = len(quality.LABELLERS), random.Random(7)
    docs = []
    for i in range(300):
        bad = i % 4 == 0
        docs.append("".join(r.choices("gb-", [0.4, 0.5, 0.1] if bad else [0.93, 0.02, 0.05])[0] for _ in range(k)))
    good = [{"g": 0.95, "b": 0.01, "-": 0.04} for _ in range(k)]
    poor = [{"g": 0.62, "b": 0.33, "-": 0.05} for _ in range(k)]
    first, prior = ([dict(x) for x in good], [dict(x) for x in poor]), 0.8
    for _ in range(200):
        q = []
        for d in docs:
            a, b = prior, 1 - prior
            for j, v in enumerate(d):
                a, b = a * good[j][v], b * poor[j][v]
            q.append(a / (a + b))
        tally = [[{v: 4 * start[j][v] for v in "gb-"} for j in range(k)] for start in first]
        for d, p in zip(docs, q, strict=True):
            for j, v in enumerate(d):
                tally[0][j][v] += p
                tally[1][j][v] += 1 - p
        shares = [[{v: x / sum(t.values()) for v, x in t.items()} for t in side] for side in tally]
        for j in range(k):
            shares[0][j]["b"] = min(shares[0][j]["b"], shares[1][j]["b"])
            shares[0][j] = {v: x / sum(shares[0][j].values()) for v, x in shares[0][j].items()}
        good, poor, prior = shares[0], shares[1], (sum(q) + 8) / (len(docs) + 10)
    model = quality.estimate(Counter(docs))
    assert abs(model.prior - prior) < 1e-5
    for side, want in ((model.good, good), (model.bad, poor)):
        assert np.allclose(side, [[w[v] for v in "gb-"] for w in want], atol=1e-5)


def test_bloom_filter_loses_nothing(spark):
    """Every hash that went in is let through, few others are, and a bit takes a bit."""
    r = np.random.default_rng(9)
    values = r.integers(-(2**63), 2**63 - 1, 4000)
    filled = near_duplicates._bloom(spark.createDataFrame([(int(x),) for x in values], "text_hash long").repartition(6))
    assert len(filled) * 8 == 2**16 and len(near_duplicates._bloom_holds(filled, values)) == 4000
    assert len(near_duplicates._bloom_holds(filled, r.integers(-(2**63), 2**63 - 1, 20_000))) < 600


COUNTS = r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
d AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT), CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT), CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT), coalesce(n_dup_lines, 0), coalesce(n_repeat_words, 0),
len(ws) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(ws) FROM w LEFT JOIN d USING (doc_id) LEFT JOIN r USING (doc_id)"""


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_counts_of_quality_rules_equal_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = QUERIES["op7_quality_rules"](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(db.execute(COUNTS).fetchall())


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_mix_keeps_to_its_budget_and_passes(spark):
    """Totals from SQL: no source beyond its passes, every whole pass complete, the budget met within a document of each source."""
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    known = {s: (n, t) for s, n, t in db.execute(r"SELECT source, count(*), sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) FROM documents GROUP BY 1").fetchall()}
    rows = QUERIES["op1_source_mixing"](spark, SF).groupBy("source", "mix_pass").agg(F.count("*").alias("n"), F.sum("mix_tokens").alias("t")).collect()
    budget, spent, passes = sum(t for _, t in known.values()), 0, {}
    for r in rows:
        assert r["n"] <= known[r["source"]][0] and r["t"] <= known[r["source"]][1]
        passes.setdefault(r["source"], {})[r["mix_pass"]] = r
        spent += r["t"]
    for source, own in passes.items():
        first = min(own)
        assert sorted(own) == list(range(first, first + len(own))) and len(own) <= 4
        assert all(own[k]["n"] == known[source][0] for k in sorted(own)[:-1])
    longest = max(t for (t,) in db.execute(r"SELECT len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) FROM documents").fetchall())
    assert abs(spent - budget) <= longest * len(known)
