"""The training-data operators on small rows: brute force, round trips and edge cases."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerfold.llm import html_text, language, licences, mixing, near_duplicates, neighbours, packing, quality, quality_rules, toxicity
from ledgerfold.llm.common import Scratch
from ledgerfold.llm.components import connected_components

WORDS = [f"w{i}" for i in range(400)]
EDGES = [(900, None), (901, ""), (902, "  \n\t "), (903, "one"), (904, "x " * 3000), (None, "no id here at all"), (905, "tie tie"), (905, "tie tie")]


def texts(n=60, seed=1, words=80):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS) for _ in range(words))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("score", F.lit("clash"))


@pytest.fixture(scope="module")
def copies():
    """Base texts, near copies of some (a word changed), exact copies, and a large group of near copies."""
    rows, r = texts(40), random.Random(5)
    base = [t.split() for _, t in rows]
    at = len(rows)
    for k in range(150):
        words = list(base[0] if k < 60 else r.choice(base))
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
        rows.append((at + k, " ".join(words).upper() if k % 7 == 0 else " ".join(words)))
    return rows + [(i, t) for i, t in EDGES if i is not None]


def brute_components(rows, n, num, den):
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        sets.append((i, {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    group = {i: i for i, _ in rows}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a][1] & sets[b][1])
            if common and den * common >= num * len(sets[a][1] | sets[b][1]):
                x, y = find(sets[a][0]), find(sets[b][0])
                group[max(x, y)] = min(x, y)
    return {i: (find(i), len(s)) for i, s in sets}


@pytest.mark.parametrize("n,num,den,cells", [(4, 85, 100, 25), (5, 80, 100, 4)])
def test_near_duplicates(spark, copies, n, num, den, cells):
    """Cells of 4 bits: a full table orders badly, but loses nothing."""
    want = brute_components(copies, n, num, den)
    got = near_duplicates.near_duplicates(frame(spark, copies), n, num, den, cells).collect()
    assert len(got) == len(copies)
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == want


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 80, 100)])
def test_near_duplicates_by_two_ngrams(spark, monkeypatch, copies, n, num, den):
    """As above, where every n-gram of more than one node counts as one of many."""
    monkeypatch.setattr(near_duplicates, "MANY", 1)
    want = brute_components(copies, n, num, den)
    got = near_duplicates.near_duplicates(frame(spark, copies), n, num, den, 8).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == want


def test_unlike_texts_with_a_common_ngram(spark, monkeypatch):
    """Texts made of a few common phrases, one of which all begin with: few pairs are looked at, and none of the links is lost."""
    monkeypatch.setattr(near_duplicates, "MANY", 64)
    r, made = random.Random(3), []
    phrases = [" ".join(f"p{k}w{i}" for i in range(7)) for k in range(60)]
    rows = [(i, "one two three four five six seven " + " ".join(r.sample(phrases, 2))) for i in range(700)]
    inner = near_duplicates._crossed

    def counted(*args):
        pairs = inner(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_duplicates, "_crossed", counted)
    got = near_duplicates.near_duplicates(frame(spark, rows)).collect()
    assert {x["doc_id"]: (x["component_id"], x["n_shingles"]) for x in got} == brute_components(rows, 4, 85, 100)
    assert made[0] < 2000  # of a quarter of a million


def test_near_duplicates_empty(spark):
    assert near_duplicates.near_duplicates(frame(spark, [])).count() == 0


def test_pipeline_keeps_one_row_of_each_group(spark):
    """An id with two texts is two documents, and copies without an id are copies."""
    a, b, c, d, e = (t for _, t in texts(5, 11))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, d), (None, d), (None, a), (7, e), (None, e), (4, None), (4, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    got = corpus_pipeline.duplicates_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, a), (2, b), (3, c), (None, d), (7, e), (4, None), (4, "")], key=str)


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(50, 51), (60, 50), (7, 3)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 51: 50, 60: 50}


def test_all_trusted_documents_count(spark, monkeypatch):
    """However many ids are trusted, each counts once, whether they are broadcast or joined by a shuffle."""
    docs = frame(spark, [(i, f"w{i % 7} w{i % 11} w{i % 3}") for i in range(300)] + [(None, "w1 w2")])
    ids = spark.createDataFrame([(i,) for i in range(0, 300, 2)] * 2 + [(None,)], "doc_id long")
    ratios = lambda: quality_rules.log_ratios(docs, ids, 64).first()["ratios"]
    few = ratios()
    monkeypatch.setattr(quality_rules, "FEW_TRUSTED", 10)
    assert ratios() == few and len(set(few)) > 2


def test_split_shards_pack_every_id_in_as_few_tasks(spark):
    """Shards are four times as many, in as many tasks as before, and each id lies in one piece."""
    docs = frame(spark, [(i, f"word {i} " * (i % 50)) for i in range(200)])
    out = packing.pack(docs, packing.tokenizer_path(), length=256, split=4)
    assert out.rdd.getNumPartitions() == packing.pack(docs, packing.tokenizer_path(), length=256).rdd.getNumPartitions()
    rows = out.collect()
    assert len({r["sequence_id"] >> 32 for r in rows}) == 4
    found = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == found.get(r["doc_id"], 0)
        found[r["doc_id"]] = r["start"] + r["length"]
    assert found == {r["doc_id"]: r["doc_tokens"] for r in rows} and len(found) == 200


def test_what_stands_between_white_space_is_remembered():
    """Ids are the tokenizer's own, however few are remembered; a word with its marks is looked up at once."""
    path, texts = packing.tokenizer_path(), ["It's two words, two-words:\ttwo words,", "a1b22 ½x ²'S 'tis Été,«là»\x0b\r\nStraße don't'll", "", " \n", "x " * 50 + "y, z; " * 5]
    for remembered in (2, 8, 1000):
        encoder = packing.Encoder(path, remembered)
        assert encoder.fast and all(encoder.encode(t) == encoder._own(t) for t in texts * 2)
        assert len(encoder) <= max(remembered, 4) and len(encoder.older) <= max(remembered, 4)
    assert "words," in encoder


def test_packing_round_trip(spark):
    path = packing.tokenizer_path()
    rows = texts(30, 3, 700) + [(i, t) for i, t in EDGES if i != 905] + [(906, "Ünïcode ① ﷺ Σίσυφος <|endoftext|> don't"), (907, "word " * 9000)]
    out = packing.pack(frame(spark, rows), path, length=1024).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    pieces = {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(pieces[i], key=lambda r: r["start"])
        assert [x for r in own for x in np.frombuffer(r["ids"], "<u4")] == ids
        assert all(r["doc_tokens"] == len(ids) and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and r["length"] <= 1024 for r in own)
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r["length"] for r in out) >= 1024 * (len(sequences) - 2)
    assert packing.pack(frame(spark, []), path).count() == 0


def test_quality_rules(spark):
    r = random.Random(2)
    rows = [(i, "\n".join(" ".join(r.choice("abc#d") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 12)))) for i in range(60)] + EDGES
    docs = frame(spark, rows)
    got = quality_rules.judge(docs, quality_rules.log_ratios(docs, docs.filter("doc_id < 5").select("doc_id"))).collect()
    assert len(got) == len(rows)
    by = {(x["doc_id"], x["text"]): x for x in got}
    for i, t in rows:
        w, x = (t or "").split(), by[i, t]
        windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        repeated = {j + k for j, g in enumerate(windows) if windows.count(g) > 1 for k in range(3)} if len(w) < 2000 else set(range(len(w)))
        lines = [y for y in (t or "").split("\n") if y.strip()]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (len(w), sum(map(len, w)), (t or "").count("#"), len(lines) - len(set(lines)), len(repeated))
        assert x["base_failed"] == (len(w) < 50 or 2 * len(repeated) > len(w)) and (not x["base_failed"] or x["kept"] is False)
    assert quality_rules.judge(frame(spark, []), quality_rules.log_ratios(frame(spark, []), docs.select("doc_id"))).count() == 0


def test_log_likelihood_ratio_by_brute(spark):
    """Ratio and verdict of every document, from word hashes and counts made in plain Python."""
    import struct

    import xxhash

    r = random.Random(6)
    rows = [(i, " ".join(r.choice(WORDS[: 60 if i % 2 else 400]) for _ in range(r.choice((0, 1, 2, 55, 90))))) for i in range(50)] + [(None, "a b c"), (70, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__hashes", F.lit("mine")).withColumn("llr", F.lit("replaced"))
    n, trusted = 256, {i for i in range(50) if i % 2}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    chained = lambda a, b: signed(xxhash.xxh64_intdigest(struct.pack("<q", b), seed=xxhash.xxh64_intdigest(struct.pack("<q", a), seed=42)))

    def cells(t):
        h = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in (t or "").split()]
        return [x % n for x in h] + [chained(a, b) % n for a, b in zip(h, h[1:], strict=False)]

    raw, good = np.zeros(n), np.zeros(n)
    for i, t in rows:
        for c in cells(t):
            raw[c] += 1
            good[c] += i in trusted
    ratio = np.log((good + 1) / (good.sum() + n)) - np.log((raw + 1) / (raw.sum() + n))
    ids = spark.createDataFrame([(i,) for i in sorted(trusted)], "doc_id long")
    out = quality_rules.judge(docs, quality_rules.log_ratios(docs.select("doc_id", "text"), ids, n), n).collect()
    assert len(out) == len(rows) and {x["__hashes"] for x in out} == {"mine"}
    by = {(x["doc_id"], x["text"]): x for x in out}
    for i, t in rows:
        want = float(np.mean([ratio[c] for c in cells(t)])) if cells(t) else 0.0
        x = by[i, t]
        assert abs(x["llr"] - want) < 1e-9 and x["kept"] == (not x["base_failed"] and x["llr"] >= quality_rules.THRESHOLD)


def nearest_by_brute(rows, queries, k=20):
    """query_id: [(score, vec_id)] by double inner products, for rows (id, vector) of one dimension."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for q in queries:
        me = int(np.flatnonzero(ids == q)[0])
        score = (x * x[me]).sum(1)
        out[q] = [(score[j], int(ids[j])) for j in np.lexsort((ids, -score)) if ids[j] != q or (x[j] != x[me]).any()][:k]
    return out


def check_neighbours(got, rows, want, least):
    """Ranks from 1 without gaps, exact scores, order by score and id, and the share of true neighbours."""
    vector, own, hits = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows}, {}, 0
    for g in got:
        own.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"], g["score"]))
    assert set(own) == set(want)
    for q, best in want.items():
        found = sorted(own[q])
        assert [r for r, _, _ in found] == list(range(1, len(best) + 1))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(abs(s - (vector[i] * vector[q]).sum()) < 1e-12 for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in best})
    assert hits >= least * sum(map(len, want.values()))


def test_neighbours_exact_and_ties(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((300, 12)).astype(np.float32)
    x[100:180] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(400, None), (420, [0.0] * 12), (440, [float("nan")] * 12), (480, [None] * 12)]
    other = [(460, [1.0, 2.0, 3.0]), (461, [1.0, 0.0, 0.0]), (462, [0.0, 0.0, 9.0]), (500, [1.0])]
    frame_of = lambda rows: neighbours.valid(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash")))
    got = neighbours.nearest(frame_of(rows + bad + other), "vec_id % 20 = 0").collect()
    apart = [g for g in got if g["query_id"] >= 400]
    assert [(g["query_id"], g["rank"], g["vec_id"], g["score"]) for g in sorted(apart, key=lambda g: g["rank"])] == [(460, 1, 462, 27.0), (460, 2, 461, 1.0)]
    check_neighbours([g for g in got if g["query_id"] < 400], rows, nearest_by_brute(rows, range(0, 300, 20)), 0.95)
    assert neighbours.nearest(frame_of(rows[:5]), "vec_id % 20 = 0").count() == 4
    assert neighbours.nearest(frame_of(rows[:5]), "false").count() == 0
    assert neighbours.nearest(frame_of([]), "vec_id % 20 = 0").count() == 0
    again = [(0, rows[0][1]), (0, rows[0][1]), (0, rows[5][1]), (7, rows[7][1])]  # an id's other vector is a candidate, a repeated row isn't
    found = neighbours.nearest(frame_of(again), "vec_id % 20 = 0").collect()
    assert {g["vec_id"] for g in found} == {0, 7}


def test_neighbours_of_probed_lists(spark):
    """Over 60 lists, of which a part is probed: recall of 0.9 at least, for even and for clustered vectors."""
    r = np.random.default_rng(4)
    for clustered in (False, True):
        x = r.standard_normal((4000, 24)) + (6 * r.standard_normal((40, 24))[r.integers(0, 40, 4000)] if clustered else 0)
        rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
        vectors = neighbours.valid(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        with Scratch() as scratch:
            index, _ = neighbours.build(vectors, scratch)
        assert len(index.centroids) > 60 and index.probes < len(index.centroids) * (0.5 if clustered else 1)
        check_neighbours(neighbours.nearest(vectors, "vec_id % 100 = 0").collect(), rows, nearest_by_brute(rows, range(0, 4000, 100)), 0.9)


def test_dimension_scan():
    """With a wide test nothing near is abandoned; partial sums equal whole distances."""
    r = np.random.default_rng(1)
    q, x = r.standard_normal((7, 33)).astype(np.float32), r.standard_normal((33, 500)).astype(np.float32)
    distance = ((q[:, :, None] - x[None]) ** 2).sum(1)
    limits = np.sort(distance, axis=1)[:, 30].astype(np.float64)
    row, column = neighbours.scan(q, x, limits, 1e6, 16)
    assert {(i, j) for i, j in zip(*np.nonzero(distance <= limits[:, None] * 0.999), strict=True)} <= set(zip(row.tolist(), column.tolist(), strict=True))
    assert all(distance[i, j] <= limits[i] * 1.001 for i, j in zip(row, column, strict=True))


def test_mixing(spark):
    rows = [(i, f"{t} ", "big" if i < 200 else f"s{i % 4}" if i < 290 else None) for i, t in texts(300, 4, 20)] + [(None, None, "s1"), (300, "", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, entropy=0.99, passes=5.0, block=16).groupBy("source").agg(F.sum("mix_tokens").alias("t"), F.max("mix_pass").alias("p")).collect()
    t = {r["source"]: r["t"] for r in out}
    total = sum(t.values())
    share = np.array([v / total for v in t.values()])
    assert abs(-(share * np.log(share)).sum() / np.log(len(share)) - 0.99) < 0.01 and max(r["p"] for r in out) <= 5
    assert abs(total - docs.select(F.sum(mixing.tokens())).first()[0]) <= 21 * len(t)
    assert mixing.mix(docs, entropy=0.0).count() == len(rows)  # as it is: each document once
    check_order(docs, mixing.mix(docs, entropy=0.99, passes=5.0, block=16).collect(), 0.99, 5.0)
    assert mixing.mix(docs.filter("false")).count() == 0


def check_order(docs, out, entropy, passes):
    """The mix read in its order: every pass a permutation of the same blocks, another one each time; the last pass a
    prefix of its own; quotas as plain bisection gives them; and each part of the mix with each source's share."""
    rows = [(r["source"], r["doc_id"], r["text"]) for r in docs.collect()]
    words = lambda t: max(1, len((t or "").split()))
    sizes = {}
    for s, _, t in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    total, k = sum(sizes.values()), len(sizes)
    p = {s: n / total for s, n in sizes.items()}

    def at(a):
        z = {s: x**a for s, x in p.items()}
        w = {s: x / sum(z.values()) for s, x in z.items()}
        return w, -sum(x * np.log(x) for x in w.values()), max(w[s] / p[s] for s in p)

    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if at(middle)[1] >= entropy * np.log(k) else (low, middle)
    if at(low)[2] > passes:
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if at(middle)[2] <= passes else (middle, high)
    weight = at(low)[0]
    for s, n in sizes.items():
        own = sorted((r for r in out if r["source"] == s), key=lambda r: (r["mix_place"], r["mix_block"]))
        quota = int(weight[s] * total + 0.5)
        assert quota <= sum(r["mix_tokens"] for r in own) < quota + 45
        orders = []
        for q in range(max(r["mix_pass"] for r in own) + 1):
            own_pass = [r for r in own if r["mix_pass"] == q]
            blocks = list(dict.fromkeys(r["mix_block"] for r in own_pass))
            assert blocks == list(range(len(blocks)))  # places in the permutation, in reading order
            members = [frozenset((r["doc_id"], r["text"]) for r in own_pass if r["mix_block"] == b) for b in blocks]
            orders.append(members)
            if (q + 1) * n <= quota:
                assert sum(map(len, members)) == len({(i, t) for x, i, t in rows if x == s})
        whole = [o for o in orders if sum(map(len, o)) == len({(i, t) for x, i, t in rows if x == s})]
        if len(whole) > 1 and len(whole[0]) > 3:
            assert whole[0] != whole[1] and set(whole[0]) == set(whole[1])
        if len(orders) > 1 and len(whole) == len(orders) - 1:
            assert all(b in set(whole[0]) for b in orders[-1][:-1]) and any(orders[-1][-1] <= b for b in whole[0])
        half = sum(r["mix_tokens"] for r in own if r["mix_place"] < 0.5)
        assert abs(half - quota / 2) <= max(r["mix_tokens"] for r in own) * 20 + n / 4


def test_html_wrappers_headlines_and_hostile_pages(spark):
    """Through extract_pages(): class names that mention a sidebar, a headline in a header, split references, and
    pages of a megabyte that would take hours in quadratic time."""
    import time

    p = "<p>" + "A long paragraph of words, with commas. " * 10 + "</p>"
    body = ("A long paragraph of words, with commas. " * 10).strip()
    rows = [(c, f'<body><nav><a href=/>x</a></nav><div class="{c}"><h1>Head</h1>{p}{p}</div></body>', f"Head {body} {body}") for c in ("content has-sidebar", "layout-with-sidebar", "post form-page", "article-header", "entry copyright-law")]
    rows += [("header", f"<header>Site</header><article><header><h1>Headline</h1></header>{p}</article>", f"Headline {body}"), ("references", "<article><p>x &am<b>p;</b> &amp; y</p></article>", "x &amp; & y"), ("null", None, ""), ("empty", "", ""), ("unended", "<article><p>text <a href=", "text"), ("comment", "<article><p>text<!-- > never", "text")]
    hostile = [("a", "<a " * 350_000, ""), ("div", "<div>" * 100_000 + "deep", "deep"), ("span", "<p>" + "<span>" * 100_000 + "deep", "deep"), ("quote", '<a x=">' * 100_000, ""), ("comments", "<!-- " * 200_000, "")]
    pages = spark.createDataFrame([(k, h) for k, h, _ in rows + hostile], "url string, html string")
    began = time.time()
    got = {r["url"]: r["text"] for r in html_text.extract_pages(pages).collect()}
    assert time.time() - began < 60
    for name, _, want in rows + hostile:
        assert got[name] == want, name
    assert html_text.extract_pages(pages.filter("false")).count() == 0


def test_html():
    page = '<nav><a href=/>Home</a></nav><div class="post"><h1>A &amp; B</h1><p>First long   paragraph of the\narticle, with words.<p>Second <b>one</b>, &eacute;.<ul><li>x point here<li>y point there</ul></div><div class="comments"><p>' + "nice " * 200 + "</p></div><footer>foot</footer><script>var x='<p>no</p>'</script>"
    assert html_text.extract(page) == "A & B First long paragraph of the article, with words. Second one, é. x point here y point there"
    assert [html_text.extract(x) for x in (None, "", "<div></div>", "plain", "<p>open <b>bold", "<a" * 50)][:5] == ["", "", "", "plain", "open bold"]
    assert html_text.extract("<article>" + "<div>" * 3000 + "deep") == "deep"


def test_html_article_in_several_boxes():
    part = lambda k: " ".join(f"<p>{k}{i} {'word ' * 100}</p>" for i in range(5))
    read = lambda html: [x for x in html_text.extract(html).split() if x != "word"]
    both = [f"{k}{i}" for k in "ab" for i in range(5)]
    links = "<ul>" + "<li><a href=/>some other page</a>" * 9 + "</ul>"
    assert read(f"<div id=content><div class=part>{part('a')}</div>{links}<div class=part>{part('b')}</div></div>") == both
    assert read(f"<div>{part('a')}</div><div>{part('b')}</div><div>short line</div>{links}") == [*both, "short", "line"]
    assert read(f"<div id=content><h2>Title</h2><div>{part('a')}</div><div>{part('b')}</div></div><div><b>x</b><i>y</i></div>") == ["Title", *both]
    assert read(f"<article>{part('a')}</article><article>{part('b')}</article><div>{part('c')}</div>") == both


def test_html_wrappers_named_for_what_is_beside():
    text = "word " * 100
    article, beside = f"<article><p>{text}</p></article>", "<div class=sidebar><p>" + "other " * 300 + "</p></div>"
    for name in ("site has-sidebar", "with-sidebar", "no-comments", "layout--with-sidebar", "sidebar-right", "sidebar", "page search"):
        for inner in (article, article.replace("<article", "<article class='post tag-news'"), f"<main><p>{text}</p></main>"):
            assert html_text.extract(f"<div id=page class='{name}'>{inner}{beside}</div>") == text.strip(), name
    for name in ("site has-sidebar", "no-comments", "content-header-wrap", "page search"):  # most of the characters, without an article
        assert html_text.extract(f"<div class='{name}'><p>{text}</p></div><p>a few more</p>").startswith(text.strip()), name
    other = "<div class='related-posts'><article><p>" + "other " * 90 + "</p></article></div><div id=comments class=comments-area><article class=comment-body><p>" + "other " * 90 + "</p></article></div>"
    assert html_text.extract(f"{article}{other}") == text.strip()
    assert html_text.extract(f"<div class=post><p>{text}</p></div><div id=comments class=comments-area><article class=comment-body>{text}{text}</article></div>") == text.strip()


def test_licences():
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that:\n\n* Redistributions of source code must retain the above copyright notice.\n\n* Redistributions in binary form must reproduce the above copyright notice."
    cases = {bsd: ["BSD-2-Clause"], "Licensed under the Apache License, Version 2.0.\nText": ["Apache-2.0"], "// SPDX-License-Identifier: MIT": ["MIT"], "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"], "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0"], "GNU General Public License, version 2 or later version": ["GPL-2.0-or-later"], "": [], "no such words": []}
    for t, want in cases.items():
        assert licences.licences([x[0] for x in licences.identify(t)]) == want, t
    assert licences.identify(None) == [] and licences.identify("See the license terms.")[0][0] == "UNKNOWN"


def test_licence_versions_expressions_and_titles():
    """The version that is named counts; an SPDX expression gives all its licences; a title needs no verb."""
    cases = {
        "Licensed under the Apache License, Version 1.1": (["Apache-1.1"], False),
        "Licensed under the Apache License, Version 1.0.": (["Apache-1.0"], False),
        "Licensed under the Apache License, Version 2.1.": ([], True),
        "Licensed under the Apache License, Version 3": ([], True),
        "Licensed under the Apache License.": (["Apache-2.0"], False),
        "Licensed under the Apache License (the License), and more": (["Apache-2.0"], False),
        "GNU General Public License, version 2.5": ([], True),
        "SPDX-License-Identifier: MIT OR Apache-2.0": (["MIT", "Apache-2.0"], False),
        "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause": (["MIT", "Apache-2.0", "BSD-3-Clause"], False),
        "SPDX-License-Identifier: ( GPL-2.0-only WITH Classpath-exception-2.0 ) OR ISC": (["GPL-2.0-only WITH Classpath-exception-2.0", "ISC"], False),
        "SPDX-License-Identifier: MIT and so on": (["MIT"], False),
        "Apache License, Version 2.0": (["Apache-2.0"], False),
        "MIT License": (["MIT"], False),
        "The MIT License (MIT)\n": (["MIT"], False),
        "BSD 3-Clause License": (["BSD-3-Clause"], False),
        "The Unlicense": (["Unlicense"], False),
        "ISC License": (["ISC"], False),
        "Apache License\nVersion 2.0, January 2004": (["Apache-2.0"], False),
        "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007": (["GPL-3.0"], False),
        "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": (["LGPL-3.0"], False),
        "This project is MIT licensed.": (["MIT"], False),
        "It is Apache 2.0 licensed.": (["Apache-2.0"], False),
        "A licence by Mit. Licensed goods.": ([], True),
    }
    assert {t: licences.matched([x[0] for x in licences.identify(t)]) for t in cases} == cases


def test_licence_scan_takes_time_in_proportion():
    """A megabyte of blanks, of newlines, or of both, after a word that makes the text be read."""
    began = time.perf_counter()
    for gap in (" " * 10**6, "\n" * 10**6, " \n" * (5 * 10**5), ". " * (5 * 10**5), " " * 10**6 + "\n# "):
        assert [x[0] for x in licences.identify("a licence" + gap + "x")] == ["UNKNOWN"]
    assert time.perf_counter() - began < 5


def test_licences_of_long_sentences():
    """Length decides nothing: texts without stops or newlines are one sentence, and may name several licences."""
    prose, table = "漢字" * 1500, "cell | " * 900
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, "
    cases = {
        f"{prose}licensed under the Apache License, Version 2.0{prose}": ["Apache-2.0"],
        f"{prose}。Licensed under CC BY-SA 4.0。{prose}": ["CC-BY-SA-4.0"],
        f"{table}{mit}{table}the above copyright notice and this permission notice shall be included in all copies{table}": ["MIT"],
        f"{table}released under the MIT license, or the GNU GPL v3 {table}, all rights reserved": ["MIT", "GPL-3.0", "AllRightsReserved"],
        f'{table}SPDX-License-Identifier: "Apache-2.0" {table}': ["Apache-2.0"],
    }
    for t, want in cases.items():
        assert licences.licences([x[0] for x in licences.identify(t)]) == want, t.replace(prose, "").replace(table, "")
    assert [x[0] for x in licences.identify(f"{table} a license of its own {table}")] == ["UNKNOWN"]
    assert len(licences.identify("licence " + "the software is provided by " * 9000 + "-" * 200000)) == 1  # read once, not once a start


def brute_licences(identifiers):
    """Rules tried one after another, each from the start again, until it finds nothing."""
    left, found = list(identifiers), []
    for licence, rule in licences.RULES:
        while True:
            places = []
            for name in rule:
                at = next((i for i in range(places[-1] + 1 if places else 0, len(left)) if left[i] == name), None)
                if at is None:
                    break
                places.append(at)
            if len(places) < len(rule):
                break
            found.append((places[0], licence))
            for i in places:
                left[i] = None
    return list(dict.fromkeys(x for _, x in sorted(found))), any(x and x not in licences.BESIDE for x in left)


def test_licence_rules_equal_brute_force():
    r = random.Random(8)
    names = sorted({x for _, rule in licences.RULES for x in rule} | {"Copyright", "UNKNOWN"})
    for k in range(400):
        some = r.sample(names, r.randint(1, 8))
        sequence = [r.choice(some) for _ in range(r.randint(0, 30))]
        assert licences.matched(sequence) == brute_licences(sequence), sequence


def test_licence_scan_of_a_table(spark):
    """Through scan(): a licence at the end of a long sentence, what no rule used, awkward rows, linear time."""
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. "
    rows = [(1, "word " * 20_000 + "Licensed under the Apache License, Version 2.0"), (2, grant), (3, grant + "The above copyright notice and this permission notice shall be included in all copies. The software is provided as is."), (4, "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."), (5, None), (6, ""), (7, "The software is provided as is. Copyright 2020 X"), (7, "The software is provided as is. Copyright 2020 X"), (None, "Some unheard-of licence."), (8, grant * 20_000)]
    out = licences.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("names", F.lit("clash"))).collect()
    assert len(out) == len(rows) and {r["names"] for r in out} == {"clash"}
    got = {(r["doc_id"], r["text"]): (r["licences"], r["unknown"]) for r in out}
    want = [(["Apache-2.0"], False), ([], True), (["MIT"], False), (["GPL-3.0-or-later"], False), ([], False), ([], False), ([], False), ([], False), ([], True), ([], True)]
    assert [got[r] for r in rows] == want
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licence_trigger_passes_known_sentences():
    examples = {
        "SPDX": "SPDX-License-Identifier: MIT", "ApacheRef2": "Released under the Apache License 2.0", "ApacheRef11": "Released under the Apache License 1.1", "ApacheRef1": "Released under the Apache Software License, Version 1.0", "Version3Plus": "either version 3 of the License, or (at your option) any later version", "Version21Plus": "version 2.1 of the License, or any later version", "Version2Plus": "either version 2 of the License, or (at your option) any later version", "AGPLRef3Plus": "AGPLv3 or later", "LGPLRef3Plus": "LGPL3+", "LGPLRef21Plus": "LGPL 2.1 or newer", "AGPLRef3": "AGPLv3 covers it", "LGPLRef3": "covered by LGPL3", "LGPLRef21": "distributed under the LGPLv2.1.",
        "GPLRef3Plus": "GPLv3 or any later version", "GPLRef2Plus": "GPL2, or (at your option) any later version", "GPLRef3": "Released under GPLv3.", "GPLRef2": "Released under GPLv2.", "AGPLRef": "the GNU Affero General Public License", "LGPLRef": "the GNU Library General Public License", "GPLRef": "the GNU General Public License as published", "MITRef": "Provided under MIT",
        "MITGrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "MITNotice": "shall be included in all copies or substantial portions of the Software", "AsIs": "The software is provided 'as is'",
        "ISCGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "BSDGrant": "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "BSDSource": "Redistributions of source code must retain it", "BSDBinary": "Redistributions in binary form must reproduce it", "BSDNoEndorse": "Neither the name of Acme may be used to endorse products", "BSDRef3": "under the 3-clause BSD", "BSDRef2": "under simplified BSD",
        "BSDRef": "under a BSD-style license", "MPLRef2": "MPL2 covers it", "CCRef": "Text available under CC BY-SA 4.0.", "EPLRef2": "under the EPL 2.0", "EPLRef1": "Eclipse Public License - v 1.0", "EUPLRef12": "EUPL v1.2", "CDDLRef1": "CDDL 1.0", "ArtisticRef2": "Artistic License 2.0", "BoostRef1": "Boost Software License - Version 1.0", "OFLRef11": "SIL Open Font License, Version 1.1", "PSFRef2": "PSF License Version 2", "ZlibRef": "under the zlib License", "ZlibGrant": "Permission is granted to anyone to use this software for any purpose, including commercial applications", "ZlibOrigin": "The origin of this software must not be misrepresented", "WTFPLRef": "it is WTFPL", "CC0Ref": "It is CC0", "PublicDomain": "This is free and unencumbered software released into the public domain", "AllRights": "All  rights reserved", "Copyright": "(c) 2020 Acme",
    }
    assert list(examples) == [name for name, _ in licences.SENTENCES]
    for name, t in examples.items():
        assert [x[0].partition(":")[0].replace("CC", "CCRef") if x[0].startswith("CC:") else x[0].partition(":")[0] for x in licences.identify(t)] == [name], t
    assert licences.identify("© 2020 Acme")[0][0] == "Copyright"
    want = {"Released under GPLv3.": "GPL-3.0", "distributed under the LGPLv2.1.": "LGPL-2.1", "AGPLv3 or later": "AGPL-3.0-or-later", "Text available under CC BY-SA 4.0.": "CC-BY-SA-4.0"}
    assert {t: licences.licences([x[0] for x in licences.identify(t)])[0] for t in want} == want


def junk(i):
    r = random.Random(i)
    return " ".join((r.choice(WORDS).upper() + "!!") for _ in range(60)) if i % 2 else " ".join(r.choice(WORDS) + "%%%" for _ in range(60))


def test_quality(spark):
    r = random.Random(9)
    good = [(i, ". ".join(" ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega", "and", "the", "of"]) + str(r.randrange(90)) for _ in range(9)).replace("0", "o") for _ in range(8)) + ".") for i in range(160)]
    docs = frame(spark, good + [(1000 + i, junk(i)) for i in range(40)] + EDGES)
    out = {(x["doc_id"], x["text"]): x["kept"] for x in quality.score(docs, quality.train(docs)).collect()}
    assert all(out[i, t] for i, t in good) and not any(out[1000 + i, junk(i)] for i in range(40))
    assert out[900, None] is False and out[902, "  \n\t "] is False
    assert quality.score(frame(spark, []), quality.train(frame(spark, []))).count() == 0


def test_toxicity_and_language(spark):
    rows = [(i, t + (" stupid moron" if i % 3 == 0 else "")) for i, t in texts(240, 8, 25)]
    labelled = spark.createDataFrame([(i, t, int(i % 3 == 0)) for i, t in rows if i < 180] + [(None, "x", 1), (1, None, None)], "doc_id long, text string, toxic int")
    model = toxicity.train(labelled)
    out = {x["doc_id"]: x for x in toxicity.score(frame(spark, rows + EDGES), model).collect()}
    assert all(out[i]["predicted"] == int(i % 3 == 0) for i, _ in rows) and 0 <= out[900]["score"] <= 1
    assert toxicity.score(frame(spark, EDGES), toxicity.train(labelled.filter("false"))).filter("predicted = 1").count() == 0
    speech = {"xx": "the quick brown fox jumps over lazy dogs", "yy": "über die brücke läuft ein grüner käfer"}
    known = spark.createDataFrame([(i, v, k) for i in range(9) for k, v in speech.items()] + [(1, None, "xx"), (2, "words", None)], "doc_id long, text string, lang string")
    lang = language.train(known)
    got = {x["doc_id"]: x["lang_pred"] for x in language.predict(frame(spark, [(1, "brown dogs jump"), (2, "grüne brücken"), (3, "123 !!"), (4, None), (5, "")]), lang).collect()}
    assert got == {1: "xx", 2: "yy", 3: "und", 4: "und", 5: "und"}
    assert language.predict(frame(spark, [(1, "a")]), language.train(known.filter("false"))).first()["lang_pred"] == "und"
