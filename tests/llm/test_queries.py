"""Every registered query of the package on the smallest tables, and every pipeline stage on awkward rows."""

import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerfold.llm import html_text, language, licences, mixing, packing, quality, toxicity
from ledgerfold.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")

COLUMNS = {
    "op1_source_mixing": {"doc_id": "bigint", "source": "string", "mix_pass": "int", "mix_block": "int", "mix_place": "double", "mix_tokens": "bigint"},
    "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_licence_scan": {"doc_id": "bigint", "licences": "array<string>", "sentence_ids": "array<string>", "n_sentences": "bigint", "unknown": "boolean"},
    "op4_quality": {"doc_id": "bigint", "votes": "string", "quality": "double", "kept": "boolean"},
    "op5_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op6_nearest_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op7_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op8_ngram_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op9_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op10_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op11_merkle_manifest": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
    "op12_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    "op13_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
}


def rows_of(name):
    return {"op5_html_text": "pages", "op6_nearest_neighbours": "embeddings"}.get(name, "documents")


@pytest.fixture(scope="module")
def results(spark):
    return {}


@tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_returns_its_contract(spark, results, name):
    out = QUERIES[name](spark, SF)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    found = results[name] = out.collect()
    there = spark.read.parquet(f"{SF}/{rows_of(name)}.parquet")
    if name == "op6_nearest_neighbours":
        queries = there.filter("vec_id % 20 = 0").count()
        assert len(found) == 20 * queries and {r["rank"] for r in found} == set(range(1, 21))
    elif name not in ("op1_source_mixing", "op9_packing", "op12_hard_negatives"):
        assert len(found) == there.count()


@tables
def test_held_out_folds_and_quality_of_models(spark, results):
    for name, divisor, fold in (("op2_toxicity", 3, 1), ("op10_language_id", 4, 2)):
        rows = results.get(name) or QUERIES[name](spark, SF).collect()
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % divisor == fold) and 0 <= r["score"] <= 1 for r in rows)
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    scores = [(r["score"], toxic[r["doc_id"]]) for r in (results.get("op2_toxicity") or QUERIES["op2_toxicity"](spark, SF).collect()) if r["doc_id"] in toxic]
    assert all(p == (s >= 0.7) for p, s in ((r["predicted"], r["score"]) for r in results.get("op2_toxicity", [])))
    assert np.mean([s for s, t in scores if t]) > np.mean([s for s, t in scores if not t])


@tables
def test_packed_ids_are_the_tokenizers(spark, results):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = results.get("op9_packing") or QUERIES["op9_packing"](spark, SF).collect()
    pieces = {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(texts)
    for doc, own in list(pieces.items())[:60]:
        ids, at = np.array(t.encode(texts[doc] or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


CLASHES = ("kept", "votes", "quality", "score", "lang_pred", "mix_pass", "mix_block", "mix_place", "mix_tokens", "Kept_", "__row", "__h", "__part", "__letter", "node", "component_id")


def awkward(spark, clean: int):
    """Plain prose, and rows that are null, empty, repeated, tied or very long; every column that an operator makes is there already."""
    sentence = ["the", "river", "runs", "through", "a", "valley", "where", "people", "have", "lived", "for", "many", "years", "and", "grow", "corn"]
    r = np.random.default_rng(3)
    rows = [(i, " ".join(r.choice(sentence, 60)) + ".", "en", "a" if i % 3 else "b") for i in range(clean)]
    rows += [(1, rows[1][1], "en", "a"), (1, rows[1][1], "en", "a"), (900, None, "en", "a"), (901, "", None, None), (902, " \n ", "en", "b"), (None, rows[2][1], "en", None), (None, None, None, None), (903, "word and other words here " * 30_000, "en", "c"), (904, "1234 5678", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return docs.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stage_on_awkward_rows(spark, name, stage):
    docs = awkward(spark, 40)
    out = stage(spark, docs, "")
    assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    rows = out.collect()
    assert rows and all(r[c] == f"clash {c}" for r in rows for c in CLASHES)
    known = {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
    assert {(r["doc_id"], r["text"]) for r in rows} <= known
    assert stage(spark, docs.filter("false"), "").count() == 0
    if name == "language ID":
        assert {r["doc_id"] for r in rows}.isdisjoint({900, 901, 902, 904}) and {r["doc_id"] for r in rows} >= {0, 1, 2, 903}
    if name == "n-gram Jaccard join":
        assert sum(r["doc_id"] == 1 for r in rows) == 1 and not any(r["doc_id"] is None and r["text"] for r in rows)


def test_last_stage_on_awkward_rows(spark):
    docs = awkward(spark, 5)
    rows = corpus_pipeline.packing_stage(spark, docs, "").collect()
    assert sum(r["start"] == 0 for r in rows) == docs.count()
    assert corpus_pipeline.packing_stage(spark, docs.filter("false"), "").count() == 0


def test_operators_keep_clashing_columns(spark):
    """An operator replaces only the columns that it says it makes."""
    docs = awkward(spark, 8)
    own = {"mix": ("mix_pass", "mix_block", "mix_place", "mix_tokens"), "language": ("lang_pred", "score"), "toxicity": ("score",), "licences": (), "quality": ("votes", "quality", "kept")}
    model = toxicity.train(docs.select("doc_id", "text").withColumn("toxic", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0)))
    outs = {"mix": mixing.mix(docs), "language": language.predict(docs, language.train(docs)), "toxicity": toxicity.score(docs, model), "licences": licences.scan(docs), "quality": quality.score(docs, quality.train(docs))}
    for name, out in outs.items():
        assert set(docs.columns) <= set(out.columns)
        assert all(r[c] == f"clash {c}" for r in out.collect() for c in CLASHES if c not in own[name]), name
    pages = docs.withColumn("html", F.concat(F.lit("<article><p>"), "text")).withColumn("__text", F.lit("mine"))
    assert {r["__text"] for r in html_text.extract_pages(pages).collect()} == {"mine"}


@tables
def test_pipeline_from_end_to_end(spark):
    """What is packed is what the stages kept: known documents, whole, in sequences without gaps."""
    rows = corpus_pipeline.run(spark, SF).collect()
    known = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert rows and {r["doc_id"] for r in rows} <= known
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in pieces.values():
        assert sum(r["length"] for r in own) % own[0]["doc_tokens"] == 0  # as often as the mix has it
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
