"""Which items stand word for word in which texts, without comparing each with each."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions import text
from ledgerfold.sources.scratch import written

#: Words of an item that are looked up: its second to ninth; of a shorter one all but the first and the last.
LONGEST = 8
#: Words of an item that is searched for as it is: the few between its first and last stand in too many texts.
SHORT_WORDS = 5
#: Items up to which the hashes of their words are broadcast (20 bytes each); beyond, they are joined by a shuffle.
FEW_ITEMS = 100_000
#: Bytes of short items that are searched for at once.
SHORT_BYTES = 4 << 20


def words(c: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")


def verbatim_pairs(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id") -> DataFrame:
    """The pairs (doc, item) where the item's text, stripped, is there and stands in the document's text.

    An item begins and ends anywhere, in a word too, but the words between its first and its last are whole words of
    the text. Up to eight of them are hashed; a text gives the hashes of its runs of as many words as an item has
    there, for each such number; where they meet the texts are compared. Items of up to SHORT_WORDS words have none
    between, or so few that they'd meet most texts: all of these are searched for at once while a text is read (see
    _short). The items are made once, as a table.
    """
    sought = items.select(item, F.col("text").alias("__item"), words(text.stripped(F.col("text"))).alias("__iw")).filter(text.stripped(F.col("text")) != "")
    sought = written(sought, "items")
    length = F.least(F.size("__iw") - 2, F.lit(LONGEST))
    keyed = sought.filter(F.size("__iw") > SHORT_WORDS).select(item, length.cast("int").alias("__n"), F.xxhash64(F.slice("__iw", F.lit(2), length)).alias("__head"))
    lengths = sorted(r["__n"] for r in keyed.select("__n").distinct().collect())  # a few
    texts = documents.select(doc, F.col("text").alias("__text"))
    found = _short(texts, sought.filter(F.size("__iw") <= SHORT_WORDS).select(item, text.stripped(F.col("__item")).alias("__item")), doc, item)
    if lengths:
        each = F.explode(F.array(*(F.lit(n) for n in lengths)))
        runs = texts.select(doc, words(F.col("__text")).alias("__w")).select(doc, "__w", each.alias("__n")).filter(F.size("__w") >= F.col("__n"))
        heads = F.transform(F.sequence(F.lit(1), F.size("__w") - F.col("__n") + 1), lambda i: F.xxhash64(F.slice("__w", i, F.col("__n"))))
        few = keyed.limit(FEW_ITEMS + 1).count() <= FEW_ITEMS  # then runs that no item has go before any shuffle
        met = runs.select(doc, "__n", F.explode(heads).alias("__head")).join(F.broadcast(keyed) if few else keyed, ["__n", "__head"]).select(doc, item).distinct()
        compared = met.join(texts, doc).join(sought.select(item, "__item"), item).filter(text.verbatim(F.col("__item"), F.col("__text")))
        found = found.union(compared.select(doc, item))
    return found


def _short(texts: DataFrame, sought: DataFrame, doc: str, item: str) -> DataFrame:
    """Pairs for short items: a pass over the texts for each block of them, with an automaton of all of the block."""
    size = sought.agg(F.coalesce(F.sum(F.octet_length("__item") + 16), F.lit(0)).alias("s")).first()["s"]
    kinds = dict(texts.dtypes) | dict(sought.dtypes)
    schema = f"{doc} {kinds[doc]}, {item} {kinds[item]}"
    out = texts.sparkSession.createDataFrame([], schema)
    blocks = -(-size // SHORT_BYTES)
    for k in range(blocks):
        own = [(r["__item"], r[item]) for r in sought.filter(F.pmod(F.xxhash64("__item"), F.lit(blocks)) == k).collect()]  # SHORT_BYTES, about
        out = out.union(texts.mapInArrow(_searcher(own, doc, item), schema))
    return out


def _searcher(items: list, doc: str, item: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, owners = ahocorasick.Automaton(), {}
        for sought, id_ in items:
            owners.setdefault(sought, []).append(id_)
        for sought in owners:
            automaton.add_word(sought, sought)
        if owners:
            automaton.make_automaton()
        for batch in batches:
            docs, found = [], []
            for i, whole in enumerate(batch["__text"].to_pylist()):
                for sought in {x for _, x in automaton.iter(whole)} if whole and owners else ():
                    docs += [i] * len(owners[sought])
                    found += owners[sought]
            ids = batch[doc].take(pa.array(docs, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, kind)], names=[doc, item])

    kind = pa.int64() if not items or isinstance(items[0][1], int) else pa.string()
    return run
