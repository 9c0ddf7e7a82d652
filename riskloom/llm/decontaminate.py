"""Benchmark decontamination over a distributed positional inverted index (DataFrame functions only).

Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters.  A benchmark window is ``WIDTH`` (13)
consecutive words of one item; a shorter item is one window.  A document word is hit if it stands in an
occurrence of a window.

1. One pass counts how often each benchmark term occurs in the corpus (combined before the shuffle).
2. Each window keeps its ``RARE`` rarest positions; windows with a term the corpus lacks are gone.
3. Postings (term, document, position) of those rare terms make the index.  ``postings`` builds it; its lists are
   intersected after subtracting each term's offset in its item: what is left are alignments (document, item,
   shift) at which all rare terms of a window stand where they should.
4. ``phrases`` compares the words of each remaining alignment exactly; ``proximity`` answers with documents that
   hold all given terms within a distance instead.

The benchmark is a stated query set: its windows are taken in blocks of about ``BLOCK`` bytes, by hash, and each block's
tables - of a size known that way - are broadcast to one pass over the corpus; corpus words are never shuffled by term.
Rare terms' postings are dealt by (document, item, shift), so a frequent term is no hot task, and no
list of a term is ever collected.

A document is known to the index by a hash of its id and text, and compared word by word in the end: rows without an id
are no hot key.

Edge cases: null text has no words, as a blank one; a document without words is not contaminated.  Rows without an id and
rows that share one are judged each by its own text.  Repeated rows give equal rows.  Null item_ids count as the empty string; repeated items count once.  Empty tables
give empty results, an empty benchmark no hits.  Other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WIDTH = 13
RARE = 2
#: Bytes of windows in a block; what is broadcast is at most a few times as large.
BLOCK = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words as they are matched: A-Z lower-cased, nothing else changed."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, -1), "")


def n_words(text: Column) -> Column:
    """How many words; lower is faster than translate, and neither makes nor takes a separator."""
    return F.size(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), ""))


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item, item_id, start, words of each window."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).distinct()
    items = items.where(F.size("w") > 0).select("item_id", "w", F.xxhash64("item_id", "w").alias("item"))
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0))))
    return items.select("item", "item_id", "w", start.alias("start")).select("item", "item_id", "start", F.expr(f"slice(w, start + 1, {width})").alias("words"))


def key(doc_id: Column, text: Column) -> Column:
    """What the index knows a document by."""
    return F.xxhash64(doc_id, text)


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often each of the terms occurs in the documents."""
    return docs.select(F.explode(words(F.col("text"))).alias("term")).join(terms, "term").groupBy("term").agg(F.count("*").alias("n"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional inverted index of the terms: term, doc_id, pos (from 0)."""
    return docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "term")).join(terms, "term").select("term", "doc_id", "pos")


def proximity(docs: DataFrame, terms: list[str], distance: int) -> DataFrame:
    """doc_id, start, end: stretches of at most ``distance`` words from one of the terms to the last of them, all being there."""
    terms = {t.translate(str.maketrans(UPPER, LOWER)) for t in terms}
    index = postings(docs, F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in terms], "term string")))
    span = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(0, distance - 1)
    found = index.select("doc_id", "pos", F.size(F.collect_set("term").over(span)).alias("n"), F.max("pos").over(span).alias("end"))
    return found.where(F.col("n") == len(terms)).select("doc_id", F.col("pos").alias("start"), "end")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, rare: int = RARE) -> DataFrame:
    """Each row of docs (doc_id, text) with n_words, n_hit, n_items, items (sorted item ids), contaminated."""
    met = alignments(docs, benchmark, width, rare)
    return phrases(docs.select(F.struct("doc_id", "text").alias("row")), met).select("row.doc_id", "n_words", "n_hit", "n_items", "items", "contaminated")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, rare: int = RARE) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated: texts are shuffled once, to be compared and kept."""
    met = alignments(docs, benchmark, width, rare)
    return phrases(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), met).where("NOT contaminated").select("row.*")


def alignments(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, rare: int = RARE, block: int = BLOCK) -> DataFrame:
    """doc_id (the index's key), at, item_id, words: where the rare terms of a window stand as in it."""
    text = F.col("text").cast("string")
    docs = docs.select(key(F.col("doc_id"), text).alias("doc_id"), text.alias("text"))
    wins = cut(windows(benchmark, width), "windows")
    # the words of a window, and what a row of each of them weighs in the tables below
    total = wins.agg(F.sum(F.octet_length(F.array_join("words", " ")) + 64 * F.size("words"))).collect()[0][0] or 0
    blocks = -(-total // block)
    out = [_aligned(docs, wins.where(F.pmod(F.xxhash64("item", "start"), F.lit(blocks)) == i) if blocks > 1 else wins, rare) for i in range(max(1, blocks))]
    return functools.reduce(DataFrame.unionAll, out)


def _aligned(docs: DataFrame, wins: DataFrame, rare: int) -> DataFrame:
    """The alignments of one block of windows."""
    terms = wins.select("item", "item_id", "start", "words", F.posexplode("words").alias("offset", "term"))
    known = cut(frequencies(docs, F.broadcast(terms.select("term").distinct())), "frequencies")
    # rank the places of each window by how rare their term is; a window with an unknown term occurs nowhere
    by = Window.partitionBy("item", "start")
    ranked = terms.join(known, "term", "left").withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(by)).where("least > 0")
    ranked = ranked.withColumn("rank", F.row_number().over(by.orderBy("n", "term", "offset"))).where(F.col("rank") <= rare)
    ranked = ranked.withColumn("place", F.col("start") + F.col("offset"))
    needs = ranked.groupBy("item", "item_id", "start").agg(F.collect_set("place").alias("needs"), F.first("words").alias("words"))
    needs = cut(needs, "needs")
    probes = cut(ranked.select("term", "item", "place").distinct(), "probes")
    index = cut(postings(docs, F.broadcast(probes.select("term").distinct())), "postings")
    aligned = index.join(F.broadcast(probes), "term").select("doc_id", "item", (F.col("pos") - F.col("place")).alias("shift"), "place")
    aligned = aligned.groupBy("doc_id", "item", "shift").agg(F.collect_set("place").alias("places"))
    met = aligned.join(F.broadcast(needs), "item").where(F.size(F.array_except("needs", "places")) == 0)
    met = met.select("doc_id", (F.col("shift") + F.col("start")).alias("at"), "item_id", "words").where("at >= 0")
    return cut(met, "alignments")


def phrases(docs: DataFrame, met: DataFrame) -> DataFrame:
    """Rows of docs (a struct row with doc_id and text) with the exact matches among alignments (doc_id, at, item_id, words).
    The join is a sort-merge join at every size: each text travels once, whatever the number of alignments."""
    each = met.groupBy("doc_id").agg(F.collect_set(F.struct("at", "item_id", "words")).alias("met")).withColumnRenamed("doc_id", "met_id")
    text = F.col("row.text").cast("string")
    out = docs.join(each.hint("merge"), key(F.col("row.doc_id"), text) == F.col("met_id"), "left").select("row", "met")
    plain = out.select("row", "met", F.when(F.col("met").isNull(), n_words(text)).alias("n"), F.when(F.col("met").isNotNull(), words(text)).alias("w"))
    exact = F.expr("filter(met, m -> slice(w, m.at + 1, size(m.words)) = m.words)")
    plain = plain.select("row", F.coalesce("n", F.size("w")).cast("long").alias("n_words"), F.coalesce(exact, F.array().cast(out.schema["met"].dataType)).alias("hits"))
    places = F.expr("array_distinct(flatten(transform(hits, m -> sequence(m.at, m.at + size(m.words) - 1))))")
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda m: m["item_id"])))
    out = plain.select("row", "n_words", F.size(places).cast("long").alias("n_hit"), items.alias("items"))
    return out.select("row", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
