"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles.

A test item of n shingles is contained in a document that holds at least
ceil(0.75 n) of them.  Items are partitioned by size (powers of two); each item
is sketched by the k = n - ceil(0.75 n) + 1 smallest hashes of its shingles, its
bottom-k MinHash.  A document that contains the item must hit that sketch, so
the sketch alone, a quarter of the items' shingles, finds all candidates however
long a document is, and documents too short for a partition meet none of its
items.  Candidate pairs alone are then verified: the shingles of candidate
documents are compared as text with those of their items.

All of it is DataFrame operations.  The sketch is broadcast in blocks of at most
SKETCH_ROWS rows, one pass over the documents for each, so documents' shingles
are never shuffled; the items are the query set, the documents the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import settle

SHINGLE = 5
#: An item is in a document with at least so many per cent of its shingles.
PERCENT = 75
#: Rows of the sketch (32 bytes each) that one pass broadcasts, about.
SKETCH_ROWS = 500_000
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ITEM = ["item_id", "item_key"]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _CAPITALS, _SMALL), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _each(words: Column, n_words: Column, size: int, make) -> Column:
    """make() of all runs of `size` words of an array column."""
    runs = F.transform(F.sequence(F.lit(0), n_words - size), lambda i: make([F.get(words, i + k) for k in range(size)]))
    return F.when(n_words >= size, runs).otherwise(F.slice(F.array(make([F.lit("")] * size)), 1, 0))


def _hash(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def _text(words: list[Column]) -> Column:
    return F.concat_ws(" ", *words)


def _shingled(df: DataFrame, sizes: list[int], make, *keys: str) -> DataFrame:
    """The keys, n_words, grams (of all the sizes, one after the other)."""
    words = df.select(*keys, _words(F.col("text")).alias("words"))
    counted = words.select(*keys, "words", F.size("words").alias("n_words"))
    grams = [_each(F.col("words"), F.col("n_words"), s, make) for s in sizes]
    return counted.select(*keys, "n_words", (F.concat(*grams) if len(grams) > 1 else grams[0]).alias("grams"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, item_key, size (words of its shingles), n_item, class_min, gram, shingle, in_sketch: a row for each distinct shingle."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    words = items.select("item_id", F.xxhash64("text").alias("item_key"), _words(F.col("text")).alias("words"))
    words = words.withColumn("n_words", F.size("words"))
    both = lambda w: F.struct(_hash(w).alias("gram"), _text(w).alias("shingle"))
    parts = []
    for size in range(1, SHINGLE + 1):  # an item with fewer than SHINGLE words is one shingle of that many words
        mine = words.where(F.least("n_words", F.lit(SHINGLE)) == size)
        own = F.array_sort(F.array_distinct(_each(F.col("words"), F.col("n_words"), size, both)))
        parts.append(mine.select(*_ITEM, F.lit(size).alias("size"), own.alias("own")))
    rows = reduce(DataFrame.union, parts).distinct().withColumn("n_item", F.size("own").cast("long"))
    low = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n_item").cast("double"))))  # the size partition's smallest size
    rows = rows.withColumn("depth", F.expr(f"n_item - (n_item * {PERCENT} + 99) div 100 + 1")).withColumn("class_min", F.ceil(low * PERCENT / 100).cast("long"))
    out = rows.select(*_ITEM, "size", "n_item", "class_min", "depth", F.posexplode("own").alias("place", "x"))
    return out.select(*_ITEM, "size", "n_item", "class_min", "x.gram", "x.shingle", (F.col("place") < F.col("depth")).alias("in_sketch"))


def candidates(rows: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, key, item_id, item_key: documents that hit an item's sketch.  rows: doc_id, key, text."""
    sketch = items.where("in_sketch").select(*_ITEM, "class_min", "gram")
    passes = max(1, -(-sketch.count() // SKETCH_ROWS))
    grams = _shingled(rows, sizes, _hash, "doc_id", "key")
    # The outer explode keeps the optimizer from inferring a filter that would split every text anew for each shingle.
    every = grams.select("doc_id", "key", "n_words", F.explode_outer("grams").alias("gram"))
    found = []
    for b in range(passes):
        block = F.broadcast(sketch.where(F.pmod(F.xxhash64("item_id", "item_key", "gram"), F.lit(passes)) == b))
        found.append(every.join(block, "gram").where(F.col("n_words") >= F.col("class_min")).select("doc_id", "key", *_ITEM).distinct())
    return reduce(DataFrame.union, found).distinct() if passes > 1 else found[0]


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _contained(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, key, item_id, n_shared, n_item of the verified pairs; key is _key() of the document's row."""
    items = settle(items_of(benchmark))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect()) or [SHINGLE]  # 1 to 5
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _key().alias("key")).where("text is not null")
    pairs = settle(candidates(rows, items, sizes))
    met = rows.join(pairs.select(F.col("key").alias("_met")).distinct(), F.col("key") == F.col("_met"), "left_semi")
    shingles = _shingled(met, sizes, _text, "doc_id", "key").select("doc_id", "key", F.explode_outer("grams").alias("shingle"))
    hits = shingles.join(items.select(*_ITEM, "n_item", "shingle"), "shingle").distinct()
    p = pairs.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("item_id").alias("_i"), F.col("item_key").alias("_t"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")) & F.col("item_id").eqNullSafe(F.col("_i")) & (F.col("item_key") == F.col("_t"))
    counted = hits.join(p, same, "left_semi").groupBy("doc_id", "key", *_ITEM, "n_item").agg(F.count(F.lit(1)).alias("n_shared"))
    return counted.where(F.col("n_shared") * 100 >= F.col("n_item") * PERCENT).select("doc_id", "key", "item_id", "n_shared", "n_item")


def contained(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shared, n_item: the items that a document contains.

    Null texts, and texts without words, contain nothing and are contained in
    nothing.  Items with fewer than five words are found as that run of words.
    Rows of either table that share an id but not the text are judged apart;
    equal rows, and equal results of such rows, give one result row.  Rows
    without doc_id or item_id are judged like the others, with a null id in the
    result.  Extra columns are ignored.  No rows give no rows.
    """
    return _contained(docs, benchmark).select("doc_id", "item_id", "n_shared", "n_item").distinct()


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no item, all columns as they were.

    Rows without text or words contain nothing and stay; so do rows that repeat,
    each for itself, unless they contain an item.  Without items all rows stay.
    Rows without doc_id are judged like the others.  Extra columns may have any
    names.
    """
    gone = settle(_contained(docs, benchmark).select("doc_id", "key").distinct().toDF("_gone_id", "_gone"))
    same = F.col("doc_id").cast("long").eqNullSafe(gone["_gone_id"]) & (_key() == gone["_gone"])
    return docs.join(gone, same, "left_anti")
