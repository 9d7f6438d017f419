"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly. DataFrame functions only.

Words are the runs of characters other than ASCII white space, lower-cased; a set is the distinct
shingles of five words (of fewer words: the whole sequence, as one). An item is found in a document if at
least `threshold` of its shingles are in the document.

1. Items are partitioned by size into classes of a ratio of two. An item's sketch is its `sketch` least hashes
   (bottom-k MinHash), and a class's bound is the greatest value in its sketches: large items have low bounds, small ones
   need all of their few shingles.
2. A MinHash of a long document says nothing about a short item: the document's own shingles fill it. So the
   document side keeps every shingle hash under a class's bound as its sketch for that class (the containment form of MinHash),
   in proportion to its length: a hash under no bound is never looked up, the others only in the classes whose bound admits them.
3. The number of an item's sketch values that a document holds estimates its containment. An item whose
   sketch is the whole of it needs `threshold` of them, exactly; of a larger one so many that an item at the threshold has fewer with odds
   under `miss`. Only pairs that reach it are candidates.
4. Candidates are verified on whole documents and whole items: exact shared shingles over item size.

The table of sketch values is staged, so Spark knows its size and broadcasts it only under its threshold; a
larger one is shuffled. A passage found in a third of all documents costs a row for
each of them.

Defined results: null or empty texts and items have no shingles and match nothing; an item of under five
words matches only a document of the same words; rows that repeat doc_id or item_id, or have none, are documents and items of their
own, told apart by a hash of the text; all of a row's repeats give one row. Extra columns are ignored by `decontaminate` and kept by `drop_contaminated`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, stage, unused

SPACE = r"[ \t\n\x0B\f\r]+"


def shingle_rows(df: DataFrame, keys: list[str], text: str, k: int = 5) -> DataFrame:
    """(*keys, h): a row for each shingle, repeats included, h its hash; of fewer than k words, one row for the whole sequence; of none, none.

    Shifted copies of the word array are zipped and unrolled, so the hash is compiled code over plain columns."""
    words = F.split(F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" \t\n\x0b\f\r")), SPACE)
    rows = df.select(*keys, words.alias("ws")).where("ws[0] <> ''")
    n = F.size("ws")
    names = [f"w{i}" for i in range(k)]
    shifted = [F.slice("ws", i + 1, F.greatest(n - (k - 1), F.lit(0))).alias(names[i]) for i in range(k)]
    short = F.array(F.struct(F.array_join("ws", " ").alias("w0"), *[F.lit(None).cast("string").alias(c) for c in names[1:]]))
    return rows.select(*keys, F.inline(F.when(n >= k, F.arrays_zip(*shifted)).otherwise(short))).select(*keys, F.xxhash64(*names).alias("h"))


def named(df: DataFrame, key: str, text: str, id_name: str, hash_name: str) -> DataFrame:
    """(id, hash of the text, t) of each row under the names given."""
    return df.select(col(key).alias(id_name), F.xxhash64(col(text)).alias(hash_name), col(text).alias("t"))


def least_hits(n: int, threshold: float, miss: float) -> int:
    """The most values that an item at the threshold, of a sketch of n, falls short of with odds under `miss`."""
    below, m = 0.0, 0
    while m < n:
        below += math.comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if below >= miss:
            break
        m += 1
    return max(1, m)


def found_items(docs: DataFrame, items: DataFrame, threshold: float, sketch: int, miss: float, doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, d, item_id, i, n_item, n_shared), d and i hashes of the texts."""
    shingles = stage(shingle_rows(named(items, item_id, item_text, "item_id", "i"), ["item_id", "i"], "t").distinct(), "items")
    sizes = shingles.groupBy("item_id", "i").agg(F.count("*").alias("n_item"), F.sort_array(F.collect_list("h")).alias("hs"))
    sizes = sizes.withColumn("cls", F.ceil(F.log2("n_item")).cast("int"))
    prints = sizes.select("item_id", "i", "n_item", "cls", F.explode(F.slice("hs", 1, sketch)).alias("v"))
    prints = stage(prints, "item_sketches")
    bounds = sorted(((r[1], r[0]) for r in prints.groupBy("cls").agg(F.max("v")).collect()), reverse=True)  # a row for each doubling of size
    # a hash under the n-th highest bound is looked up in the classes of the n highest
    admits = F.lit(0)
    for n, (bound, _) in enumerate(bounds):
        admits = F.when(F.col("h") <= bound, n + 1).otherwise(admits)
    place = F.create_map(*[F.lit(x) for n, (_, c) in enumerate(bounds) for x in (c, n)])[F.col("cls")] if bounds else F.lit(0)
    whole = docs.select(col(doc_id).alias("doc_id"), F.xxhash64(col(text)).alias("d"), col(text).alias("t"))
    rows = shingle_rows(whole, ["doc_id", "d"], "t").withColumn("admits", admits).where("admits > 0")
    hits = rows.join(prints.select("item_id", "i", "n_item", F.col("v").alias("h"), place.alias("place")), "h").where("place < admits")
    hits = hits.groupBy("doc_id", "d", "item_id", "i").agg(F.count_distinct("h").alias("hits"), F.min("n_item").alias("n_item"))
    needed = F.when(F.col("n_item") <= sketch, F.ceil(F.col("n_item") * threshold - 1e-9)).otherwise(least_hits(sketch, threshold, miss))
    pairs = stage(hits.where(F.col("hits") >= needed).select("doc_id", "d", "item_id", "i", "n_item"), "candidates")
    wanted = pairs.select(F.col("doc_id").alias("c"), F.col("d").alias("e")).distinct()
    theirs = shingle_rows(whole.join(wanted, F.col("doc_id").eqNullSafe(F.col("c")) & (F.col("d") == F.col("e")), "left_semi"), ["doc_id", "d"], "t")
    # only shingles that some item has are worth a shuffle
    both = theirs.join(shingles.select("h").distinct(), "h", "left_semi").distinct().join(shingles, "h")
    shared = both.groupBy("doc_id", "d", "item_id", "i").agg(F.count("*").alias("n_shared")).alias("s")
    same = F.col("s.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("s.d") == F.col("p.d")) & F.col("s.item_id").eqNullSafe(F.col("p.item_id")) & (F.col("s.i") == F.col("p.i"))
    out = shared.join(pairs.alias("p"), same).select("p.*", "s.n_shared")
    return out.where(F.col("n_shared") / F.col("n_item") >= threshold)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.75, sketch: int = 16, miss: float = 1e-6, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): every pair found, containment n_shared / n_item >= threshold."""
    found = found_items(docs, items, threshold, sketch, miss, doc_id, text, item_id, item_text)
    return found.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.75, sketch: int = 16, miss: float = 1e-6, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item, as they were."""
    a, b = unused("c", docs), unused("e", docs)
    hits = found_items(docs, items, threshold, sketch, miss, doc_id, text, item_id, item_text).select(F.col("doc_id").alias(a), F.col("d").alias(b)).distinct()
    return docs.join(hits, col(doc_id).eqNullSafe(F.col(a)) & (F.xxhash64(col(text)) == F.col(b)), "left_anti")
