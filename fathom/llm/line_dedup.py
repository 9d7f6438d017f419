"""Line dedup by winnowing over line hashes. DataFrame functions only.

Every non-blank line (trimmed) has a hash and a place, the number of words before it. The window of a
line holds the lines that start within its next `min_words` words: the shortest run from it that reaches
that many. The line of least hash in each full window is a fingerprint. A repeated run of `min_words`
words holds a whole window in both places, thus the same fingerprint: no such run can be missed.

1. Fingerprints are selected by two range windows within a document, and counted over the corpus.
2. Only windows whose fingerprint occurs elsewhere are joined, by their content, to its first place in
   (doc_id, line) order. These are the matches.
3. Matches are extended both ways: windows are taken forwards from each line and backwards to each line,
   so the union of a run's matched windows is the whole run, whatever the words left at its ends.
4. Lines of later places are deleted; the rest are put together again with line feeds.

Nothing is paired within a group of equal windows (each meets only the group's first place), so a line
that a third of the corpus repeats costs one row per place.

Defined results: null texts stay null and empty ones empty; blank lines stay unless the whole text goes;
a text all of whose lines are deleted becomes empty. Rows that repeat doc_id and text are one document and
get one result each. Runs repeated within one document count as well. Other columns are kept; columns named like
the outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, stage, unused


def line_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, rk, pos, h, at, words): the non-blank lines of each document; rk tells rows that share an id apart."""
    rows = docs.select(col(doc_id).alias("id"), F.xxhash64(col(text)).alias("rk"), F.split(col(text), "\n").alias("lines")).where(F.col("lines").isNotNull())
    # repeats of a row are looked for by their ids and hashes alone, so that lines are shuffled by document, once
    lines = rows.select("id", "rk", F.posexplode("lines").alias("pos", "raw")).select("id", "rk", "pos", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("line"))
    lines = lines.where(F.col("line") != "").select("id", "rk", "pos", F.xxhash64("line").alias("h"), F.size(F.split("line", r"[ \t\x0B\f\r]+")).alias("words"))
    if rows.groupBy("id", "rk").agg(F.count("*").alias("m")).where("m > 1").isEmpty():
        return lines
    return lines.groupBy("id", "rk", "pos").agg(F.min("h").alias("h"), F.min("words").alias("words"))


def repeated_lines(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, rk, gone): positions of the lines that belong to a later repeat of a run of at least min_words words."""
    spark = docs.sparkSession
    reach = min_words - 1
    inside = Window.partitionBy("id", "rk")
    order = inside.orderBy("pos")
    ahead, behind = inside.orderBy("at").rangeBetween(0, reach), inside.orderBy("at").rangeBetween(-reach, 0)
    lead, trail = inside.orderBy("end").rangeBetween(0, reach), inside.orderBy("end").rangeBetween(-reach, 0)
    lines = line_table(docs, doc_id, text)
    lines = lines.withColumn("end", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("at", F.col("end") - F.col("words"))
    lines = lines.withColumn("total", F.max("end").over(inside))
    fore, back = F.col("total") - F.col("at") >= min_words, F.col("end") >= min_words
    seq = lambda w: F.struct(F.xxhash64(F.collect_list("h").over(w)).alias("x"), F.hash(F.collect_list("h").over(w)).alias("y"))
    lines = lines.where(F.col("total") >= min_words).select(
        "id", "rk", "pos", "h", "at", "end",
        F.when(fore, F.min("h").over(ahead)).alias("low_f"), F.when(back, F.min("h").over(trail)).alias("low_b"),
        F.when(fore, seq(ahead)).alias("key_f"), F.when(back, seq(trail)).alias("key_b"),
    )
    lines = lines.withColumn("print", (F.max("low_f").over(behind) == F.col("h")) | (F.max("low_b").over(lead) == F.col("h")))
    lines = stage(lines, "lines")
    shared = lines.where("print").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("low"))
    wins = lines.where("low_f is not null").select("id", "rk", "pos", F.lit(True).alias("fore"), F.col("low_f").alias("low"), F.col("key_f").alias("key"))
    wins = wins.union(lines.where("low_b is not null").select("id", "rk", "pos", F.lit(False), "low_b", "key_b"))
    wins = wins.join(shared, "low", "left_semi").select("id", "rk", "pos", "fore", F.col("key.x").alias("x"), F.col("key.y").alias("y"))
    place = F.struct(F.col("id").isNull().alias("z"), "id", "rk", "pos")
    firsts = wins.groupBy("fore", "x", "y").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = wins.join(firsts, ["fore", "x", "y"]).where(place != F.col("first")).groupBy("id", "rk", "pos").agg(F.max(F.col("fore")).alias("hit_f"), F.max(~F.col("fore")).alias("hit_b"))
    kept = lines.select("id", "rk", "pos", "at", "end").alias("l")
    same = F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.rk") == F.col("r.rk"))
    hit_docs = later.select("id", "rk").distinct()
    some = kept.join(hit_docs.alias("r"), same, "left_semi").alias("l").join(later.alias("r"), same & (F.col("l.pos") == F.col("r.pos")), "left").select("l.*", F.coalesce("hit_f", F.lit(False)).alias("hit_f"), F.coalesce("hit_b", F.lit(False)).alias("hit_b"))
    some = some.withColumn("gone", F.max("hit_f").over(behind) | F.max("hit_b").over(lead))
    return some.where("gone").groupBy("id", "rk").agg(F.collect_list("pos").alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text", removed: str = "n_removed") -> DataFrame:
    """The documents without later repeats of runs of lines of at least min_words words; `removed` counts the lines that went."""
    names = [c for c in docs.columns if c != removed]
    i, k, gone = unused("i", docs), unused("k", docs), unused("gone", docs)
    cut = repeated_lines(docs, min_words, doc_id, text).select(F.col("id").alias(i), F.col("rk").alias(k), F.col("gone").alias(gone))
    both = docs.select(*map(col, names)).join(cut, col(doc_id).eqNullSafe(F.col(i)) & (F.xxhash64(col(text)) == F.col(k)), "left")
    # a column of its own, so that a text is split once and not for each of its lines; only texts that lose lines are
    lines = unused("lines", both)
    both = both.withColumn(lines, F.when(F.col(gone).isNotNull(), F.split(col(text), "\n")))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))  # by a hash set: linear, in order
    left = F.transform(kept, lambda at: F.get(F.col(lines), at))
    rest = F.when(F.forall(left, lambda x: F.trim(x) == ""), "").otherwise(F.array_join(left, "\n"))
    out = F.when(F.col(gone).isNull(), col(text)).otherwise(rest).alias(text)
    return both.select(*[out if c == text else col(c) for c in names], F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(removed))
