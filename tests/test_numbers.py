"""Numbers over all rows on tables so large that Spark samples the bounds of ranges."""

import hashlib

from pyspark.sql import functions as F

from fathom.operators import timeline as tl
from fathom.operators import training as tr
from fathom.sources import formats as fm

N = 60000


def test_global_numbers(spark):
    df = spark.range(N).select(((F.col("id") * 7919) % N).alias("t"), F.col("id").alias("event_id"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    rows = tl.number_rows(df.withColumn("run_id", F.col("event_id") % 10), "run_id", ["t", "event_id"], "frame")
    got = tl.global_numbers(rows, ["t", "event_id"], "global_index")
    assert got.columns == ["t", "event_id", "pad", "run_id", "frame", "global_index"]
    assert sorted((r.global_index, r.t, r.event_id * 7919 % N, len(r["pad"])) for r in got.collect()) == [(i, i, i, 64) for i in range(N)]
    assert tl.global_numbers(df.limit(0), ["t"], "n").count() == 0


def test_global_numbers_names(spark):
    # the name replaces a column, helper columns can't clash
    odd = spark.createDataFrame([(2, 5), (1, 5), (None, 5)], "__at int, __p int")
    assert sorted(map(tuple, tl.global_numbers(odd, ["__at"], "__p").collect()), key=lambda r: r[1]) == [(None, 0), (1, 1), (2, 2)]


def by_hash(keys):
    return sorted(keys, key=lambda k: (hashlib.sha256(f"plan|7|{k}".encode()).hexdigest(), k))


def test_collated_batches(spark):
    d = spark.range(N).select(F.col("id").alias("doc_id"), F.array_repeat(F.lit(1.0), (F.col("id") % 5 + 1).cast("int")).alias("v"))
    got = tr.batches(tr.permutation(d, "doc_id", "plan", 7), 32, "doc_id", "v").select("batch", "n", "keys").orderBy("batch").collect()
    assert [r.batch for r in got] == list(range(N // 32)) and {r.n for r in got} == {32}
    assert [k for r in got for k in r["keys"]] == by_hash(range(N))


def test_tar_shards(spark):
    df = spark.range(N).select(((F.col("id") * 7919) % N).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("txt"))
    got = fm.tar_shards(df, "id", ["txt"], 100).orderBy("shard").collect()
    assert [r.shard for r in got] == list(range(N // 100)) and {r.n for r in got} == {100}
    first = [bytes(r.tar[:100]).split(b"\0")[0] for r in got]
    assert first == [b"%d.txt" % (100 * i) for i in range(N // 100)]


def test_training_dataset(spark):
    df = spark.range(N).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.col("id") % 4).alias("lang"))
    got = tr.dataset(df.select("doc_id"), df, "doc_id", ["lang"], ["doc_id"], None, "plan", 7, 2, 2, 3, 5).collect()
    order = by_hash(range(N))
    order = order[2:] + order[:2]
    assert sorted((r.position, r.doc_id, r.lang, r.step) for r in got) == [(p, order[p], f"l{order[p] % 4}", (p - 5) // 3) for p in range(7, N, 3)]
