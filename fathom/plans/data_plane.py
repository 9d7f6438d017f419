"""Queries of the lake, training and streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import training as tr
from ..queries import query, table
from ..sources import formats as fm
from ..shared import staging_path as scratch
from ..sources.lake import Lake
from .distributions import FOLD
from .timeline import OBS, observations


PERM = "p AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('plan|7|' || doc_id), doc_id) - 1 AS p0, count(*) OVER () AS n FROM documents)"


@query("epoch_order", f"WITH {PERM} SELECT doc_id, (p0 - 3 + n) % n AS position FROM p")
def epoch_order(spark, sf_dir):
    return tr.epoch_order(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "plan", 7, 3)


@query("worker_shard", f"WITH {PERM}, e AS (SELECT doc_id, (p0 - 3 + n) % n AS position FROM p) SELECT doc_id, position, (position - 10) // 4 AS step FROM e WHERE position >= 10 AND (position - 10) % 4 = 1")
def worker_shard(spark, sf_dir):
    return tr.worker_shard(epoch_order(spark, sf_dir), 1, 4, 10)


@query("collated_batches", f"WITH {PERM} SELECT p0 // 32 AS batch, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY p0) AS keys, max(1 + doc_id % 5)::INT AS width, sum(1 + doc_id % 5)::BIGINT AS cells FROM p GROUP BY 1")
def collated_batches(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_repeat(F.lit(1.0), (F.col("doc_id") % 5 + 1).cast("int")).alias("v"))
    b = tr.batches(tr.permutation(d, "doc_id", "plan", 7), 32, "doc_id", "v")
    cells = F.aggregate("mask", F.lit(0).cast("long"), lambda s, m: s + F.size(F.filter(m, lambda x: x)))
    return b.select("batch", "n", F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"), "width", cells.alias("cells"))


@query("training_report", "SELECT l_shipmode, l_linestatus, sum(qty) AS qty, sum(n) AS n FROM (SELECT l_returnflag AS l_shipmode, l_linestatus, l_quantity AS qty, 1::BIGINT AS n FROM lineitem) GROUP BY ROLLUP (l_shipmode, l_linestatus)")
def training_report(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("l_shipmode"), "l_linestatus", F.col("l_quantity").alias("qty"), F.lit(1).cast("long").alias("n"))
    return tr.report(rows, ["qty", "n"], ["l_shipmode", "l_linestatus"])


@query("lake_versions", "SELECT 1 AS version, count(*) AS n, sum(c_acctbal)::DECIMAL(18, 2)::DOUBLE AS total FROM customer UNION ALL SELECT 2, count(*) + count(*) FILTER (c_custkey % 10 = 0), (sum(CASE WHEN c_custkey % 10 = 0 THEN 2 * c_acctbal + 1 WHEN c_custkey % 10 = 1 THEN c_acctbal ELSE c_acctbal END))::DECIMAL(18, 2)::DOUBLE FROM customer")
def lake_versions(spark, sf_dir):
    """A table created and upserted; both versions read back."""
    lake = Lake(spark, scratch(spark, "lake"))
    c = table(spark, sf_dir, "customer")
    lake.create("customer", c)
    lake.upsert("customer", c.where("c_custkey % 10 = 0").withColumn("c_custkey", -1 - F.col("c_custkey")).withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(c.where("c_custkey % 10 = 1")), "c_custkey")
    one = lambda v: lake.table("customer", v).agg(F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("total")).select(F.lit(v).alias("version"), "n", "total")
    return one(1).union(one(2))


@query("dataset_snapshot", f"WITH h AS (SELECT doc_id, {FOLD} AS x FROM documents WHERE lang = 'en') SELECT doc_id, CASE WHEN x < 0.9 THEN 'train' ELSE 'val' END AS split FROM h")
def dataset_snapshot(spark, sf_dir):
    lake = Lake(spark, scratch(spark, "lake"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    lake.create("documents", d)
    return lake.snapshot("documents", d.where("lang = 'en'").union(d.where("lang = 'en'")), "doc_id", {"train": 0.9, "val": 0.1}).select("doc_id", "split")


@query("step_flags", f"WITH {OBS} SELECT run_id, event_id, row_number() OVER w = 1 AS is_first, lead(event_id) OVER w IS NULL AS is_last FROM o WINDOW w AS (PARTITION BY run_id ORDER BY event_id)")
def step_flags(spark, sf_dir):
    return fm.steps(observations(spark, sf_dir).select("run_id", "event_id"), "run_id", "event_id").select("run_id", "event_id", "is_first", "is_last")


@query("tar_shards", "SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS shard, doc_id FROM documents QUALIFY true", )
def tar_shards(spark, sf_dir):
    """Tar shards written and listed again."""
    shards = fm.tar_shards(table(spark, sf_dir, "documents"), "doc_id", ["text"], 100)

    def members(pdf_iter):
        import io
        import tarfile

        import pandas as pd

        for pdf in pdf_iter:
            for s, t in zip(pdf["shard"], pdf["tar"]):
                names = [int(m.name.split(".")[0]) for m in tarfile.open(fileobj=io.BytesIO(t)).getmembers()]
                yield pd.DataFrame({"shard": s, "doc_id": names})

    return shards.mapInPandas(members, "shard long, doc_id long")


@query("interval_check", f"WITH {OBS}, r AS (SELECT run_id, min(t) AS lo, max(t) AS hi FROM o GROUP BY 1) SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'reversed' WHEN t + 3600000000000 > hi THEN 'out-of-bounds' END AS problem FROM o JOIN r USING (run_id)")
def interval_check(spark, sf_dir):
    obs = observations(spark, sf_dir)
    runs = obs.groupBy("run_id").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    span = F.when(F.col("event_id") % 9 == 0, -1).otherwise(3600000000000)
    got = fm.check_intervals(obs.select("event_id", "run_id", F.col("t").alias("from_timestamp_ns"), (F.col("t") + span).alias("to_timestamp_ns"), F.col("event_id").cast("string").alias("external_id")), runs)
    return got.select("event_id", "problem")


@query("shard_gaps", f"WITH {OBS}, s AS (SELECT run_id, t // 86400000000000 AS ordinal, min(t) AS a, max(t) AS b FROM o GROUP BY 1, 2), l AS (SELECT *, lag(b) OVER (PARTITION BY run_id ORDER BY ordinal) AS e FROM s) SELECT run_id, ordinal, CASE WHEN a > e THEN 'gap' ELSE 'overlap' END AS kind, abs(a - e) AS nanos FROM l WHERE e IS NOT NULL")
def shard_gaps(spark, sf_dir):
    day = F.floor(F.col("t") / 86400000000000)
    shards = observations(spark, sf_dir).groupBy("run_id", day.alias("ordinal")).agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"))
    return fm.split_recording_gaps(shards)


@query("secret_scan", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(api[_-]?key|secret|password|token|authorization)\"?\\s*[:=]\\s*\"?[^\\s\",}]{4,}|AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----')")
def secret_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(fn.has_secret(F.col("text"))).select("doc_id")


@query("stream_windows", f"SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """A file stream of events through tumbling windows, run to its end."""
    from ..streaming import streams as st

    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"windows_{uuid.uuid4().hex}"
    out = st.run_to_end(st.tumbling_counts(rows, "ts", "event_type", "1 day", "0 seconds"), name, scratch(spark, "stream"), "complete")
    return out.select(F.unix_micros("start").alias("start"), "event_type", "n")
