"""Queries of run validation and governed records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as ql
from ..operators import records as rc
from ..queries import query, table
from .timeline import OBS, observations

NEED = {"view": 10, "click": 10, "signup": 8}
RULES = f"""WITH {OBS}, runs AS (SELECT DISTINCT run_id FROM o),
a AS (SELECT run_id, 'required-topics' AS rule, CASE WHEN count(*) FILTER (topic = 'view') >= 10 AND count(*) FILTER (topic = 'click') >= 10 AND count(*) FILTER (topic = 'signup') >= 8 THEN 'passed' ELSE 'failed' END AS status FROM o GROUP BY 1),
l AS (SELECT *, t <= lag(t) OVER (PARTITION BY run_id, topic ORDER BY event_id) AS bad FROM o), b AS (SELECT run_id, 'monotonic-timestamps', CASE WHEN count(*) FILTER (bad) = 0 THEN 'passed' ELSE 'failed' END FROM l GROUP BY 1),
s AS (SELECT run_id, topic, min(t) AS x, max(t) AS y FROM o WHERE topic IN ('view', 'click', 'signup') GROUP BY 1, 2), c AS (SELECT run_id, 'time-range-overlap', coalesce((SELECT CASE WHEN count(*) < 2 OR max(x) <= min(y) THEN 'passed' ELSE 'failed' END FROM s WHERE s.run_id = runs.run_id), 'passed') FROM runs),
d AS (SELECT run_id, 'decodable-streams', CASE WHEN count(*) FILTER (value < 1) = 0 THEN 'passed' ELSE 'failed' END FROM o GROUP BY 1), e AS (SELECT run_id, 'byte-integrity', 'skipped' FROM runs),
r AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d UNION ALL SELECT * FROM e)"""


def _rules(spark, sf_dir):
    return ql.validate(observations(spark, sf_dir), NEED, decoded=F.col("value") >= 1)


@query("quality_rules", RULES + " SELECT * FROM r")
def quality_rules(spark, sf_dir):
    return _rules(spark, sf_dir)


@query("quality_flags", RULES + ", g AS (SELECT run_id, string_agg('quality:failed:' || rule, ',' ORDER BY rule) FILTER (status = 'failed') AS bad FROM r GROUP BY 1) SELECT run_id, bad IS NULL AS passed, CASE WHEN bad IS NULL THEN 'quality:demo:passed' ELSE 'quality:demo:failed,' || bad || ',quarantined' END AS flags FROM g")
def quality_flags(spark, sf_dir):
    return ql.quality_flags(_rules(spark, sf_dir), "demo").withColumn("flags", F.array_join("flags", ","))


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_at"), "o_orderstatus", "o_totalprice")


MO = "o AS (SELECT o_orderkey AS id, o_custkey, epoch_us(o_orderdate) AS created_at, o_orderstatus, o_totalprice FROM orders)"
CUT = 852076800000000  # 1997-01-01


@query("manifest_page", f"WITH {MO} SELECT id, created_at FROM o WHERE o_orderstatus = 'F' AND (created_at < {CUT} OR (created_at = {CUT} AND id > 5)) ORDER BY created_at DESC, id LIMIT 100")
def manifest_page(spark, sf_dir):
    return rc.page(_orders(spark, sf_dir), 100, F.col("o_orderstatus") == "F", (CUT, 5)).select("id", "created_at")


@query("retention_verdicts", f"WITH {MO}, r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY created_at DESC, id) AS r FROM o) SELECT id, CASE WHEN o_totalprice > 300000 THEN 'protected' WHEN r <= 2 OR created_at >= {CUT} THEN 'kept' ELSE 'expired' END AS verdict FROM r")
def retention_verdicts(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return rc.retention(o, ["o_custkey"], 2, CUT, protected=o.where("o_totalprice > 300000")).select("id", "verdict")


@query("policy_conflicts", f"WITH {MO}, p(policy, k, v, action) AS (VALUES ('p1', 'status', 'F', 'hold'), ('p2', 'size', 'big', 'expire'), ('p3', 'status', 'O', 'expire')), s AS (SELECT id, 'status' AS k, o_orderstatus AS v FROM o UNION ALL SELECT id, 'size', CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END FROM o), h AS (SELECT id, policy, action FROM s JOIN p USING (k, v)) SELECT id, policy, action, count(DISTINCT action) OVER (PARTITION BY id) > 1 AS conflict FROM h")
def policy_conflicts(spark, sf_dir):
    o = _orders(spark, sf_dir)
    scopes = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("size"), F.when(F.col("o_totalprice") > 200000, "big").otherwise("small"))
    p = spark.createDataFrame([("p1", "status", "F", "hold"), ("p2", "size", "big", "expire"), ("p3", "status", "O", "expire")], "policy string, scope_key string, scope_value string, action string")
    return rc.holds(o.withColumn("scopes", scopes), p)


@query("state_transitions", f"WITH {OBS}, p AS (SELECT event_id, topic, coalesce(lag(topic) OVER (PARTITION BY run_id ORDER BY t, event_id), '') AS previous FROM o) SELECT event_id, previous, (previous = '' AND topic IN ('signup', 'view')) OR (previous = 'signup' AND topic IN ('view')) OR (previous = 'view' AND topic IN ('click', 'purchase')) AS allowed FROM p")
def state_transitions(spark, sf_dir):
    return rc.transitions(observations(spark, sf_dir), {"": ["signup", "view"], "signup": ["view"], "view": ["click", "purchase"]}, "run_id", ["t", "event_id"], "topic").select("event_id", "previous", "allowed")


NOW, STALE = 1706659200000000000, 12 * 3600 * 10**9


@query("stale_jobs", f"WITH {OBS}, m AS (SELECT run_id, max(t) AS t FROM o GROUP BY 1) SELECT run_id, t FROM m WHERE {NOW} - t > {STALE}")
def stale_jobs(spark, sf_dir):
    return rc.stale_jobs(observations(spark, sf_dir), "run_id", "t", NOW, STALE).select("run_id", "t")


@query("write_back", "WITH l AS (SELECT doc_id, quality, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY toxic DESC) = 1) SELECT doc_id, coalesce(quality, n_chars) AS n_chars, toxic FROM documents LEFT JOIN l USING (doc_id)")
def write_back(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf_dir, "labels").withColumn("at", F.col("toxic"))
    return rc.write_back(d, lab, "doc_id", ["at"], {"n_chars": "quality", "toxic": "toxic"})


@query("owner_conflicts", "SELECT doc_id FROM documents WHERE n_chars > 100 AND NOT (doc_id % 3 = 0 AND lang <> 'en')")
def owner_conflicts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    plan = d.where("n_chars > 100").select("doc_id", F.lit("en").alias("owner"))
    owned = d.where("doc_id % 3 = 0").select("doc_id", F.col("lang").alias("owner"))
    return rc.conflicts(plan, owned, "doc_id", "owner", "preserve").select("doc_id")


@query("enrich_missing", "SELECT doc_id, length(text)::BIGINT AS size FROM documents ANTI JOIN labels USING (doc_id)")
def enrich_missing(spark, sf_dir):
    def size(texts):
        return texts.str.len().astype("int64")

    import pandas as pd

    size.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    rc.register_provider("size", size)
    return rc.enrich(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text", "size", "size", "long")


@query("payload_fetch", "WITH t AS (SELECT page_id FROM pages ORDER BY length(url) DESC, page_id LIMIT 20) SELECT page_id, length(html)::BIGINT AS n FROM pages SEMI JOIN t USING (page_id)")
def payload_fetch(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    top = p.select("page_id", F.length("url").alias("n")).orderBy(F.desc("n"), "page_id").limit(20)
    return rc.fetch_payloads(top, p.select("page_id", F.length("html").cast("long").alias("n")), "page_id")
