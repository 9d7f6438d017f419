"""Queries of distributions, set operations and scalar functions over documents, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import distributions as ds
from ..queries import query, table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


LABELLED = "d AS (SELECT documents.*, labels.quality, labels.toxic, 'lang=' || coalesce(lang, 'unknown') || '|source=' || coalesce(source, 'unknown') AS label FROM documents LEFT JOIN labels USING (doc_id))"


def labelled(spark, sf_dir):
    return docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("label", fn.slice_label(["lang", "source"]))


@query("slice_distribution", f"""WITH {LABELLED}
SELECT label, count(*) AS n, count(quality) AS n_quality, min(quality) AS q_min, max(quality) AS q_max, round(avg(quality), 6) AS q_mean, count(*) FILTER (toxic = 1) AS n_flagged, count(quality) AS n_labelled, count(*) FILTER (n_chars < 200) AS n_duplicate,
round(count(*) / (SELECT count(*) FROM d), 6) AS share, round(count(quality) / count(*), 6) AS completeness, round(count(*) FILTER (n_chars < 200) / count(*), 6) AS pressure FROM d GROUP BY label""")
def slice_distribution(spark, sf_dir):
    out = ds.measure(labelled(spark, sf_dir), "label", "quality", F.col("toxic") == 1, "quality", F.col("n_chars") < 200)
    return out.withColumns({c: F.round(c, 6) for c in ("q_mean", "share", "completeness", "pressure")})


def _counts(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query("rare_bucket", f"WITH {LABELLED}, c AS (SELECT label, count(*) AS n FROM d GROUP BY 1) SELECT CASE WHEN n < 10 THEN 'rare' ELSE label END AS label, sum(n)::BIGINT AS n FROM c GROUP BY 1")
def rare_bucket(spark, sf_dir):
    return ds.rare_bucket(_counts(spark, sf_dir), 10)


@query("overflow_bucket", f"WITH {LABELLED}, c AS (SELECT label, count(*) AS n FROM d GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS r FROM c) SELECT CASE WHEN r < 12 THEN label ELSE 'other' END AS label, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def overflow_bucket(spark, sf_dir):
    return ds.overflow_bucket(_counts(spark, sf_dir), 12)


@query("explicit_bins", "SELECT CASE WHEN lang IN ('en') THEN 'english' WHEN lang IN ('fr', 'es') THEN 'romance' ELSE 'rest' END AS bin, count(*) AS n FROM documents GROUP BY 1")
def explicit_bins(spark, sf_dir):
    bins = {"en": "english", "fr": "romance", "es": "romance"}
    names = F.create_map(*[F.lit(x) for kv in bins.items() for x in kv])
    return docs(spark, sf_dir).groupBy(F.coalesce(names[F.col("lang")], F.lit("rest")).alias("bin")).agg(F.count("*").alias("n"))


TARGET = "t(label, min_count, target_pct) AS (VALUES ('en', 10, 0.9), ('de', 5, 0.05), ('it', 7, NULL), ('fr', NULL, 0.01))"


@query("gap_findings", f"""WITH o AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1), {TARGET}, s AS (SELECT sum(n) AS total FROM o),
j AS (SELECT label, coalesce(n, 0) AS n, coalesce(n, 0) / total AS pct, greatest(coalesce(min_count, 0), ceil(coalesce(target_pct, 0)::DOUBLE * total))::BIGINT AS required, target_pct::DOUBLE AS want, t.label IS NOT NULL AS has, total FROM o FULL JOIN t USING (label) CROSS JOIN s),
k AS (SELECT *, greatest(0, required - n)::BIGINT AS needed FROM j)
SELECT label, n::BIGINT AS n, round(pct, 6) AS pct, required, needed, CASE WHEN needed > 0 AND n = 0 THEN 'missing' WHEN needed > 0 THEN 'underrepresented' ELSE 'overrepresented' END AS kind,
round(CASE WHEN needed > 0 THEN greatest(needed, coalesce(want, 0) - pct) ELSE pct - coalesce(want, 0) END, 6) AS severity FROM k WHERE needed > 0 OR (label NOT IN (SELECT label FROM t)) OR pct > want + 0.05""")
def gap_findings(spark, sf_dir):
    target = spark.createDataFrame([("en", 10, 0.9), ("de", 5, 0.05), ("it", 7, None), ("fr", None, 0.01)], "label string, min_count int, target_pct double")
    return ds.gaps(docs(spark, sf_dir).groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("n")), target).withColumns({"pct": F.round("pct", 6), "severity": F.round("severity", 6)})


@query("feature_stats", "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS low, max(x) AS high FROM x GROUP BY 1")
def feature_stats(spark, sf_dir):
    return ds.feature_stats(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("latency_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return ds.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("snapshot_diff", "WITH l AS (SELECT doc_id, lang FROM documents WHERE n_chars > 500), r AS (SELECT doc_id, lang FROM documents WHERE n_chars < 3000), j AS (SELECT coalesce(l.lang, r.lang) AS lang, l.doc_id AS a, r.doc_id AS b FROM l FULL JOIN r USING (doc_id)) SELECT lang, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS shared, count(*) FILTER (b IS NULL) AS removed, count(*) FILTER (a IS NULL) AS added, round(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(*), 6) AS jaccard FROM j GROUP BY 1")
def snapshot_diff(spark, sf_dir):
    d = docs(spark, sf_dir)
    return ds.compare_members(d.where("n_chars > 500"), d.where("n_chars < 3000"), "doc_id", "lang").withColumn("jaccard", F.round("jaccard", 6))


@query("byte_accounting", "SELECT sum(n_chars)::BIGINT AS referenced, sum(n_chars) FILTER (lang = 'en')::BIGINT AS copied, (sum(n_chars) - sum(n_chars) FILTER (lang = 'en'))::BIGINT AS logical, round(sum(n_chars) FILTER (lang = 'en') / sum(n_chars), 6) AS copy_ratio FROM documents")
def byte_accounting(spark, sf_dir):
    return ds.accounting(docs(spark, sf_dir), "n_chars", F.col("lang") == "en").withColumn("copy_ratio", F.round("copy_ratio", 6))


@query("loader_rollup", "SELECT l_returnflag, l_linestatus, l_linenumber, sum(l_quantity) AS qty, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus, l_linenumber)")
def loader_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus", "l_linenumber").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


FOLD = "list_reduce(list_prepend(0::BIGINT, [('0x' || substr(sha1(doc_id::VARCHAR), i, 5))::BIGINT for i in [1, 6, 11, 16, 21, 26, 31, 36]]), lambda a, x: (a * 1048576 + x) % 10000) / 10000"


@query("hash_split", f"WITH h AS (SELECT doc_id, {FOLD} AS x FROM documents) SELECT doc_id, CASE WHEN x < 0.8 THEN 'train' WHEN x < 0.9 THEN 'val' ELSE 'test' END AS split FROM h")
def hash_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", fn.hash_split("doc_id", {"train": 0.8, "val": 0.1, "test": 0.1}).alias("split"))


@query("split_counts", f"WITH h AS (SELECT {FOLD} AS x FROM documents), c AS (SELECT CASE WHEN x < 0.8 THEN 'train' WHEN x < 0.9 THEN 'val' ELSE 'test' END AS split FROM h) SELECT s.split, count(c.split) AS n FROM (VALUES ('train'), ('val'), ('test'), ('holdout')) AS s(split) LEFT JOIN c USING (split) GROUP BY 1")
def split_counts(spark, sf_dir):
    names = spark.createDataFrame([("train",), ("val",), ("test",), ("holdout",)], "split string")
    counts = hash_split(spark, sf_dir).groupBy("split").agg(F.count("*").alias("c"))
    return names.join(counts, "split", "left").select("split", F.coalesce("c", F.lit(0)).alias("n"))


@query("metric_flatten", """SELECT event_id, kv.key AS metric, TRY_CAST(kv.value AS DOUBLE) AS score FROM (SELECT event_id, unnest(map_entries(from_json(props, '{"k":"VARCHAR"}')::STRUCT(k VARCHAR)::JSON::MAP(VARCHAR, VARCHAR))) AS kv FROM events)""")
def metric_flatten(spark, sf_dir):
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.explode(m).alias("metric", "v")).select("event_id", "metric", F.expr("try_cast(v as double)").alias("score"))


@query("content_digest", """SELECT event_id, 'evm-' || substr(sha1('{"event_type":"' || event_type || '","user_id":' || user_id || '}'), 1, 16) AS id FROM events""")
def content_digest(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fn.digest("user_id", "event_type", prefix="evm-").alias("id"))


@query("hashed_text_embedding", """WITH w AS (SELECT doc_id, sha1(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS h FROM documents),
b AS (SELECT doc_id, ('0x' || substr(h, 1, 8))::BIGINT % 32 AS bucket, CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS s FROM w),
v AS (SELECT doc_id, bucket, sum(s) AS v FROM b GROUP BY 1, 2)
SELECT doc_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS x FROM v WHERE v <> 0""")
def hashed_text_embedding(spark, sf_dir):
    from ..operators.search import hashed_embedding

    return hashed_embedding(docs(spark, sf_dir), "doc_id", "text", 32).withColumn("x", F.round("x", 6))


@query("vector_pad_mask", "SELECT vec_id, list_sum(embedding[1:(1 + vec_id % 8)]::DOUBLE[]) AS total, 10 AS width, (1 + vec_id % 8)::INT AS n_real FROM embeddings")
def vector_pad_mask(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", F.lit(1), (1 + F.col("vec_id") % 8).cast("int")).alias("v"))
    v, m = fn.pad_vector(F.col("v"), 10)
    return e.select("vec_id", F.aggregate(v, F.lit(0.0), lambda s, x: s + x).alias("total"), F.size(v).alias("width"), F.size(F.filter(m, lambda x: x)).alias("n_real"))


@query("stream_name_match", "SELECT event_id, replace(lower(event_type), '_', '-') AS stream, CASE WHEN event_type LIKE '%view%' THEN 'match' ELSE 'other' END AS hit FROM events")
def stream_name_match(spark, sf_dir):
    raw = F.concat(F.lit(" /"), F.upper("event_type"), F.lit("/ "))
    return table(spark, sf_dir, "events").select("event_id", fn.stream_name(raw).alias("stream"), F.when(fn.stream_name(raw) == fn.stream_name(F.lit("View")), "match").otherwise("other").alias("hit"))


@query("tag_extraction", "SELECT doc_id, lang, coalesce(source, 'unknown') AS source, 'unknown' AS site FROM documents")
def tag_extraction(spark, sf_dir):
    tags = F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source="), "source"))
    return docs(spark, sf_dir).select("doc_id", *[fn.tag_value(tags, k).alias(k) for k in ("lang", "source", "site")])


@query("urn_round_trip", "SELECT c_custkey, 'urn:fathom:' || 'customer' || ':' || replace(c_name, '#', '%23') AS urn, c_name AS ident FROM customer")
def urn_round_trip(spark, sf_dir):
    u = fn.urn(F.lit("customer"), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", u.alias("urn"), fn.parse_urn(u)[1].alias("ident"))


@query("redaction", "SELECT conv_id, turn, role, sha256(coalesce(text, '')) AS text_hash FROM conversations")
def redaction(spark, sf_dir):
    from ..operators.filters import redact

    return redact(table(spark, sf_dir, "conversations"), allow=["conv_id", "turn", "role"], hashed={"text": "text_hash"})
