"""Queries of episodes, alignment views, the lineage store, selections, training datasets and typed messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payloads as pl
from ..functions import scalars as fn
from ..operators import alignment as al
from ..operators import episodes as ep
from ..operators import lineage as ln
from ..operators import selections as sel
from ..operators import timeline as tl
from ..operators import training as tr
from ..queries import query, table
from ..shared import staging_path
from ..sources import formats as fm
from .data_plane import PERM
from .timeline import DAY, HOUR, OBS, observations

MERGED = """p AS (SELECT *, max(b) OVER (PARTITION BY run_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM h),
g AS (SELECT *, sum((pm IS NULL OR a > pm + {gap})::INT) OVER (PARTITION BY run_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM p),
i AS (SELECT run_id, min(a) AS start, max(b) AS "end", count(*) AS n FROM g GROUP BY run_id, g)"""
HITS = f"""WITH {OBS}, s AS (SELECT run_id, min(t) AS lo, max(t) AS hi FROM o GROUP BY 1),
h AS (SELECT run_id, greatest(t - {HOUR}, lo) AS a, least(t + {2 * HOUR}, hi) AS b FROM o JOIN s USING (run_id) WHERE topic = 'purchase'), {MERGED.format(gap=0)}"""


def _from_hits(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return ep.from_hits(obs.where("topic = 'purchase'").select("run_id", "t"), obs, HOUR, 2 * HOUR)


@query("episodes_from_hits", HITS + """ SELECT run_id, start, "end", n, 'query' AS source, row_number() OVER (PARTITION BY run_id ORDER BY start, "end") - 1 AS ordinal FROM i""")
def episodes_from_hits(spark, sf_dir):
    return ep.numbered(_from_hits(spark, sf_dir)).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("episodes_from_scenarios", f"""WITH {OBS}, s AS (SELECT run_id, min(t) AS s, max(t) AS z FROM o GROUP BY 1),
w AS (SELECT run_id, s, z, least(floor((t - s)::DOUBLE / {6 * HOUR}), greatest(ceil((z - s)::DOUBLE / {6 * HOUR}) - 1, 0))::BIGINT AS idx FROM o JOIN s USING (run_id)),
h AS (SELECT DISTINCT run_id, s + idx * {6 * HOUR} AS a, least(s + (idx + 1) * {6 * HOUR}, z) AS b FROM w), {MERGED.format(gap=6 * HOUR)} SELECT run_id, start, "end", n, 'scenarios' AS source FROM i""")
def episodes_from_scenarios(spark, sf_dir):
    return ep.from_scenarios(tl.tumbling_windows(observations(spark, sf_dir), 6 * HOUR), 6 * HOUR)


@query("episodes_dry_run", HITS + """, e AS (SELECT run_id, start, "end" FROM i), k AS (SELECT run_id, start, "end" FROM e WHERE run_id % 3 <> 0 UNION ALL SELECT run_id, start + 1, "end" FROM e WHERE run_id % 7 = 0)
SELECT CASE WHEN k.run_id IS NULL THEN 'insert' WHEN e.run_id IS NULL THEN 'clear' ELSE 'keep' END AS action, count(*) AS n FROM e FULL JOIN k ON e.run_id = k.run_id AND e.start = k.start AND e."end" = k."end" GROUP BY 1""")
def episodes_dry_run(spark, sf_dir):
    new = _from_hits(spark, sf_dir)
    known = new.where("run_id % 3 <> 0").unionByName(new.where("run_id % 7 = 0").withColumn("start", F.col("start") + 1))
    return ep.planned(ep.identified(new), ep.identified(known)).groupBy("action").agg(F.count("*").alias("n"))


@query("episode_registry", f"""WITH {OBS} SELECT run_id, CASE topic WHEN 'error' THEN 'cleared' WHEN 'click' THEN 'superseded' ELSE 'active' END AS state, CASE WHEN topic = 'click' THEN event_id END AS superseded_by
FROM o WHERE t <= 1705276800000000000 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY t DESC) = 1""")
def episode_registry(spark, sf_dir):
    kind = F.when(F.col("topic") == "error", "clear").when(F.col("topic") == "click", "supersede").otherwise("create")
    log = observations(spark, sf_dir).select("run_id", F.col("t").alias("at"), kind.alias("kind"), F.col("event_id").alias("superseded_by"))
    return ep.alive(log, "run_id", asof=1705276800000000000)


STREAMS = {"view": al.Stream("nearest", 3 * HOUR, HOUR), "click": al.Stream("previous", 2 * DAY)}
VIEW = f"""WITH {OBS}, k AS (SELECT run_id, unnest(range(min(t), max(t) + 1, {12 * HOUR})) AS t FROM o GROUP BY run_id),
v AS (SELECT run_id, t - {HOUR} AS st, event_id AS id, value AS v FROM o WHERE topic = 'view'), c AS (SELECT run_id, t AS st, event_id AS id, value AS v FROM o WHERE topic = 'click'),
p AS (SELECT k.run_id, k.t, v.st AS pt, v.id AS pid, v.v AS pv FROM k ASOF LEFT JOIN v ON k.run_id = v.run_id AND k.t >= v.st),
n AS (SELECT k.run_id, k.t, v.st AS nt, v.id AS nid, v.v AS nv FROM k ASOF LEFT JOIN v ON k.run_id = v.run_id AND k.t <= v.st),
b AS (SELECT *, pt IS NOT NULL AND (nt IS NULL OR t - pt <= nt - t) AS back FROM p JOIN n USING (run_id, t)),
x AS (SELECT run_id, 'view' AS topic, t, CASE WHEN back THEN pid ELSE nid END AS id, CASE WHEN back THEN pv ELSE nv END AS value, CASE WHEN back THEN t - pt ELSE nt - t END AS error, {3 * HOUR} AS tol FROM b
UNION ALL SELECT k.run_id, 'click', k.t, c.id, c.v, k.t - c.st, {2 * DAY} FROM k ASOF LEFT JOIN c ON k.run_id = c.run_id AND k.t >= c.st),
a AS (SELECT run_id, topic, t, id, value, error, CASE WHEN id IS NULL THEN 'missing' WHEN error > tol THEN 'out_of_tolerance' ELSE 'aligned' END AS status, CASE WHEN id IS NULL THEN 0 WHEN error = 0 THEN 1 ELSE greatest(0, 1 - error / tol) END AS confidence FROM x)"""


def _view(spark, sf_dir):
    return al.create_view(observations(spark, sf_dir), STREAMS, 1e9 / (12 * HOUR))


@query("alignment_view", VIEW + " SELECT run_id, topic, t, id, round(value, 6) AS value, error, status, round(confidence, 6) AS confidence FROM a")
def alignment_view(spark, sf_dir):
    return _view(spark, sf_dir).withColumns({"value": F.round("value", 6), "confidence": F.round("confidence", 6)})


@query("alignment_summary", VIEW + """, t1 AS (SELECT run_id, t, min(confidence) AS c FROM a GROUP BY 1, 2), t2 AS (SELECT run_id, count(*) AS ticks, round(avg(c), 6) AS mean_confidence, round(min(c), 6) AS min_confidence FROM t1 GROUP BY 1),
e AS (SELECT run_id, max(error) AS max_error, round(avg(error), 0) AS mean_error FROM a GROUP BY 1), f AS (SELECT run_id, string_agg(DISTINCT 'alignment:' || topic || ':' || status, ',' ORDER BY 'alignment:' || topic || ':' || status) AS flags FROM a WHERE status <> 'aligned' GROUP BY 1)
SELECT run_id, ticks, mean_confidence, min_confidence, max_error, mean_error, coalesce(flags, '') AS flags FROM t2 JOIN e USING (run_id) LEFT JOIN f USING (run_id)""")
def alignment_summary(spark, sf_dir):
    out = al.summary(_view(spark, sf_dir))
    return out.withColumns({"mean_confidence": F.round("mean_confidence", 6), "min_confidence": F.round("min_confidence", 6), "mean_error": F.round("mean_error", 0), "flags": F.array_join("flags", ",")})


@query("alignment_hydrated", VIEW + " SELECT a.run_id, a.topic, a.t, a.id, e.props FROM a LEFT JOIN events e ON e.event_id = a.id")
def alignment_hydrated(spark, sf_dir):
    return al.hydrate(_view(spark, sf_dir), table(spark, sf_dir, "events"), ["props"]).select("run_id", "topic", "t", "id", "props")


@query("alignment_backfill", VIEW + ", k2 AS (SELECT run_id, t, run_id % 5 <> 0 AS same FROM a GROUP BY ALL) SELECT run_id, t, same AND run_id % 4 <> 0 AS verified FROM k2")
def alignment_backfill(spark, sf_dir):
    """Ticks made again and held against known ones, of which some are changed and some are gone."""
    view = _view(spark, sf_dir)
    known = tl.wide_ticks(view, "run_id", "topic", sorted(STREAMS)).where("run_id % 4 <> 0").select("run_id", "t", F.when(F.col("run_id") % 5 != 0, F.col("vals")).otherwise(F.create_map(F.lit("view"), F.lit(-1.0))).alias("vals"))
    return al.backfill_ticks(view, STREAMS, known).select("run_id", "t", "verified")


@query("drift_flags", f"""WITH {OBS}, r AS (SELECT *, t + (event_id % 50) * {HOUR} AS late FROM o), g AS (SELECT *, t - lag(t) OVER (PARTITION BY run_id, topic ORDER BY t) AS gap FROM r),
m AS (SELECT run_id, topic, count(*) AS n, floor(median(gap))::BIGINT AS med, max(late - t) - min(late - t) AS drift FROM g GROUP BY 1, 2),
d AS (SELECT run_id, topic, m.drift, coalesce(sum(CASE WHEN gap > 1.5 * med THEN 1 ELSE 0 END), 0) > 0 AS lost FROM g JOIN m USING (run_id, topic) GROUP BY ALL)
SELECT run_id, topic, drift::BIGINT AS drift, concat_ws(',', CASE WHEN lost THEN 'dropped_frames' END, CASE WHEN drift > {20 * HOUR} THEN 'clock_drift' END) AS flags FROM d""")
def drift_flags(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("late", F.col("t") + (F.col("event_id") % 50) * HOUR)
    return al.drift_flags(obs, HOUR, "late", 20 * HOUR).select("run_id", "topic", "drift", F.array_join("flags", ",").alias("flags"))


def _artifacts(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return ln.artifacts({"nation": (t("nation"), "n_nationkey", "n_name"), "region": (t("region"), "r_regionkey", "r_name"), "customer": (t("customer"), "c_custkey", "c_name")})


ARTIFACTS = """a AS (SELECT 'nation:' || n_nationkey AS artifact_id, 'nation' AS kind, n_nationkey::VARCHAR AS ref, n_name AS name FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'region', r_regionkey::VARCHAR, r_name FROM region
UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_custkey::VARCHAR, c_name FROM customer)"""
EDGES = "e AS (SELECT 'located-in' AS type, 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation UNION SELECT 'lives-in', 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer)"


def _edges(spark, sf_dir):
    return ln.edges([(table(spark, sf_dir, "nation"), "located-in", "nation", "n_nationkey", "region", "n_regionkey"), (table(spark, sf_dir, "customer"), "lives-in", "customer", "c_custkey", "nation", "c_nationkey")])


@query("lineage_projection", f"WITH {ARTIFACTS}, {EDGES} SELECT kind, count(*) AS artifacts, (SELECT count(*) FROM e WHERE starts_with(src, kind || ':')) AS edges FROM a GROUP BY 1")
def lineage_projection(spark, sf_dir):
    n = _edges(spark, sf_dir).groupBy(F.substring_index("src", ":", 1).alias("kind")).agg(F.count("*").alias("edges"))
    return _artifacts(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("artifacts")).join(n, "kind", "left").fillna(0, ["edges"])


@query("lineage_refresh", f"WITH {EDGES}, k AS (SELECT type, src, dst FROM e WHERE dst <> 'nation:3' UNION ALL SELECT type, src || 'x', dst FROM e WHERE dst = 'nation:5'), h AS (SELECT 'customer:' || c_custkey || 'x' AS src FROM customer WHERE c_custkey % 2 = 0) SELECT CASE WHEN k.src IS NULL THEN 'insert' WHEN e.src IS NOT NULL THEN 'keep' WHEN k.src IN (SELECT src FROM h) THEN 'held' ELSE 'delete' END AS action, count(*) AS n FROM e FULL JOIN k USING (type, src, dst) GROUP BY 1")
def lineage_refresh(spark, sf_dir):
    fresh = _edges(spark, sf_dir)
    old = fresh.where("dst = 'nation:5'").select("type", F.concat("src", F.lit("x")).alias("src"), "dst").withColumn("edge_id", fn.digest("type", "src", "dst", prefix="edge-"))
    known = fresh.where("dst <> 'nation:3'").unionByName(old)
    held = old.where(F.regexp_extract("src", r":(\d+)x", 1).cast("long") % 2 == 0)
    return ln.refresh(known, fresh, held).groupBy("action").agg(F.count("*").alias("n"))


HANDLES = ["nation:3", "GERMANY", "4", "customer:1", "nothing", "AFRICA", "24"]


@query("lineage_resolve", f"""WITH {ARTIFACTS}, h(handle) AS (VALUES {', '.join(f"('{h}')" for h in HANDLES)}), k AS (SELECT artifact_id AS k, 0 AS rank, 'id' AS how, artifact_id FROM a UNION ALL SELECT ref, 1, 'ref', artifact_id FROM a UNION ALL SELECT name, 2, 'name', artifact_id FROM a),
b AS (SELECT handle, rank, how, min(artifact_id) AS f, count(DISTINCT artifact_id) AS n FROM h LEFT JOIN k ON k = handle GROUP BY ALL), c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY handle ORDER BY rank) = 1)
SELECT handle, CASE WHEN n = 1 THEN f END AS artifact_id, CASE WHEN n = 0 THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE how END AS how, n AS candidates FROM c""")
def lineage_resolve(spark, sf_dir):
    return ln.resolve(spark.createDataFrame([(h,) for h in HANDLES], "handle string"), _artifacts(spark, sf_dir))


@query("trace_checkpoint", "SELECT 'ckpt-1' AS checkpoint_id, 'snap-1' AS snapshot_id, d.doc_id AS row_id, CASE WHEN d.doc_id % 11 <> 0 THEN 'log://' || coalesce(lang, 'none') END AS source_uri, CASE WHEN d.doc_id % 11 <> 0 THEN n_chars END AS at FROM labels l JOIN documents d USING (doc_id) WHERE toxic = 1")
def trace_checkpoint(spark, sf_dir):
    """From a checkpoint to the rows that it was trained on and their places; rows of every eleventh id are gone."""
    d = table(spark, sf_dir, "documents")
    members = table(spark, sf_dir, "labels").where("toxic = 1").join(d.select("doc_id"), "doc_id").select(F.lit("snap-1").alias("snapshot_id"), F.col("doc_id").alias("row_id"))
    rows = d.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("row_id"), F.coalesce("lang", F.lit("none")).alias("run_id"), F.col("n_chars").alias("at"))
    sources = rows.select("run_id").distinct().withColumn("source_uri", F.concat(F.lit("log://"), "run_id"))
    return ln.trace_checkpoint(spark.createDataFrame([("ckpt-1", "snap-1")], "checkpoint_id string, snapshot_id string"), members, rows, sources)


@query("evidence_pack", f"WITH RECURSIVE {ARTIFACTS}, {EDGES}, r AS (SELECT 'region:2' AS node, 0 AS depth UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node) SELECT node, min(depth)::INT AS depth, any_value(kind) AS kind, any_value(name) AS name FROM r LEFT JOIN a ON a.artifact_id = node GROUP BY 1")
def evidence_pack(spark, sf_dir):
    return ln.evidence_pack(_edges(spark, sf_dir), spark.createDataFrame([("region:2",)], "node string"), _artifacts(spark, sf_dir)).drop("pack_id")


@query("run_downstream", "SELECT user_id AS run_id, event_id AS scenario_id, kind, event_id::VARCHAR || kind[1] AS ref FROM events, (VALUES ('output'), ('label')) k(kind) WHERE (kind = 'output' AND event_type = 'click') OR (kind = 'label' AND event_id % 3 = 0)")
def run_downstream(spark, sf_dir):
    e = observations(spark, sf_dir)
    part = lambda rows, c: rows.select(F.col("event_id").alias("scenario_id"), F.concat(F.col("event_id").cast("string"), F.lit(c[0])).alias(f"{c}_id"))
    return ln.downstream(part(e.where("topic = 'click'"), "output"), part(e.where("event_id % 3 = 0"), "label"), e.select(F.col("event_id").alias("scenario_id"), "run_id"))


@query("openlineage_events", f"""WITH {EDGES} SELECT type, src, dst, 'COMPLETE' AS kind, 'fathom' AS space FROM e""")
def openlineage_events(spark, sf_dir):
    """Events written as JSON lines and read again."""
    path = staging_path(spark, "events")
    fm.lineage_events(_edges(spark, sf_dir)).select(F.col("event").alias("value")).write.text(path)
    schema = "eventType string, job struct<name:string>, inputs array<struct<namespace:string,name:string>>, outputs array<struct<name:string>>"
    return spark.read.schema(schema).json(path).select(F.col("job.name").alias("type"), F.col("inputs")[0]["name"].alias("src"), F.col("outputs")[0]["name"].alias("dst"), F.col("eventType").alias("kind"), F.col("inputs")[0]["namespace"].alias("space"))


@query("replay_plan", f"WITH {OBS} SELECT 'log://' || run_id % 10 AS source_uri, min(t) - {HOUR} AS start, max(t) + {HOUR} AS \"end\", count(*) AS scenarios FROM o WHERE topic = 'error' GROUP BY 1")
def replay_plan(spark, sf_dir):
    obs = observations(spark, sf_dir)
    runs = obs.select("run_id").distinct().withColumn("source_uri", F.concat(F.lit("log://"), (F.col("run_id") % 10).cast("string")))
    return fm.replay_plan(obs.where("topic = 'error'").select(F.col("event_id").alias("scenario_id"), "run_id", F.col("t").alias("start"), F.col("t").alias("end")), runs, HOUR)


def _tagged(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "n_chars", F.array(F.concat(F.lit("lang:"), F.coalesce("lang", F.lit("none"))), F.lit("all")).alias("tags"))


@query("scoped_selection", "WITH l AS (SELECT doc_id, arg_max(quality, toxic * 10 + quality) AS q FROM labels GROUP BY 1) SELECT d.doc_id FROM documents d WHERE lang = 'fr' AND n_chars > 300 AND doc_id NOT IN (SELECT doc_id FROM l WHERE q = 0)")
def scoped_selection(spark, sf_dir):
    """A selection by a coverage tag and a filter, without the ids whose last decision excludes them."""
    lab = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") * 10 + F.col("quality")).alias("at"), F.when(F.col("quality") == 0, "exclude").otherwise("include").alias("decision"))
    return sel.Selection(_tagged(spark, sf_dir), "doc_id").scope(tag="lang:fr").where(F.col("n_chars") > 300, "long").decided(lab).ids()


@query("saved_view_page", "SELECT row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS ordinal, doc_id FROM documents WHERE lang = 'en' QUALIFY ordinal BETWEEN 40 AND 139")
def saved_view_page(spark, sf_dir):
    view = sel.save_view(sel.Selection(_tagged(spark, sf_dir), "doc_id").scope(tag="lang:en"), ["n_chars", "doc_id"], 1, 64)
    return sel.id_page(view, 40, 100, "doc_id")


@query("dedup_job", """WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4 WHERE a.label IN (1, 2, 3, 4)),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings WHERE label IN (1, 2, 3, 4) UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b) SELECT a AS vec_id, min(b) AS "group", a = min(b) AS kept FROM r GROUP BY 1""")
def dedup_job(spark, sf_dir):
    """Four shards, two of them in a first run that breaks off, the rest in a second one."""
    rows, root = table(spark, sf_dir, "embeddings").where("label in (1, 2, 3, 4)"), staging_path(spark, "dedup")
    sel.DedupJob(rows, root, 0.4, "vec_id", "embedding", "label").run(2)
    job = sel.DedupJob(rows, root, 0.4, "vec_id", "embedding", "label")
    job.run()
    return job.memberships()


@query("snapshot_comparison", """WITH a AS (SELECT doc_id, lang FROM documents WHERE n_chars > 200 AND lang IS NOT NULL), b AS (SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0 AND lang IS NOT NULL),
c AS (SELECT coalesce(b.lang, a.lang) AS slice, a.doc_id IS NOT NULL AS x, b.doc_id IS NOT NULL AS y FROM a FULL JOIN b USING (doc_id)), s AS (SELECT slice, count(*) FILTER (x AND y) AS shared, count(*) FILTER (NOT y) AS removed, count(*) FILTER (NOT x) AS added, count(*) AS n FROM c GROUP BY 1)
SELECT slice, unnest(['shared', 'removed', 'added', 'jaccard']) AS metric, round(unnest([shared::DOUBLE, removed::DOUBLE, added::DOUBLE, shared / n]), 6) AS value FROM s UNION ALL SELECT lang, 'mean_chars', round(avg(n_chars), 6) FROM documents WHERE doc_id % 3 <> 0 AND lang IS NOT NULL GROUP BY 1""")
def snapshot_comparison(spark, sf_dir):
    sel.register_metric("mean_chars", lambda old, new: new.groupBy(F.col("lang").alias("slice")).agg(F.avg("n_chars").alias("value")))
    d = table(spark, sf_dir, "documents").where("lang is not null")
    return sel.compare(d.where("n_chars > 200"), d.where("doc_id % 3 <> 0"), "doc_id", "lang", ["mean_chars"]).withColumn("value", F.round("value", 6))


PICKS = """d AS (SELECT doc_id, n_chars AS s, doc_id % 17 AS c FROM documents), x AS (SELECT doc_id, s, row_number() OVER (ORDER BY s DESC, doc_id) <= 50 AS a, row_number() OVER (ORDER BY sha1('s1|' || doc_id), doc_id) <= 50 AS b, row_number() OVER (ORDER BY c, doc_id) <= 50 AS l FROM d)"""


@query("selection_evaluation", f"""WITH {PICKS}, y AS (SELECT 'scored' AS strategy, s, a FROM x WHERE a UNION ALL SELECT 'random', s, a FROM x WHERE b UNION ALL SELECT 'low_confidence', s, a FROM x WHERE l)
SELECT strategy, count(*) AS n, round(avg(s), 6) AS mean_priority, count(*) FILTER (a) AS overlap, round(count(*) FILTER (a) / (2 * count(*) - count(*) FILTER (a)), 6) AS jaccard FROM y GROUP BY 1""")
def selection_evaluation(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("s"), (F.col("doc_id") % 17).alias("c"))
    return sel.evaluate_selection(d, 50, "doc_id", "s", "c", "s1").withColumns({"mean_priority": F.round("mean_priority", 6), "jaccard": F.round("jaccard", 6)})


@query("constrained_sample", "SELECT unnest(['max:1', 'min:2', 'min:3']) AS \"constraint\", unnest([2, 4, 3]) AS wanted, unnest((SELECT [count(*) FILTER (label = 1), count(*) FILTER (label = 2), count(*) FILTER (label = 3)] FROM embeddings)) AS feasible_count, 'satisfied' AS status")
def constrained_sample(spark, sf_dir):
    """A sample under constraints; the report of each."""
    _, report = sel.constrained_sample(table(spark, sf_dir, "embeddings"), 20, "vec_id", "embedding", "label", {2: 4, 3: 3}, {1: 2})
    return spark.createDataFrame([(r["constraint"], r["wanted"], r["feasible_count"], r["status"]) for r in report], "constraint string, wanted int, feasible_count long, status string")


@query("training_dataset", f"WITH {PERM.replace('FROM documents)', 'FROM documents WHERE lang IS NOT NULL AND n_chars > 100)')}, e AS (SELECT doc_id, (p0 - 2 + n) % n AS position FROM p) SELECT doc_id, lang, position, (position - 5) // 3 AS step FROM e JOIN documents USING (doc_id) WHERE position >= 5 AND (position - 5) % 3 = 2")
def training_dataset(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return tr.dataset(d.where("lang is not null").select("doc_id"), d, "doc_id", ["lang"], ["doc_id"], F.col("n_chars") > 100, "plan", 7, 2, 2, 3, 5)


@query("training_preview", "SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS position FROM documents QUALIFY position < 25")
def training_preview(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return tr.preview(tr.dataset(d.select("doc_id"), d, "doc_id", ["n_chars"], ["n_chars"]), 25).drop("step")


def _messages(spark, sf_dir):
    """Events as decoded messages of several types: every fifth of each, one without a known schema name."""
    v = F.col("value").cast("string")
    vec = lambda a: F.concat(F.lit('{"x":'), v, F.lit(f',"y":{a}}}'))
    kinds = [
        F.concat(F.lit('{"linear":'), vec(1), F.lit(',"angular":'), vec(2), F.lit("}")), F.concat(F.lit('{"latitude":'), v, F.lit(',"longitude":2.5}')),
        F.concat(F.lit('{"pos":'), vec(3), F.lit(',"orientation":{"z":"bad"}}')), F.concat(F.lit('{"q":{},"rotation_rate":'), vec(4), F.lit(',"linear_accel":{}}')),
    ]
    k = F.col("event_id") % 5
    payload = F.when(k == 0, kinds[0]).when(k == 1, kinds[1]).when(k == 2, kinds[2]).when(k == 3, kinds[3]).otherwise(F.lit("not json"))
    name = F.when(k == 0, "geometry_msgs/msg/Twist").when(k == 1, "sensor_msgs/NavSatFix").when(k == 4, "sensor_msgs/Imu").otherwise("mine")
    return table(spark, sf_dir, "events").select("event_id", payload.alias("payload_json"), name.alias("schema"))


@query("typed_fields", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'twist' WHEN 1 THEN 'gps' WHEN 2 THEN 'pose' ELSE 'imu' END AS modality, round(CASE event_id % 5 WHEN 1 THEN value + 2.5 WHEN 3 THEN value + 5 END, 6) AS state_sum, round(CASE WHEN event_id % 5 = 0 THEN 2 * value + 3 END, 6) AS action_sum, CASE event_id % 5 WHEN 1 THEN 3 WHEN 3 THEN 10 END AS state_size FROM events""")
def typed_fields(spark, sf_dir):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    out = pl.typed_fields(_messages(spark, sf_dir))
    return out.select("event_id", "modality", total("state_vector").alias("state_sum"), total("action_vector").alias("action_sum"), F.when(F.col("state_vector").isNotNull(), F.size("state_vector")).alias("state_size"))


@query("sample_values", "SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN value + 1 WHEN 2 THEN (props->>'k')::DOUBLE END, 6) AS x FROM events")
def sample_values(spark, sf_dir):
    k = F.col("event_id") % 4
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    payload = F.when(k == 1, F.concat(F.lit('{"value":['), (F.col("value") + 1).cast("string"), F.lit("]}"))).when(k == 2, F.col("k")).otherwise('{"other":1}')
    return e.select("event_id", F.round(pl.sample_value(F.when(k == 0, F.array("value")), F.lit(None).cast("array<double>"), payload)[0], 6).alias("x"))


@query("timestamps_normalised", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(ts) * 1000 WHEN 1 THEN (epoch_us(ts) // 1000000) * 1000000000 END AS ns FROM events")
def timestamps_normalised(spark, sf_dir):
    us, k = F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id") % 3
    text = F.when(k == 0, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(k == 1, F.floor(us / 1000000).cast("string")).otherwise("soon")
    return table(spark, sf_dir, "events").select("event_id", fn.timestamp_ns(text, "s").alias("ns"))


@query("topic_modality", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'pointcloud' WHEN 2 THEN 'gps' WHEN 3 THEN 'imu' ELSE 'unknown' END AS modality FROM documents")
def topic_modality(spark, sf_dir):
    names = F.array(*map(F.lit, ["/Camera/front", "/top_lidar", "/gnss/fix", "/imu0", "/joint_states", "/viewpoint"]))
    return table(spark, sf_dir, "documents").select("doc_id", fn.modality(F.get(names, (F.col("doc_id") % 6).cast("int"))).alias("modality"))


@query("demo_embedding", "SELECT doc_id, 12 AS n, 1.0::DOUBLE AS length, round(('0x' || substr(sha256(('doc ' || doc_id)::BLOB || '\\x00\\x00\\x00\\x00'::BLOB), 1, 8))::BIGINT / 2147483647.5 - 1, 6) > 0 AS up FROM documents")
def demo_embedding(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select("doc_id", fn.demo_embedding(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), 12).alias("v"))
    return v.select("doc_id", F.size("v").alias("n"), F.round(fn.norm(F.col("v")), 6).alias("length"), (F.col("v")[0] > 0).alias("up"))


@query("merged_tags", "SELECT doc_id, concat_ws(',', lang, CASE WHEN source IS DISTINCT FROM lang THEN source END, CASE WHEN 'x' IS DISTINCT FROM lang AND 'x' IS DISTINCT FROM source THEN 'x' END) AS tags FROM documents")
def merged_tags(spark, sf_dir):
    one = lambda c: F.array_compact(F.array(c))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(fn.ordered_distinct(one("lang"), one("source"), one("lang"), F.array(F.lit("x"))), ",").alias("tags"))


@query("clip_export", f"WITH {OBS}, i AS (SELECT event_id AS clip, run_id, t - {6 * HOUR} AS a, t + {6 * HOUR} AS b FROM o WHERE topic = 'error' AND event_id % 10 = 0) SELECT clip, o.topic, count(*) AS n, sum(o.event_id)::BIGINT AS ids FROM i JOIN o ON o.run_id = i.run_id AND o.t BETWEEN a AND b GROUP BY ALL")
def clip_export(spark, sf_dir):
    """A log around each of some errors, written as MCAP and read again."""
    obs = observations(spark, sf_dir)
    spans = obs.where("topic = 'error' and event_id % 10 = 0").select(F.col("event_id").alias("clip"), "run_id", (F.col("t") - 6 * HOUR).alias("start"), (F.col("t") + 6 * HOUR).alias("end"))
    messages = obs.select("run_id", "t", "topic", F.lit("json").alias("encoding"), F.lit("Event").alias("schema"), F.col("event_id").alias("sequence"), F.to_json(F.struct("event_id")).cast("binary").alias("data"))
    made = fm.clips(messages, spans, DAY)

    def read(batches):
        import json

        import pyarrow as pa

        for batch in batches:
            for clip, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(clip, m[0], json.loads(m[6])["event_id"]) for m in fm.mcap_messages(raw.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["clip", "topic", "event_id"])

    return made.select("clip", "mcap").mapInArrow(read, "clip long, topic string, event_id long").groupBy("clip", "topic").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("embedding_job", """WITH w AS (SELECT doc_id, sha1(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS h FROM documents),
v AS (SELECT doc_id, ('0x' || substr(h, 1, 8))::BIGINT % 16 AS bucket, sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS v FROM w GROUP BY 1, 2), s AS (SELECT doc_id, sum(v) / sqrt(sum(v * v)) AS total FROM v GROUP BY 1 HAVING sum(v * v) > 0)
SELECT doc_id, round(coalesce(total, 0), 6) AS total FROM documents LEFT JOIN s USING (doc_id)""")
def embedding_job(spark, sf_dir):
    """Text vectors by parts, in a first run that breaks off after three and a second one that ends the job."""
    from ..operators.jobs import ColumnJob
    from ..operators.search import hashed_vectors

    rows, root = table(spark, sf_dir, "documents").select("doc_id", "text"), staging_path(spark, "embeddings")
    work = lambda df: hashed_vectors(df, "doc_id", "text", 16)
    ColumnJob(rows, root, "doc_id", work, 4).run(3)
    job = ColumnJob(rows, root, "doc_id", work, 4)
    job.run()
    return job.result().select("doc_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("scorer_entropy", "SELECT user_id, round(max(value) FILTER (event_type = 'view'), 6) AS entropy, round(max(value) FILTER (event_type = 'click'), 6) AS loss FROM events GROUP BY 1")
def scorer_entropy(spark, sf_dir):
    from ..operators import curate as cu

    name = F.when(F.col("event_type") == "view", "entropy").when(F.col("event_type") == "click", "loss").otherwise("other")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.create_map(name, "value")).alias("m"))
    return rows.select("user_id", F.round(cu.metadata_score(F.col("m"), "entropy"), 6).alias("entropy"), F.round(cu.metadata_score(F.col("m"), "loss"), 6).alias("loss"))


@query("stream_asof", f"WITH {OBS}, k AS (SELECT run_id, t, event_id FROM o WHERE topic = 'error'), s AS (SELECT run_id, t AS st, value AS v FROM o WHERE topic = 'view') SELECT k.run_id, k.t, round(s.v, 6) AS value, k.t - s.st AS error FROM k ASOF LEFT JOIN s ON k.run_id = s.run_id AND k.t >= s.st")
def stream_asof(spark, sf_dir):
    """Errors as ticks, views as samples of one file stream, run to its end."""
    import uuid

    from ..streaming import streams as st

    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).where(F.col("event_type").isin("error", "view"))
    rows = rows.select(F.col("user_id").alias("run_id"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("t"), (F.col("event_type") == "error").alias("tick"), "value")
    out = st.run_to_end(st.asof_previous(rows, "run_id", "t", "tick", "value"), f"asof_{uuid.uuid4().hex}", staging_path(spark, "stream"))
    return out.withColumn("value", F.round("value", 6))
