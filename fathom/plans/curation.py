"""Queries of search, curation, scorers and graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import curate as cu
from ..operators import filters as fl
from ..operators import graph as gr
from ..operators import search as se
from ..operators.blocks import top_each
from ..queries import query, table
from .distributions import LABELLED, docs, labelled

BM25 = """t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents), st AS (SELECT count(*) AS n, avg(len(ws)) AS av FROM t),
h AS (SELECT doc_id, len, w, count(*) AS tf FROM (SELECT doc_id, len(ws) AS len, unnest(ws) AS w FROM t) WHERE w IN ('the', 'license', 'idiot') GROUP BY ALL), f AS (SELECT w, count(*) AS df FROM h GROUP BY 1),
bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av))) AS score FROM h JOIN f USING (w) CROSS JOIN st GROUP BY 1)"""
QUERY = "The license, idiot"


@query("bm25_search", f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM bm")
def bm25_search(spark, sf_dir):
    return se.bm25(docs(spark, sf_dir), QUERY).withColumn("score", F.round("score", 6))


@query("text_search", f"WITH {BM25} SELECT doc_id, round(round(score, 9), 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm JOIN documents USING (doc_id) WHERE lang = 'en' QUALIFY rank <= 50")
def text_search(spark, sf_dir):
    """The search entry's text mode: an index of postings, a filter before ranking."""
    d = docs(spark, sf_dir)
    found = se.search(d, "text", "doc_id", query=QUERY, where=F.col("lang") == "en", limit=50, index=se.TextIndex(d, "doc_id", "text", 1), version=1)
    return found.withColumn("score", F.round("score", 6))


@query("scalar_search", "SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS rank FROM documents WHERE source IS NOT NULL AND lang IN ('de', 'fr') QUALIFY rank <= 40")
def scalar_search(spark, sf_dir):
    return se.search(docs(spark, sf_dir), "scalar", "doc_id", where=F.col("source").isNotNull() & F.col("lang").isin("de", "fr"), limit=40, order=["n_chars"])


SEED = "s AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
EACH = "{name} AS (SELECT q.vec_id AS query, v.vec_id, round({d}, 9) AS d FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id{more}), r AS (SELECT query, vec_id, d, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS rank FROM {name})"
L2 = "list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"


def _seed(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding


def _each(spark, sf_dir, k, where=None, metric="l2"):
    """Every vec_id divisible by 100 against all rows."""
    e = table(spark, sf_dir, "embeddings")
    return top_each(e if where is None else e.where(where), e.where("vec_id % 100 = 0"), k, "vec_id", "embedding", metric)


@query("vector_topk", f"WITH {EACH.format(name='d', d=L2, more='')} SELECT query, rank, vec_id, round(d, 6) AS distance FROM r WHERE rank <= 20")
def vector_topk(spark, sf_dir):
    return _each(spark, sf_dir, 20).withColumn("distance", F.round("distance", 6))


@query("filtered_vector_topk", f"WITH {EACH.format(name='d', d=L2, more=' AND v.label IN (1, 2, 3)')} SELECT query, rank, vec_id, round(d, 6) AS distance FROM r WHERE rank <= 10")
def filtered_vector_topk(spark, sf_dir):
    return _each(spark, sf_dir, 10, fl.matches({"label": [1, 2, 3]})).withColumn("distance", F.round("distance", 6))


@query("ann_recall", f"WITH q AS (SELECT count(*) AS n FROM embeddings WHERE vec_id % 100 = 0) SELECT n * least(10, (SELECT count(*) - 1 FROM embeddings)) AS n, true AS reached FROM q")
def ann_recall(spark, sf_dir):
    """Recall@10 of 32 inverted lists against exact search over vec_ids divisible by 100: as many lists are probed as 0.9 takes, and whether it was reached."""
    rows = table(spark, sf_dir, "embeddings")
    asks = rows.where("vec_id % 100 = 0")
    index = se.IvfIndex(rows, "vec_id", "embedding", 32)
    probes, _ = index.probes_for(asks, 10, 0.9)
    got = se.recall(top_each(rows, asks, 10, "vec_id", "embedding"), index.nearest(asks, 10, probes), ["query", "vec_id"])
    return got.select("n", (F.col("recall") >= 0.9).alias("reached"))


HASHED = """hw AS (SELECT doc_id, sha1(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS h FROM {table}),
hv AS (SELECT doc_id, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS bucket, sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS v FROM hw GROUP BY 1, 2)"""


@query("hybrid_rrf", f"""WITH {BM25}, a AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM (SELECT * FROM bm ORDER BY round(score, 9) DESC, doc_id LIMIT 64)),
{HASHED.format(table='documents')}, qw AS (SELECT ('0x' || substr(sha1(w), 1, 8))::BIGINT % 64 AS bucket, CASE WHEN ('0x' || substr(sha1(w), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS s FROM (VALUES ('the'), ('license'), ('idiot')) t(w)),
qv AS (SELECT bucket, sum(s) AS q FROM qw GROUP BY 1), hn AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM hv GROUP BY 1),
cs AS (SELECT d.doc_id, round(1 - coalesce(CASE WHEN n > 0 THEN (SELECT sum(v * q) FROM hv JOIN qv USING (bucket) WHERE hv.doc_id = d.doc_id) / n / (SELECT sqrt(sum(q * q)) FROM qv) END, 0), 9) AS dist FROM documents d LEFT JOIN hn USING (doc_id)),
b AS (SELECT doc_id, row_number() OVER (ORDER BY dist, doc_id) AS r FROM (SELECT * FROM cs ORDER BY dist, doc_id LIMIT 64))
SELECT doc_id, round(sum(1 / (60 + r)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1 ORDER BY round(sum(1 / (60 + r)), 9) DESC, doc_id LIMIT 20""")
def hybrid_rrf(spark, sf_dir):
    """Reciprocal ranks of BM25 and of the cosine of hashed-text vectors."""
    d = docs(spark, sf_dir)
    text = se.bm25(d, QUERY).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "doc_id").limit(64)
    vectors = se.nearest(se.hashed_vectors(d, "doc_id", "text", 64), se.hashed_query(spark, QUERY, 64), 64, "doc_id", "v", "cosine").withColumn("distance", F.round("distance", 9))
    vectors = vectors.orderBy("distance", "doc_id")
    fused = se.rrf([(text, F.desc("score")), (vectors, F.col("distance"))], "doc_id")
    return fused.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(20).withColumn("score", F.round("score", 6))


@query("diversify_topk", f"""WITH RECURSIVE {SEED}, c AS (SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY round(list_distance(embedding::DOUBLE[], q), 9), vec_id)::INT AS p FROM embeddings, s),
w AS (SELECT 1 AS p, [1]::INT[] AS kept UNION ALL SELECT w.p + 1, CASE WHEN len(kept) >= 10 OR EXISTS (SELECT 1 FROM c x, c y WHERE list_contains(kept, x.p) AND y.p = w.p + 1 AND list_cosine_similarity(x.v, y.v) >= 0.3) THEN kept ELSE list_append(kept, (w.p + 1)::INT) END FROM w WHERE w.p < (SELECT max(p) FROM c))
SELECT vec_id, (list_position(kept, c.p) - 1)::INT AS position FROM (SELECT kept FROM w ORDER BY p DESC LIMIT 1) k JOIN c ON list_contains(kept, c.p)""")
def diversify_topk(spark, sf_dir):
    return se.diverse_nearest(table(spark, sf_dir, "embeddings"), _seed(spark, sf_dir), 10, 0.3, "vec_id", "embedding")


PAIRS = "p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a JOIN embeddings b ON {same}a.vec_id < b.vec_id WHERE similarity >= 0.35)"


@query("near_dup_pairs", f"WITH {PAIRS.format(same='')} SELECT a, b, round(similarity, 6) AS similarity FROM p")
def near_dup_pairs(spark, sf_dir):
    """Of all rows, whatever their labels. As in SQL, a vector of zeros has no similarity but NaN, which reaches the threshold, and one without components none."""
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0)
    return cu.similar_pairs(e, 0.35, "vec_id", "embedding", blank=float("nan")).withColumn("similarity", F.round("similarity", 6))


@query("near_dup_groups", f"""WITH RECURSIVE {PAIRS.format(same='a.label = b.label AND ')}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
g AS (SELECT a AS vec_id, min(b) AS "group" FROM r GROUP BY 1) SELECT vec_id, "group", vec_id = max(vec_id) OVER (PARTITION BY "group") AS kept FROM g""")
def near_dup_groups(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return cu.representatives(e, cu.similar_links(e, 0.35, "vec_id", "embedding", "label"), "vec_id", [F.desc("vec_id")])


@query("stratified_sample", "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) <= 2")
def stratified_sample(spark, sf_dir):
    return cu.stratified(docs(spark, sf_dir), ["lang", "source"], 2, ["n_chars", "doc_id"]).select("doc_id", "lang", "source")


@query("farthest_first", """WITH RECURSIVE c AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), r AS (SELECT 0 AS p, [min(vec_id)] AS kept, 0.0::DOUBLE AS d FROM c UNION ALL
SELECT r.p + 1, list_append(r.kept, b.vec_id), b.d FROM r, LATERAL (SELECT x.vec_id, min(round(list_distance(x.v, y.v), 9)) AS d FROM c x JOIN c y ON list_contains(r.kept, y.vec_id) AND NOT list_contains(r.kept, x.vec_id) GROUP BY x.vec_id ORDER BY d DESC, x.vec_id LIMIT 1) b WHERE r.p < 5)
SELECT kept[p + 1] AS vec_id, p::INT AS position, d AS distance FROM r""")
def farthest_first(spark, sf_dir):
    return cu.farthest_first(table(spark, sf_dir, "embeddings"), 6, "vec_id", "embedding")


@query("mine_neighbors", f"WITH {EACH.format(name='d', d='1 - list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])', more='')} SELECT query, rank, vec_id, round(1 - d, 6) AS similarity FROM r WHERE rank <= 25")
def mine_neighbors(spark, sf_dir):
    return _each(spark, sf_dir, 25, metric="cosine").select("query", "rank", "vec_id", F.round(1 - F.col("distance"), 6).alias("similarity"))


@query("quality_filter", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality >= 1 AND toxic = 0")
def quality_filter(spark, sf_dir):
    flags = F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>"))
    return fl.quality_filter(labelled(spark, sf_dir).withColumn("flags", flags), "quality", 1, "flags", exclude=("toxic", "quarantined")).select("doc_id")


@query("filter_map", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr') AND toxic IS NULL")
def filter_map(spark, sf_dir):
    return labelled(spark, sf_dir).where(fl.matches({"lang": ["en", "fr"], "toxic": None})).select("doc_id")


@query("review_queue", "WITH g AS (SELECT doc_id, source, n_chars AS score FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3) SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM g ORDER BY score DESC, doc_id LIMIT 25")
def review_queue(spark, sf_dir):
    return cu.review_queue(docs(spark, sf_dir).withColumn("score", F.col("n_chars")), 25, "doc_id", "score", "source", 3)


@query("gap_candidates", "WITH n AS (SELECT lang, least(greatest(0, 200 - count(*)), 7) AS need FROM documents GROUP BY 1) SELECT doc_id, lang FROM documents JOIN n USING (lang) WHERE need > 0 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) <= any_value(need) OVER (PARTITION BY lang)")
def gap_candidates(spark, sf_dir):
    d = docs(spark, sf_dir)
    gaps = d.groupBy("lang").agg(F.greatest(F.lit(0), 200 - F.count("*")).alias("needed"))
    return cu.from_gaps(d, gaps, "lang", ["n_chars", "doc_id"], 7).select("doc_id", "lang")


@query("row_plan", """WITH s AS (SELECT doc_id, quality FROM labels WHERE quality = 1), m AS (SELECT (doc_id % 50)::BIGINT AS scn, doc_id FROM documents)
SELECT scn, doc_id FROM m WHERE scn NOT IN (3, 4) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def row_plan(spark, sf_dir):
    members = docs(spark, sf_dir).select((F.col("doc_id") % 50).alias("scn"), "doc_id")
    rows = table(spark, sf_dir, "labels").where("toxic = 1").select(F.lit("row").alias("grain"), F.col("doc_id").alias("id"), F.lit("exclude").alias("decision"))
    scns = spark.createDataFrame([("scenario", 3, "exclude"), ("scenario", 4, "reject"), ("scenario", 5, "include")], "grain string, id long, decision string")
    return cu.row_plan(members, members, rows.union(scns), "scn", "doc_id")


@query("override_membership", "SELECT doc_id FROM documents WHERE (n_chars > 2000 OR doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def override_membership(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return fl.override(docs(spark, sf_dir).where("n_chars > 2000"), lab.where("quality = 1").join(docs(spark, sf_dir), "doc_id", "left_semi"), lab.where("toxic = 1"), "doc_id")


@query("tracker_sync", "WITH l AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS c FROM orders WHERE o_orderkey % 4 <> 0) SELECT coalesce(l.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN l.o_orderkey IS NULL THEN 'created' WHEN b.o_orderkey IS NULL THEN 'lake_only' WHEN o_orderstatus = c THEN 'unchanged' ELSE 'updated' END AS state FROM l FULL JOIN b USING (o_orderkey)")
def tracker_sync(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    bundle = o.where("o_orderkey % 4 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return fl.sync_states(o.where("o_orderkey % 3 <> 0"), bundle, "o_orderkey", "o_orderstatus")


@query("graph_reconcile", "SELECT c_custkey, 'stale' AS state FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, 'missing' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def graph_reconcile(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return fl.reconcile(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0"), c.where("c_custkey % 7 = 0"), "c_custkey")


@query("label_attribution", "SELECT d.doc_id, coalesce(l.quality, e.label, n.src) AS target FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN (SELECT doc_id, 100 + length(source) AS src FROM documents) n USING (doc_id)")
def label_attribution(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.col("doc_id").alias("vec_id"), "source")
    fallback = d.select("source", (100 + F.length("source")).alias("src")).distinct()
    found = fl.resolve_by_precedence(d, [("doc_id", table(spark, sf_dir, "labels"), "quality"), ("vec_id", table(spark, sf_dir, "embeddings"), "label"), ("source", fallback, "src")], "target")
    return found.select("doc_id", "target")


@query("dangling_ids", "SELECT doc_id FROM labels ANTI JOIN documents USING (doc_id) UNION ALL SELECT -1")
def dangling_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").select("doc_id").union(spark.createDataFrame([(-1,)], "doc_id long"))
    return fl.missing_ids(ids, docs(spark, sf_dir), "doc_id")


@query("regressions", "WITH m AS (SELECT event_type, user_id % 2 AS run, avg(value) AS s FROM events GROUP BY 1, 2) SELECT event_type, round(max(s) FILTER (run = 0), 6) AS base, round(max(s) FILTER (run = 1), 6) AS now FROM m GROUP BY 1 HAVING now < base - 0.05")
def regressions(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 2).cast("string").alias("run")).agg(F.avg("value").alias("s"))
    return cu.regressions(m, ["event_type"], "run", "s", "0", "1", 0.05).withColumns({"base": F.round("base", 6), "now": F.round("now", 6)})


SCORES = "e AS (SELECT event_id, user_id, event_type, value / 100 AS s, CASE event_id % 4 WHEN 0 THEN 'confidence' WHEN 1 THEN 'probability' WHEN 2 THEN 'loss' ELSE 'raw' END AS kind FROM events), c AS (SELECT *, CASE kind WHEN 'confidence' THEN 1 - greatest(0, least(1, s)) WHEN 'probability' THEN 1 - abs(2 * s - 1) ELSE s END AS cal FROM e)"


def _scores(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("confidence", "probability", "loss", "raw"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.col("value") / 100).alias("s"), kind.alias("kind"), "props")


@query("scorer_uncertainty", f"WITH {SCORES}, u AS (SELECT *, greatest(cal, CASE WHEN event_type = 'error' THEN 0.5 END, CASE WHEN event_id % 10 = 0 THEN 1.0 END) AS p FROM c) SELECT user_id, event_id, round(p, 6) AS priority FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY p DESC, event_id) = 1")
def scorer_uncertainty(spark, sf_dir):
    e = _scores(spark, sf_dir).withColumn("meta", F.when(F.col("event_type") == "error", F.create_map(F.lit("entropy"), F.lit(0.5))).otherwise(F.create_map().cast("map<string,double>")))
    score = cu.uncertainty(F.col("s"), F.col("kind"), F.col("meta"), F.col("event_id") % 10 != 0)
    return cu.best_output(e, "user_id", score, "event_id").withColumn("priority", F.round("priority", 6))


@query("scorer_ensemble", f"WITH {SCORES}, m AS (SELECT user_id, list(s) AS xs FROM e WHERE event_type = 'view' GROUP BY 1 HAVING count(*) >= 2) SELECT user_id, round(list_max(xs) - list_min(xs), 6) AS spread, round(list_var_pop(xs), 6) AS variance FROM m")
def scorer_ensemble(spark, sf_dir):
    m = _scores(spark, sf_dir).where("event_type = 'view'").groupBy("user_id").agg(F.collect_list("s").alias("xs"))
    out = m.select("user_id", F.round(cu.ensemble_disagreement(F.col("xs")), 6).alias("spread"), F.round(cu.ensemble_disagreement(F.col("xs"), True), 6).alias("variance"))
    return out.where("spread is not null")


@query("scorer_composite", f"WITH {SCORES}, x AS (SELECT event_id, 0.5 * cal AS a, CASE event_type WHEN 'error' THEN 0.9 WHEN 'view' THEN 0.1 END AS b, -0.01 * length(event_type) AS k FROM c) SELECT event_id, round(a + coalesce(b, 0) + k, 6) AS total, round(greatest(a, b, k), 6) AS top FROM x")
def scorer_composite(spark, sf_dir):
    e = _scores(spark, sf_dir)
    parts = [(cu.calibrated(F.col("s"), F.col("kind")), 0.5), (cu.failure_severity(F.col("event_type"), F.lit(None).cast("double"), {"error": 0.9, "view": 0.1}), 1.0), (cu.label_cost(F.length("event_type"), 0.01), 1.0)]
    return e.select("event_id", F.round(cu.composite(parts), 6).alias("total"), F.round(cu.composite(parts, "max"), 6).alias("top"))


@query("scorer_missing_labels", "SELECT doc_id, CASE WHEN quality IS NULL THEN 1.0 ELSE 0.5 END AS priority, CASE WHEN lang <> 'en' THEN 0.2 * least(1, n_chars / 5000) END AS boost FROM documents LEFT JOIN labels USING (doc_id)")
def scorer_missing_labels(spark, sf_dir):
    have = F.when(F.col("quality").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lit("quality")))
    d = labelled(spark, sf_dir)
    need = F.when(F.col("lang") != "en", F.col("n_chars")).otherwise(0)
    return d.select("doc_id", cu.missing_labels(have, ["quality", "difficulty"]).alias("priority"), cu.gap_boost(need, F.lit(5000), 0.2).alias("boost"))


EDGES = "e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"


def edges(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    cat = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = t("nation").select(cat("r", "n_regionkey").alias("src"), cat("n", "n_nationkey").alias("dst"))
    e = e.union(t("customer").select(cat("n", "c_nationkey"), cat("c", "c_custkey")))
    return e.union(t("orders").select(cat("c", "o_custkey"), cat("o", "o_orderkey"))).distinct()


def _nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


@query("lineage_impact", f"WITH RECURSIVE {EDGES}, r AS (SELECT 'r1' AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node) SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def lineage_impact(spark, sf_dir):
    return gr.reach(edges(spark, sf_dir), _nodes(spark, "r1"))


@query("lineage_trace", f"WITH RECURSIVE {EDGES}, r AS (SELECT 'o1' AS node, 0 AS depth UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node) SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def lineage_trace(spark, sf_dir):
    return gr.reach(edges(spark, sf_dir), _nodes(spark, "o1"), "up")


@query("lineage_paths", f"WITH {EDGES}, t AS (SELECT x.src AS c, x.dst AS o, y.src AS n, z.src AS r FROM e x JOIN e y ON y.dst = x.src JOIN e z ON z.dst = y.src WHERE x.dst IN ('o1', 'o2', 'o3', 'o4', 'o5') AND z.src IN ('r0', 'r1', 'r2')) SELECT DISTINCT r AS src, n AS dst FROM t UNION SELECT DISTINCT n, c FROM t UNION SELECT DISTINCT c, o FROM t")
def lineage_paths(spark, sf_dir):
    return gr.paths_to(edges(spark, sf_dir), _nodes(spark, "r0", "r1", "r2"), _nodes(spark, "o1", "o2", "o3", "o4", "o5"))


@query("rebuild_plan", f"WITH RECURSIVE {EDGES}, r AS (SELECT 'n3' AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node), m AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1) SELECT left(node, 1) AS kind, CASE left(node, 1) WHEN 'c' THEN 'retrain' WHEN 'o' THEN 'review' END AS action, depth, count(*) AS n FROM m WHERE depth > 0 GROUP BY ALL")
def rebuild_plan(spark, sf_dir):
    hit = gr.reach(edges(spark, sf_dir), _nodes(spark, "n3"))
    kinds = hit.select("node", F.substring("node", 1, 1).alias("kind"))
    return gr.rebuild_plan(hit, kinds, {"c": "retrain"}).groupBy("kind", "action", "depth").agg(F.count("*").alias("n"))
