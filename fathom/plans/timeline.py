"""Queries of the timeline operators over the event log: a run is a user, a topic an event type."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeline as tl
from ..queries import query, table

HOUR = 3_600_000_000_000
DAY = 24 * HOUR


def observations(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run_id"), F.col("event_type").alias("topic"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("t"), "value")


OBS = "o AS (SELECT event_id, user_id AS run_id, event_type AS topic, epoch_us(ts) * 1000 AS t, value FROM events)"


def joined(c):
    return F.array_join(c, ",")


@query("scenario_windows", f"""
WITH {OBS}, s AS (SELECT run_id, min(t) AS s, max(t) AS z FROM o GROUP BY 1),
w AS (SELECT o.*, s, z, least(floor((t - s)::DOUBLE / {6 * HOUR}), greatest(ceil((z - s)::DOUBLE / {6 * HOUR}) - 1, 0))::BIGINT AS idx FROM o JOIN s USING (run_id))
SELECT run_id, idx, s + idx * {6 * HOUR} AS start, least(s + (idx + 1) * {6 * HOUR}, z) AS "end", count(*) AS n, string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics, string_agg(event_id::VARCHAR, ',' ORDER BY t, event_id) AS ids, s + (idx + 1) * {6 * HOUR} > z AS is_partial
FROM w GROUP BY run_id, idx, s, z""")
def scenario_windows(spark, sf_dir):
    return tl.tumbling_windows(observations(spark, sf_dir), 6 * HOUR).withColumns({"topics": joined("topics"), "ids": joined(F.col("ids").cast("array<string>"))})


@query("marker_episodes", f"""
WITH {OBS}, m AS (SELECT *, sum((topic = 'signup')::INT) OVER (PARTITION BY run_id ORDER BY t, event_id) AS g FROM o WHERE topic IN ('signup', 'purchase')),
a AS (SELECT run_id, g, min(t) FILTER (topic = 'signup') AS start, arg_min(event_id, t) FILTER (topic = 'signup') AS start_id, min(t) FILTER (topic = 'purchase') AS "end", arg_min(event_id, t) FILTER (topic = 'purchase') AS end_id FROM m WHERE g > 0 GROUP BY 1, 2)
SELECT run_id, start, "end", start_id, end_id FROM a WHERE "end" IS NOT NULL""")
def marker_episodes(spark, sf_dir):
    return tl.pair_markers(observations(spark, sf_dir), ["signup"], ["purchase"])


PREDICATE = f"""
WITH {OBS}, s AS (SELECT run_id, min(t) AS lo, max(t) AS hi FROM o GROUP BY 1),
h AS (SELECT run_id, greatest(t - {6 * HOUR}, lo) AS a, least(t + {6 * HOUR}, hi) AS b FROM o JOIN s USING (run_id) WHERE topic = 'error'),
p AS (SELECT *, max(b) OVER (PARTITION BY run_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM h),
g AS (SELECT *, sum((pm IS NULL OR a > pm + {HOUR})::INT) OVER (PARTITION BY run_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM p),
i AS (SELECT run_id, min(a) AS start, max(b) AS "end", count(*) AS n FROM g GROUP BY run_id, g)"""


@query("predicate_episodes", PREDICATE + f' SELECT * FROM i WHERE "end" - start >= {7 * HOUR}')
def predicate_episodes(spark, sf_dir):
    return tl.mine_predicate(observations(spark, sf_dir), F.col("topic") == "error", 6 * HOUR, 6 * HOUR, HOUR, 7 * HOUR)


@query("episode_frames", PREDICATE + ' SELECT o.run_id, start, "end", count(*) AS frames, sum(event_id)::BIGINT AS id_sum FROM i JOIN o ON o.run_id = i.run_id AND t BETWEEN start AND "end" GROUP BY ALL')
def episode_frames(spark, sf_dir):
    obs = observations(spark, sf_dir)
    found = tl.mine_predicate(obs, F.col("topic") == "error", 6 * HOUR, 6 * HOUR, HOUR)
    return tl.rows_in_intervals(obs, found, DAY).groupBy("run_id", "start", "end").agg(F.count("*").alias("frames"), F.sum("event_id").alias("id_sum"))


@query("monotonic_check", f"""
WITH {OBS}, l AS (SELECT *, value <= lag(value) OVER (PARTITION BY run_id, topic ORDER BY event_id) AS bad FROM o)
SELECT run_id, topic, min(event_id) FILTER (bad) AS first_bad_seq, min(event_id) FILTER (bad) IS NULL AS ok FROM l GROUP BY 1, 2""")
def monotonic_check(spark, sf_dir):
    return tl.first_disorder(observations(spark, sf_dir), ["run_id", "topic"], "value", "event_id")


@query("latest_decision", f"""WITH {OBS} SELECT run_id, topic, t, event_id, value FROM o QUALIFY row_number() OVER (PARTITION BY run_id, topic ORDER BY t DESC, event_id DESC) = 1""")
def latest_decision(spark, sf_dir):
    return tl.latest(observations(spark, sf_dir), ["run_id", "topic"], ["t", "event_id"])


CUT = 1705276800000000000  # 2024-01-15


@query("decision_asof", f"""WITH {OBS} SELECT run_id, topic, t, event_id, value FROM o WHERE t <= {CUT} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY t DESC, event_id DESC) = 1""")
def decision_asof(spark, sf_dir):
    return tl.latest(observations(spark, sf_dir).where(F.col("t") <= CUT), "run_id", ["t", "event_id"]).select("run_id", "topic", "t", "event_id", "value")


@query("decision_history", f"""WITH {OBS} SELECT run_id, topic, event_id, lag(event_id) OVER (PARTITION BY run_id, topic ORDER BY t, event_id) AS supersedes FROM o""")
def decision_history(spark, sf_dir):
    return tl.history(observations(spark, sf_dir), ["run_id", "topic"], ["t", "event_id"], "event_id").select("run_id", "topic", "event_id", "supersedes")


@query("retain_latest", f"""WITH {OBS} SELECT run_id, topic, event_id FROM o QUALIFY row_number() OVER (PARTITION BY run_id, topic ORDER BY t DESC, event_id DESC) <= 3""")
def retain_latest(spark, sf_dir):
    return tl.retain_latest(observations(spark, sf_dir), ["run_id", "topic"], ["t", "event_id"], 3).select("run_id", "topic", "event_id")


@query("frame_index", f"""WITH {OBS} SELECT event_id, row_number() OVER (PARTITION BY run_id ORDER BY t, event_id) - 1 AS frame, row_number() OVER (ORDER BY t, event_id) - 1 AS global_index FROM o""")
def frame_index(spark, sf_dir):
    rows = tl.number_rows(observations(spark, sf_dir), "run_id", ["t", "event_id"], "frame")
    return tl.global_numbers(rows, ["t", "event_id"], "global_index").select("event_id", "frame", "global_index")


@query("keyset_page", "SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS us FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1995-06-17', 100) ORDER BY o_orderdate, o_orderkey LIMIT 500")
def keyset_page(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    return tl.page_after(rows, ["us", "o_orderkey"], [803347200000000, 100], 500)


GRID = f"""
WITH {OBS}, k AS (SELECT run_id, unnest(range(min(t), max(t) + 1, {6 * HOUR})) AS t FROM o GROUP BY run_id),
s AS (SELECT run_id, t AS st, event_id AS id, value AS v FROM o WHERE topic = 'view'),
p AS (SELECT k.run_id, k.t, s.st AS pt, s.id AS pid, s.v AS pv FROM k ASOF LEFT JOIN s ON k.run_id = s.run_id AND k.t >= s.st),
n AS (SELECT k.run_id, k.t, s.st AS nt, s.id AS nid, s.v AS nv FROM k ASOF LEFT JOIN s ON k.run_id = s.run_id AND k.t <= s.st),
b AS (SELECT * FROM p JOIN n USING (run_id, t)),
c AS (SELECT *, pt IS NOT NULL AND (nt IS NULL OR t - pt <= nt - t) AS back FROM b)"""


def _aligned(spark, sf_dir, method, tolerance):
    obs = observations(spark, sf_dir)
    out = tl.align(tl.tick_grid(obs, 6 * HOUR), obs.where("topic = 'view'"), ["run_id"], method, tolerance, 6 * HOUR)
    return out.withColumns({"value": F.round("value", 6), "confidence": F.round("confidence", 6)})


@query("align_nearest", GRID + f""", d AS (SELECT run_id, t, CASE WHEN back THEN pid ELSE nid END AS id, CASE WHEN back THEN pv ELSE nv END AS value, CASE WHEN back THEN t - pt ELSE nt - t END AS error FROM c)
SELECT run_id, t, id, round(value, 6) AS value, error, CASE WHEN id IS NULL THEN 'missing' WHEN error > {3 * HOUR} THEN 'out_of_tolerance' ELSE 'aligned' END AS status, round(CASE WHEN id IS NULL THEN 0 WHEN error = 0 THEN 1 ELSE greatest(0, 1 - error / {3 * HOUR}) END, 6) AS confidence FROM d""")
def align_nearest(spark, sf_dir):
    return _aligned(spark, sf_dir, "nearest", 3 * HOUR)


@query("align_previous", GRID + f""" SELECT run_id, t, pid AS id, round(pv, 6) AS value, t - pt AS error, CASE WHEN pid IS NULL THEN 'missing' ELSE 'aligned' END AS status, round(CASE WHEN pid IS NULL THEN 0 ELSE 1 / (1 + (t - pt) / {6 * HOUR}) END, 6) AS confidence FROM c""")
def align_previous(spark, sf_dir):
    return _aligned(spark, sf_dir, "previous", None)


@query("align_linear", GRID + f""", d AS (SELECT run_id, t, CASE WHEN back THEN pid ELSE nid END AS id, CASE WHEN t = pt THEN pv WHEN pt IS NOT NULL AND nt IS NOT NULL THEN pv + (nv - pv) * ((t - pt) / (nt - pt)) END AS value, CASE WHEN back THEN t - pt ELSE nt - t END AS error FROM c)
SELECT run_id, t, id, round(value, 6) AS value, error, CASE WHEN value IS NULL THEN 'missing' WHEN error > 0 THEN 'interpolated' ELSE 'aligned' END AS status, round(CASE WHEN value IS NULL THEN 0 WHEN error = 0 THEN 1 ELSE 1 / (1 + error / {6 * HOUR}) END, 6) AS confidence FROM d""")
def align_linear(spark, sf_dir):
    return _aligned(spark, sf_dir, "linear", None)


@query("align_stream_stats", f"""
WITH {OBS}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY run_id, topic ORDER BY t) AS gap FROM o),
m AS (SELECT run_id, topic, count(*) AS n, floor(median(gap))::BIGINT AS median_interval FROM g GROUP BY 1, 2)
SELECT run_id, topic, n, median_interval, coalesce(sum(CASE WHEN gap > 1.5 * median_interval THEN greatest(1, round_even(gap::DOUBLE / median_interval, 0)::BIGINT - 1) ELSE 0 END), 0)::BIGINT AS dropped, 0::BIGINT AS drift
FROM g JOIN m USING (run_id, topic) GROUP BY ALL""")
def align_stream_stats(spark, sf_dir):
    return tl.stream_stats(observations(spark, sf_dir), ["run_id", "topic"])


TOPICS = ("view", "click")
LONG = f"""
WITH {OBS}, k AS (SELECT run_id, unnest(range(min(t), max(t) + 1, {DAY})) AS t FROM o GROUP BY run_id), kt AS (SELECT * FROM k CROSS JOIN (VALUES ('view'), ('click')) AS x(topic)),
a AS (SELECT kt.run_id, kt.t, kt.topic, o.value, kt.t - o.t AS error FROM kt ASOF LEFT JOIN o ON kt.run_id = o.run_id AND kt.topic = o.topic AND kt.t >= o.t),
f AS (SELECT *, CASE WHEN error IS NULL THEN 'missing' WHEN error > {2 * DAY} THEN 'out_of_tolerance' ELSE 'aligned' END AS status FROM a)"""


def _long(spark, sf_dir):
    obs = observations(spark, sf_dir)
    ticks = tl.tick_grid(obs, DAY).withColumn("topic", F.explode(F.array(*map(F.lit, TOPICS))))
    return tl.align(ticks, obs.where(F.col("topic").isin(*TOPICS)), ["run_id", "topic"], "previous", 2 * DAY)


@query("pivot_ticks", LONG + """
SELECT run_id, t, string_agg(topic, ',' ORDER BY topic) FILTER (status = 'aligned') AS available, string_agg(topic, ',' ORDER BY topic) FILTER (status = 'missing') AS missing, string_agg(topic, ',' ORDER BY topic) FILTER (status = 'out_of_tolerance') AS late, max(value) FILTER (topic = 'view') AS v_view FROM f GROUP BY 1, 2""")
def pivot_ticks(spark, sf_dir):
    wide = tl.wide_ticks(_long(spark, sf_dir), "run_id", "topic", TOPICS)
    text = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return wide.select("run_id", "t", text("available").alias("available"), text("missing").alias("missing"), text("late").alias("late"), F.col("vals")["view"].alias("v_view"))


@query("tick_policy", LONG + " SELECT run_id, t, 2::BIGINT AS n_streams FROM f GROUP BY 1, 2 HAVING bool_and(status = 'aligned')")
def tick_policy(spark, sf_dir):
    return tl.tick_policy(_long(spark, sf_dir), "run_id", "topic", TOPICS)


@query("temporal_window_samples", f"""
WITH {OBS}, f AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t, event_id) - 1 AS frame FROM o WHERE topic = 'view'),
b AS (SELECT run_id, frame, t + d AS aim, d AS "offset" FROM f CROSS JOIN (VALUES ({-DAY}::BIGINT), (0::BIGINT), ({DAY}::BIGINT)) AS x(d)),
r AS (SELECT b.run_id, b.frame, "offset", f.frame AS other, row_number() OVER (PARTITION BY b.run_id, b.frame, "offset" ORDER BY abs(f.t - aim), f.frame) AS r FROM b JOIN f ON f.run_id = b.run_id)
SELECT run_id, frame, "offset", other FROM r WHERE r = 1""")
def temporal_window_samples(spark, sf_dir):
    frames = tl.number_rows(observations(spark, sf_dir).where("topic = 'view'"), "run_id", ["t", "event_id"], "frame")
    return tl.offset_samples(frames, [-DAY, 0, DAY], "run_id")
