"""The thin queries opN_<name>: an operator with production parameters on its whole table, and the columns agreed for its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bpe import encode_bpe
from .decontaminate import decontaminate
from .licenses import scan_licenses
from .line_dedup import dedup_lines
from .common import crc_bucket
from .near_dedup import near_duplicates
from .packing import pack_round_trip
from .quality import fit_quality, score_quality
from .topk import divisible, integer_vectors, top_k
from .toxicity import fit_toxicity, score_toxicity
from .warc import warc_round_trip

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_path() -> str:
    """Where the public vocabulary is installed; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_bpe(spark, sf_dir: str):
    """Each document encoded, and decoded again from its ids."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(encode_bpe(docs, tokenizer_path(), decoded="decoded"))


def bpe_digests(coded):
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op4_line_dedup(spark, sf_dir: str):
    """Each document without later repeats of runs of lines."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_kept"), "text")


ORACLES["op4_line_dedup"] = r"""
WITH RECURSIVE cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
raw AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS pos FROM cut),
ln AS (SELECT doc_id, pos, regexp_replace(l, '^\s+|\s+$', '', 'g') AS l FROM raw),
w AS (SELECT doc_id, pos, l, len(regexp_split_to_array(l, '[ \t\x0B\f\r]+')) AS words FROM ln WHERE l <> ''),
e AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS en, sum(words) OVER (PARTITION BY doc_id) AS total FROM w),
s AS (SELECT *, en - words AS st FROM e),
k AS (SELECT doc_id, pos, st, en,
  CASE WHEN total - st >= 50 THEN md5(string_agg(l, chr(10)) OVER (PARTITION BY doc_id ORDER BY st RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS kf,
  CASE WHEN en >= 50 THEN md5(string_agg(l, chr(10)) OVER (PARTITION BY doc_id ORDER BY en RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)) END AS kb FROM s),
f AS (SELECT *, kf IS NOT NULL AND row_number() OVER (PARTITION BY kf ORDER BY doc_id, pos) > 1 AS hf, kb IS NOT NULL AND row_number() OVER (PARTITION BY kb ORDER BY doc_id, pos) > 1 AS hb FROM k),
g AS (SELECT doc_id, pos, coalesce(max(hf::int) OVER (PARTITION BY doc_id ORDER BY st RANGE BETWEEN 49 PRECEDING AND CURRENT ROW), 0) + coalesce(max(hb::int) OVER (PARTITION BY doc_id ORDER BY en RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING), 0) > 0 AS gone FROM f),
d AS (SELECT doc_id, count(*) AS n FROM g WHERE gone GROUP BY 1),
t AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY pos) AS text, max((trim(l) <> '')::int) AS some FROM raw ANTI JOIN (SELECT * FROM g WHERE gone) USING (doc_id, pos) GROUP BY 1),
r AS (SELECT c.doc_id, coalesce(d.n, 0)::BIGINT AS n_removed, CASE WHEN d.n IS NULL THEN c.text WHEN coalesce(t.some, 0) = 0 THEN '' ELSE t.text END AS text FROM cut c LEFT JOIN d USING (doc_id) LEFT JOIN t USING (doc_id))
SELECT doc_id, n_removed, length(text)::BIGINT AS n_chars_kept, text FROM r
"""


@query
def op9_decontaminate(spark, sf_dir: str):
    """Benchmark items found in documents."""
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SHINGLES = r"""
{name}_w AS (SELECT {key} AS k, list_filter(regexp_split_to_array({lower}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM {table}),
{name} AS (SELECT DISTINCT k, s FROM (SELECT k, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN ['short ' || array_to_string(ws, ' ')] ELSE [] END) AS s FROM {name}_w))"""

LOWER, ASCII_LOWER = "lower(coalesce(text, ''))", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op9_decontaminate"] = f"""
WITH {SHINGLES.format(name="d", key="doc_id", table="documents", lower=LOWER)}, {SHINGLES.format(name="b", key="item_id", table="benchmark", lower=LOWER)},
n AS (SELECT k, count(*) AS n_item FROM b GROUP BY 1)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM (SELECT d.k AS doc_id, b.k AS item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY 1, 2) JOIN n ON n.k = item_id
WHERE n_shared >= 0.75 * n_item
"""


@query
def op10_near_dedup(spark, sf_dir: str):
    """Component of each document over links of similar texts."""
    return near_duplicates(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLES["op10_near_dedup"] = f"""
WITH RECURSIVE {SHINGLES.format(name="d", key="doc_id", table="documents", lower=ASCII_LOWER)},
n AS (SELECT doc_id, count(s) AS n FROM documents LEFT JOIN d ON k = doc_id GROUP BY 1),
l AS (SELECT x, y FROM (SELECT p.k AS x, q.k AS y, count(*) AS c FROM d p JOIN d q ON p.s = q.s AND p.k <> q.k GROUP BY 1, 2) JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT doc_id, n::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM n JOIN (SELECT x, min(y) AS c FROM r GROUP BY 1) ON x = doc_id
"""


def scored(docs, held, score):
    return docs.select("doc_id", held.alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


@query
def op2_quality(spark, sf_dir: str):
    """Each document's quality score; labels of a fifth of the ids are held out."""
    docs, held = read(spark, sf_dir, "documents").select("doc_id", "text"), crc_bucket("doc_id", 5) == 0
    model = fit_quality(docs, read(spark, sf_dir, "labels"), held)
    return scored(score_quality(docs, model), held, F.col("score"))


@query
def op1_toxicity(spark, sf_dir: str):
    """Each document's toxicity score; labels of a quarter of the ids are held out."""
    docs, held = read(spark, sf_dir, "documents").select("doc_id", "text"), crc_bucket("doc_id", 4) == 2
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"), held)
    return scored(score_toxicity(docs, model), held, F.col("score"))


@query
def op7_licenses(spark, sf_dir: str):
    """License phrases and templates in each document."""
    found = scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", F.size("base_starts").cast("long").alias("n_base"), F.array_min("base_starts").alias("first_word"), F.array_max("base_starts").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


@query
def op6_warc(spark, sf_dir: str):
    """Every page written to WARC archives and read back from them."""
    found = warc_round_trip(read(spark, sf_dir, "pages"))
    return found.select(F.col("record_id").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


ORACLES["op6_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND head <> page_id THEN head END AS refers_to FROM m
"""


@query
def op5_topk(spark, sf_dir: str):
    """The 5 vectors of highest integer inner product for every vec_id divisible by 50."""
    vectors = integer_vectors(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.where(divisible(F.col("vec_id"), 50)), 5)


ORACLES["op5_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query
def op3_packing(spark, sf_dir: str):
    """Every document packed into rows of 2048 ids, written, and read back from them."""
    import public_tokenizers

    back = pack_round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return back.select("doc_id", "n_tokens", "n_pieces", F.sha2("ids", 256).alias("ids_sha256"))
