"""Quality classifier by positive-unlabelled learning: a small network that minimises the non-negative unbiased risk.

Trusted positives are labelled rows of good quality; everything else that is used is a sample of all documents
without their labels. The class prior pi, the share of good texts among those, is estimated from the same two
samples: a first network tells positives from unlabelled rows, and pi is the least ratio of the shares of the two that
score above a cut, over cuts that leave enough rows (best-bin estimation). The risk is then

    pi R+(f) + max(0, Ru-(f) - pi R+-(f)),

with the logistic loss; where the second term is negative, the step goes against it, as the method has it.

Features describe the whole text: byte classes, words, immediate repeats, lines. Scores cover every row.
Fitting reads at most `positives` and `unlabelled` rows, chosen by a hash of the id, so that its cost and the
driver's memory are bounded whatever the corpus; 16 numbers a row reach the driver.

Defined results: null and empty texts have the features of an empty text and get its score. Without any labelled
positive all scores are 0.5. Label rows are grouped by doc_id (the largest label counts); rows that repeat a doc_id count each. Other columns are kept, whatever
their names; one named like the score is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, crc_bucket, unused

N_FEATURES = 16
_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
_STOPS, _MARKS = np.array([46, 44, 59, 58, 63, 45, 39, 34, 40, 41]), np.array([33, 35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126])


def text_features(text: str | None) -> list[float]:
    """Dense features of one whole text."""
    from operator import eq

    raw = (text or "").encode()
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = (text or "").split()
    n, w = max(1, len(raw)), max(1, len(words))
    upper, lower, digit = int(hist[_UPPER].sum()), int(hist[_LOWER].sum()), int(hist[_DIGIT].sum())
    repeats = sum(map(eq, words, words[1:]))
    kinds = len(set(words))
    lines = (text or "").split("\n")
    share = hist[hist > 0] / n
    mean = sum(map(len, words)) / w
    return [
        np.log1p(len(raw)), np.log1p(len(words)), mean, upper / n, lower / n, digit / n, float(hist[_STOPS].sum()) / n, float(hist[_MARKS].sum()) / n,
        float(hist[128:].sum()) / n, float(hist[124] + hist[9]) / w, repeats / w, kinds / w, np.log1p(w / max(1, kinds)), len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        float(-(share * np.log2(share)).sum()) if len(share) else 0.0,
    ]


def features_table(rows: DataFrame) -> DataFrame:
    """f0, f1, ... instead of t, the last column, of each row, in one pass without a shuffle."""
    schema = T.StructType([f for f in rows.schema.fields if f.name != "t"] + [T.StructField(f"f{i}", T.DoubleType()) for i in range(N_FEATURES)])

    def run(batches):
        for batch in batches:
            x = np.array([text_features(t.as_py()) for t in batch.column(batch.num_columns - 1)], float).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c) for c in x.T)], names=[*batch.schema.names[:-1], *(f"f{i}" for i in range(N_FEATURES))])

    return rows.mapInArrow(run, schema)


def _net(seed: int, d: int, h: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [rng.normal(0, d**-0.5, (d, h)), np.zeros(h), rng.normal(0, h**-0.5, h), np.zeros(1)]


def _forward(net, x):
    hid = np.tanh(x @ net[0] + net[1])
    return hid, hid @ net[2] + net[3][0]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _train(xp, xu, prior: float | None, hidden=16, epochs=40, batch=512, rate=0.01, seed=7) -> list[np.ndarray]:
    """Adam over minibatches; prior None trains positives against unlabelled rows, else the non-negative PU risk."""
    net, rng = _net(seed, xp.shape[1], hidden), np.random.default_rng(seed)
    mom, var, t = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net], 0
    steps = max(1, max(len(xp), len(xu)) // batch)
    for _ in range(epochs):
        op, ou = rng.permutation(len(xp)), rng.permutation(len(xu))
        for s in range(steps):
            p, u = xp[op[np.arange(s * batch, (s + 1) * batch) % len(xp)]], xu[ou[np.arange(s * batch, (s + 1) * batch) % len(xu)]]
            x = np.concatenate([p, u])
            hid, z = _forward(net, x)
            zp, zu = z[: len(p)], z[len(p) :]
            g = np.empty_like(z)  # of the risk by the outputs; loss(z, +) = log(1 + e^-z), its slope -sigmoid(-z)
            if prior is None:
                g[: len(p)], g[len(p) :] = -_sigmoid(-zp) / len(p), _sigmoid(zu) / len(u)
            else:
                rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                if rest >= 0:
                    g[: len(p)], g[len(p) :] = (-prior * _sigmoid(-zp) - prior * _sigmoid(zp)) / len(p), _sigmoid(zu) / len(u)
                else:
                    g[: len(p)], g[len(p) :] = prior * _sigmoid(zp) / len(p), -_sigmoid(zu) / len(u)
            back = np.outer(g, net[2]) * (1 - hid**2)
            grads = [x.T @ back + 1e-4 * net[0], back.sum(0), hid.T @ g + 1e-4 * net[2], np.array([g.sum()])]
            t += 1
            for i, d in enumerate(grads):
                mom[i], var[i] = 0.9 * mom[i] + 0.1 * d, 0.999 * var[i] + 0.001 * d * d
                net[i] = net[i] - rate * (mom[i] / (1 - 0.9**t)) / (np.sqrt(var[i] / (1 - 0.999**t)) + 1e-8)
    return net


def estimate_prior(sp: np.ndarray, su: np.ndarray) -> float:
    """Share of positives among unlabelled rows: the least ratio of the two samples' shares above a cut."""
    sp, su = np.sort(sp), np.sort(su)
    cuts = np.quantile(sp, np.linspace(0, 0.9, 91))
    qp, qu = 1 - np.searchsorted(sp, cuts) / len(sp), 1 - np.searchsorted(su, cuts) / len(su)
    slack = np.sqrt(np.log(40) / (2 * len(sp))) + np.sqrt(np.log(40) / (2 * len(su)))
    at = int(np.argmin((qu + slack) / qp))
    return float(np.clip(qu[at] / qp[at], 0.02, 0.98))


def fit_quality(docs: DataFrame, labels: DataFrame, held_out=None, positives: int = 12000, unlabelled: int = 12000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> dict:
    """A model from labelled positives and unlabelled rows; held_out is a Column that tells ids whose labels aren't read."""
    if held_out is not None:
        labels = labels.where(~held_out)
    marks = labels.select(col(doc_id).alias("l"), col(label).alias("y")).groupBy("l").agg(F.max("y").alias("y"))
    trusted = marks.where("y = 1 and l is not null").orderBy(F.xxhash64("l"), "l").limit(positives).select("l")
    texts = docs.select(col(doc_id).alias("id"), col(text).alias("t"))
    some = texts.select(F.col("id").alias("l")).where("l is not null").orderBy(F.xxhash64("l", F.lit(1)), "l").limit(unlabelled)
    chosen = trusted.select("l", F.lit(1).alias("p")).union(some.select("l", F.lit(0))).groupBy("l").agg(F.max("p").alias("p"), F.min("p").alias("q"))
    rows = texts.join(F.broadcast(chosen), F.col("id") == F.col("l"))  # at most positives + unlabelled ids
    got = features_table(rows.select("id", "p", "q", "t")).orderBy("id", "p", *[f"f{i}" for i in range(N_FEATURES)]).toPandas()
    x = got[[f"f{i}" for i in range(N_FEATURES)]].to_numpy(float)
    is_p, is_u = got["p"].to_numpy() == 1, got["q"].to_numpy() == 0
    if not is_p.any() or not is_u.any():
        return {"net": None}
    mid, wide = x[is_u].mean(0), x[is_u].std(0) + 1e-6
    x = np.clip((x - mid) / wide, -6, 6)
    xp, xu = x[is_p], x[is_u]
    first = _train(xp[::2], xu[::2], None, epochs=15)
    held_p, held_u = (xp[1::2], xu[1::2]) if len(xp) > 1 and len(xu) > 1 else (xp, xu)
    prior = estimate_prior(_forward(first, held_p)[1], _forward(first, held_u)[1])
    return {"net": _train(xp, xu, prior), "mid": mid, "wide": wide, "prior": prior}


def score_quality(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text", score: str = "score") -> DataFrame:
    """The documents with the probability that each whole text is of good quality."""
    names = [c for c in docs.columns if c != score]
    kept = docs.select(*map(col, names))
    schema = T.StructType([*kept.schema.fields, T.StructField(score, T.DoubleType())])
    at = names.index(text)

    def run(batches):
        for batch in batches:
            if model["net"] is None or not batch.num_rows:
                z = np.zeros(batch.num_rows)
            else:
                x = np.array([text_features(t.as_py()) for t in batch.column(at)], float).reshape(-1, N_FEATURES)
                z = _forward(model["net"], np.clip((x - model["mid"]) / model["wide"], -6, 6))[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_sigmoid(z), pa.float64())], names=[*names, score])

    return kept.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the classifier does not reject, as they were."""
    model = fit_quality(docs, labels, crc_bucket(col(doc_id), 5) == 0, doc_id=doc_id, text=text)
    score = unused("score", docs)
    return score_quality(docs, model, doc_id, text, score).where(F.col(score) >= cut).select(*map(col, docs.columns))
