"""Toxicity: gradient-boosted trees over dense features of the whole text, with isotonic calibration.

Features: densities of a lexicon (whole words, word stems, obfuscated spellings), its nearness to the second person,
capitals, punctuation and obfuscation rates, and lengths. The lexicon is a short fixed list of insults plus the
words and stems that a part of the labelled rows shows to be toxic (every row with them is labelled so, or nearly).

The labelled rows used are at most `rows`, chosen by a hash of the id, dealt by another hash to FOLDS parts. Each part's features come
from a lexicon counted on the others (one pass on the executors counts all), and its scores for the calibration from
trees grown on the others, so nothing is fitted on what it was derived from; the final lexicon and trees use all parts. A lexicon has at
most `terms` learned words and stems, the most frequent ones: the model's size. Only features reach the driver. Labels of held-out ids are never read.

Defined results: null and empty texts have the features of an empty text and get its score. Without both labels in the sample
all scores are 0. Label rows are grouped by doc_id (the largest label counts); rows that repeat a doc_id count each. Other columns are kept, whatever their
names; one named like the score is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col

#: Plain insults in four languages, and second-person words.
INSULTS = "idiot moron loser pathetic worthless scum clown trash disgusting stupid imbecile dumb dumbass jerk creep pig vermin filth bastard bitch retard dummkopf trottel abschaum widerlich idiota estúpido imbécil basura asqueroso crétin débile ordure minable".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti usted ustedes vosotros".split()
LEET = str.maketrans("013457@$!", "oieastasi")
WORD = re.compile(r"[^\W_]+(?:[@$!*'_-]+[^\W_]+)*", re.UNICODE)
STEMS = (4, 5, 6)
NAMES = ["word_rate", "stem_rate", "hidden_rate", "any_hit", "hits", "kinds", "near_you", "you_rate", "caps_rate", "shout_rate", "exclaim_rate", "mark_rate", "digit_in_word", "stretched", "word_length", "log_words"]
FOLDS = 5
STRETCH = re.compile(r"(\w)\1\1")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def lexicon_counts(rows: DataFrame) -> DataFrame:
    """(term, pos, n): of each word and stem (marked with *), by fold, in how many rows and in how many of label 1 it occurs; rows are (t, y, fold)."""

    def run(batches):
        for batch in batches:
            pos: dict[str, list[int]] = {}
            n: dict[str, list[int]] = {}
            for t, y, f in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kinds = set(words_of(t.as_py()))
                for w in kinds | {w[:k] + "*" for w in kinds for k in STEMS if len(w) > k}:
                    n.setdefault(w, [0] * FOLDS)[f] += 1
                    if y:
                        pos.setdefault(w, [0] * FOLDS)[f] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), *(pa.array([x[f] for x in n.values()], pa.int64()) for f in range(FOLDS)), *(pa.array([pos.get(w, [0] * FOLDS)[f] for w in n], pa.int64()) for f in range(FOLDS))], names=["term", *(f"n{f}" for f in range(FOLDS)), *(f"p{f}" for f in range(FOLDS))])

    cols = [f"{c}{f}" for c in "np" for f in range(FOLDS)]
    return rows.mapInArrow(run, "term string, " + ", ".join(f"{c} long" for c in cols)).groupBy("term").agg(*[F.sum(c).alias(c) for c in cols])


def learn_lexicons(rows: DataFrame, terms: int) -> list[dict]:
    """A lexicon without each fold and one with all: the terms whose rows are toxic at least nine times in ten, and the fixed list."""
    n, p = (sum((F.col(f"{c}{f}") for f in range(1, FOLDS)), F.col(f"{c}0")) for c in "np")
    telling = lambda n, p: (p >= 3) & (p >= 0.9 * n)
    some = telling(n, p)
    for f in range(FOLDS):
        some = some | telling(n - F.col(f"n{f}"), p - F.col(f"p{f}"))
    got = lexicon_counts(rows).where(some).orderBy(F.desc(p), "term").limit(terms).collect()
    out = []
    for skip in [*range(FOLDS), None]:
        keep = []
        for r in got:
            m, q = (sum(r[f"{c}{f}"] for f in range(FOLDS) if f != skip) for c in "np")
            if q >= 3 and q >= 0.9 * m:
                keep.append(r.term)
        short: set[str] = set()
        for s in sorted({t[:-1] for t in keep if t.endswith("*")}, key=lambda s: (len(s), s)):  # a longer stem adds nothing to a shorter one
            if not any(s[:k] in short for k in STEMS if k < len(s)):
                short.add(s)
        out.append({"words": frozenset(INSULTS) | {t for t in keep if not t.endswith("*")}, "stems": frozenset(short)})
    return out


def toxic_features(text: str | None, words: frozenset, stems: frozenset, you: frozenset) -> list[float]:
    """NAMES of one whole text."""
    raw = text or ""
    ws = words_of(raw)
    n = max(1, len(ws))
    kinds = set(ws)
    bad = kinds & words
    stem = {w for w in kinds if w[:4] in stems or w[:5] in stems or w[:6] in stems}
    plain = {w: re.sub(r"[^\w]|_", "", w.translate(LEET)) for w in kinds if not w.isalpha()}
    hidden = {w for w, p in plain.items() if p != w and (p in words or p[:5] in stems or p[:6] in stems)}
    hit = bad | stem | hidden
    at = [i for i, w in enumerate(ws) if w in hit] if hit else []
    ours = [i for i, w in enumerate(ws) if w in you]
    near = 0.0
    if at and ours:
        o = np.array(ours)
        p = np.searchsorted(o, at)
        gap = np.minimum(np.abs(o[np.minimum(p, len(o) - 1)] - at), np.abs(o[np.maximum(p - 1, 0)] - at))
        near = float((1 / (1 + gap)).max())
    size = max(1, len(raw))
    hist = np.bincount(np.frombuffer(raw.encode(), np.uint8), minlength=256)
    letters = max(1, int(hist[65:91].sum() + hist[97:123].sum()))
    marks = int(hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum())
    return [
        sum(w in bad for w in ws) / n if bad else 0.0, sum(w in stem for w in ws) / n if stem else 0.0, sum(w in hidden for w in ws) / n if hidden else 0.0,
        float(bool(hit)), float(len(at)), float(len(hit)), near, len(ours) / n, float(hist[65:91].sum()) / letters, raw.count("!!") / n, float(hist[33]) / size, marks / size,
        len(plain) / max(1, len(kinds)), float(len(STRETCH.findall(raw)) / n), sum(map(len, ws)) / n, float(np.log1p(len(ws))),
    ]


def _matrix(column, lex: dict) -> np.ndarray:
    you = frozenset(SECOND_PERSON)
    return np.array([toxic_features(t.as_py(), lex["words"], lex["stems"], you) for t in column], float).reshape(-1, len(NAMES))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> dict:
    """Boosted regression trees on the logistic loss, split on histograms, grown level by level."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    b = np.stack([np.searchsorted(q, c, side="right") for q, c in zip(cuts, x.T)], axis=1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    z, out, d = np.full(len(y), base), [], x.shape[1]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p) + 1e-9
        node = np.zeros(len(y), int)
        feat, thr = np.full(2**depth - 1, -1), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            G, H = np.zeros((width, d, bins)), np.zeros((width, d, bins))
            for j in range(d):
                key = node * bins + b[:, j]
                G[:, j] = np.bincount(key, g, width * bins).reshape(width, bins)
                H[:, j] = np.bincount(key, h, width * bins).reshape(width, bins)
            gl, hl = G.cumsum(2)[..., :-1], H.cumsum(2)[..., :-1]
            gt, ht = G.sum(2)[..., None], H.sum(2)[..., None]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < 1) | (ht - hl < 1)] = -1
            best = gain.reshape(width, -1).argmax(1)
            right = np.zeros(len(y), bool)
            for v in range(width):
                j, c = divmod(int(best[v]), bins - 1)
                if gain[v, j, c] > 1e-6 and c < len(cuts[j]):
                    feat[first + v], thr[first + v] = j, cuts[j][c]
                    right |= (node == v) & (b[:, j] > c)
            node = node * 2 + right
        leaf = -np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + ridge) * rate
        z = z + leaf[node]
        out.append((feat, thr, leaf))
    return {"base": base, "trees": out, "depth": depth}


def raw_score(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.full(len(x), model["base"])
    for feat, thr, leaf in model["trees"]:
        node = np.zeros(len(x), int)
        for level in range(model["depth"]):
            at = 2**level - 1 + node
            f = feat[at]
            node = node * 2 + ((f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] >= thr[at]))
        z += leaf[node]
    return z


def fit_isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (scores, calibrated probabilities), both rising."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order].astype(float)
    blocks: list[list[float]] = []  # sum, weight, first, last
    for s, v in zip(z, y):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t[0], blocks[-1][1] + t[1], blocks[-1][2], t[3]]
    xs, ps = [], []
    for s, n, lo, hi in blocks:
        xs += [lo, hi] if hi > lo else [lo]
        ps += [s / n] * (2 if hi > lo else 1)
    return np.array(xs), np.array(ps)


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_out=None, rows: int = 20000, terms: int = 4000, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """A model from at most `rows` labelled rows; held_out is a Column that tells ids whose labels aren't read."""
    if held_out is not None:
        labels = labels.where(~held_out)
    marks = labels.select(col(doc_id).alias("id"), col(label).alias("y")).groupBy("id").agg(F.max("y").alias("y")).where("y is not null and id is not null").orderBy(F.xxhash64("id"), "id").limit(rows)
    fold = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(FOLDS)).cast("int")
    texts = docs.select(col(doc_id).alias("d"), col(text).alias("t"))
    used = texts.join(F.broadcast(marks), F.col("d") == F.col("id")).select("t", F.col("y").cast("int").alias("y"), fold.alias("fold"), "id")  # at most `rows` ids
    lexicons = learn_lexicons(used.select("t", "y", "fold"), terms)

    def run(batches):
        for batch in batches:
            folds = batch.column(2).to_numpy()
            x = np.concatenate([_matrix(batch.column(0).slice(i, 1), lexicons[f]) for i, f in enumerate(folds)]) if len(folds) else np.empty((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c) for c in x.T)], names=["y", "fold", "id", *NAMES])

    kind = docs.schema[doc_id].dataType.simpleString()
    got = used.mapInArrow(run, f"y int, fold int, id {kind}, " + ", ".join(f"{c} double" for c in NAMES)).orderBy("id", *NAMES).toPandas()
    x, y, part = got[NAMES].to_numpy(float), got["y"].to_numpy(float), got["fold"].to_numpy()
    if len(np.unique(y)) < 2:
        return {"trees": None, "lex": lexicons[-1]}
    z = np.zeros(len(y))
    for f in range(FOLDS):
        out = part == f
        if out.any() and len(np.unique(y[~out])) == 2:
            z[out] = raw_score(fit_trees(x[~out], y[~out]), x[out])
    return {"trees": fit_trees(x, y), "iso": fit_isotonic(z, y), "lex": lexicons[-1]}


def score_toxicity(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text", score: str = "score") -> DataFrame:
    """The documents with the calibrated probability that each whole text is toxic.

    A thousandth of the uncalibrated probability is mixed in, so that ranks within a calibrated step are kept."""
    names = [c for c in docs.columns if c != score]
    kept = docs.select(*map(col, names))
    schema = T.StructType([*kept.schema.fields, T.StructField(score, T.DoubleType())])
    at = names.index(text)

    def run(batches):
        for batch in batches:
            if model["trees"] is None or not batch.num_rows:
                p = np.zeros(batch.num_rows)
            else:
                z = raw_score(model["trees"], _matrix(batch.column(at), model["lex"]))
                p = 0.999 * np.interp(z, *model["iso"]) + 0.001 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*names, score])

    return kept.mapInArrow(run, schema)
