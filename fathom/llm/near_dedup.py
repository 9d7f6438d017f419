"""MinHash near-dedup with sequential Bayesian verification.

A document's set is its distinct shingles of five words (words: runs of characters other than ASCII white
space, A-Z lower-cased; under five words the whole sequence is the one shingle). Documents are linked if
their sets' Jaccard similarity reaches the threshold, 0.75.

1. One pass computes each set's size, a 128-bit identity, a MinHash signature of 128 values and 32 band keys
   of four values: two sets at 0.75 share none with odds of (1 - 0.75^4)^32 = 5e-6, more similar ones less.
2. Rows of equal sets are one node, named by its first row, from a map-side-combined minimum: copies never meet.
3. Candidates. A star first: in each bucket every node meets the bucket's centre, the node whose bands are the
   most crowded (of a family of near copies that is the one that most resemble), and one more. That is every pair of a
   bucket of up to three. The links found are joined into components, and larger buckets that still hold several are looked
   at again: there each node outside the largest component meets the nodes of all other components, in tiles of
   bounded size. Pairs inside a component need no test: they can't change it.
4. Verification. A pair's signatures are compared in batches; after each, the pair is dropped if the posterior
   odds that its similarity reaches the threshold, given the matches so far and a uniform prior, are under
   `miss`. Survivors are confirmed on the full sets, exactly: those of the stars by a join, those of a tile where they
   are. A tile gives only links that join components that it hasn't joined yet, a forest: never more than it has nodes.
5. Components by large-star / small-star rounds. So a large family costs a few rows per member, its pairs are listed
   nowhere, and no link between components is lost.

Defined results: null or empty texts have empty sets, are linked with nothing and are their own component; rows
without an id take part, and a component of such rows alone has no id; rows that repeat a doc_id are each resolved by their own text, and all those
with a component's id count as kept in `near_duplicates`, while `drop_near_duplicates` leaves one. Extra columns are ignored
by `near_duplicates` and kept by `drop_near_duplicates`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import arrow_rows
from .common import col, connected_components, stage, unstage, unused

PERMUTATIONS, BANDS, BATCH = 128, 32, 16
#: Shingles in a block of a tile, about, each node counting 64 more: bounds a task's memory.
TILE = 1 << 18
#: Rows of texts or sets in an Arrow batch.
BATCH_ROWS = 1000
#: Distinct shingles signed at a time: bounds memory for very long texts.
SIGN_ROWS = 2048


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of k words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(w) - k + 1
    step = np.uint64(0x9E3779B97F4A7C15)
    if n < 1:
        h = np.array([len(w)], np.uint64) * step
        for x in w:
            h = mix64((h ^ x) * step)
        return h
    h = np.full(n, k * 1000003, np.uint64)
    for i in range(k):
        h = (h ^ w[i : i + n]) * step
        h ^= h >> np.uint64(29)
    return np.unique(mix64(h))


def permutations(n: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    seq = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seq[:n], seq[n:] | np.uint64(1)


def signature(s: np.ndarray, xor: np.ndarray, mul: np.ndarray) -> np.ndarray:
    """The least value of each permutation over a set, its high 32 bits."""
    low = np.full(len(xor), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), SIGN_ROWS):
        np.minimum(low, ((s[at : at + SIGN_ROWS, None] ^ xor) * mul).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def sketch_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, rk, n, k1, k2, sig, keys) of each row; rk hashes the text, k1 and k2 identify the set, keys are its band keys."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("rk", T.LongType()), T.StructField("n", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches):
        import xxhash

        xor, mul = permutations()
        width = PERMUTATIONS // BANDS
        salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            n, k1, k2, sigs, keys = [], [], [], [], []
            for t in batch.column(2):
                s = shingle_set(t.as_py())
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                k1.append(int.from_bytes(d[:8], "little", signed=True))
                k2.append(int.from_bytes(d[8:], "little", signed=True))
                if len(s):
                    sig = signature(s, xor, mul)
                    sigs.append(sig.tobytes())
                    h = salt.copy()
                    for i in range(width):
                        h = mix64((h ^ sig[i::width][:BANDS].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
                    keys.append(h.view(np.int64))
                else:
                    sigs.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return docs.select(col(doc_id).cast("long").alias("id"), F.xxhash64(col(text)).alias("rk"), col(text).alias("t")).mapInArrow(run, schema)


def least_matches(threshold: float, miss: float, n: int = PERMUTATIONS, batch: int = BATCH) -> list[tuple[int, int]]:
    """(values compared, least matches to go on) after each batch.

    With a uniform prior the posterior after m matches of c is Beta(m + 1, c - m + 1), and
    P(similarity >= t) = P(Binomial(c + 1, t) <= m).
    """
    out = []
    for c in range(batch, n + 1, batch):
        below, m = 0.0, 0
        while True:
            below += math.comb(c + 1, m) * threshold**m * (1 - threshold) ** (c + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append((c, m))
    return out


def bayes_survivors(pairs: DataFrame, sets: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Candidate pairs (a, b) whose signatures leave a chance of at least `miss` at every batch."""
    needs = least_matches(threshold, miss)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, PERMUTATIONS) for i in (2, 3))
            left, hits, at = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            for c, m in needs:
                hits[left] += (x[left, at:c] == y[left, at:c]).sum(axis=1)
                left, at = left[hits[left] >= m], c
            yield batch.select(["a", "b"]).take(pa.array(left))

    one, two = sets.select(F.col("node").alias("a"), F.col("sig").alias("x")), sets.select(F.col("node").alias("b"), F.col("sig").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def shared_sizes(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many values of the sorted set x each of the other sets holds."""
    ends = np.cumsum([len(o) for o in others])
    flat = np.concatenate(others)
    hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
    return np.diff(np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], ends])])


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    up = round(threshold * 100)

    def run(batches):
        for batch in batches:
            keep = []
            for i, (p, q) in enumerate(zip(batch.column(2), batch.column(3))):
                p, q = (np.frombuffer(v.as_py(), np.uint64) for v in (p, q))
                if 100 * min(len(p), len(q)) >= up * max(len(p), len(q)):
                    both = int(shared_sizes(p, [q])[0])
                    if 100 * both >= up * (len(p) + len(q) - both):
                        keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    one, two = sets.select(F.col("node").alias("a"), F.col("s").alias("p")), sets.select(F.col("node").alias("b"), F.col("s").alias("q"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "p", "q").mapInArrow(run, "a long, b long")


class Forest:
    """Union-find over the component labels of a tile."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, c: int) -> int:
        while (p := self.up.get(c, c)) != c:
            self.up[c] = c = self.up.get(p, p)
        return c

    def join(self, c: int, d: int) -> bool:
        c, d = self.root(c), self.root(d)
        self.up[max(c, d)] = min(c, d)
        return c != d


def tile_links(ids, comp, asks, answers, sig, sets, needs, up: int) -> list[tuple[int, int]]:
    """Links between the asking and the answering nodes of a tile that join its components: at most one less than those are.

    Each asking node meets the answering ones of other components: signatures batch by batch while the posterior allows, then
    the full sets of the survivors, the most alike first. What a link has joined is not looked at again."""
    forest, out, sizes = Forest(), [], np.array([len(s) for s in sets])
    turn = np.full(len(ids), -1)  # pairs of two asking nodes are tested once
    for k, x in enumerate(np.flatnonzero(asks)):
        turn[x] = k
        label = np.array([forest.root(c) for c in comp.tolist()])
        y = np.flatnonzero(answers & (label != label[x]) & ~((turn >= 0) & answers[x]) & (100 * np.minimum(sizes, sizes[x]) >= up * np.maximum(sizes, sizes[x])))
        hits, at = np.zeros(len(y), np.int64), 0
        for c, m in needs:
            hits = hits + (sig[y, at:c] == sig[x, at:c]).sum(axis=1)
            live = hits >= m
            y, hits, at = y[live], hits[live], c
        y, step = y[np.lexsort((ids[y], -hits))], 4
        while len(y):
            now, y = y[:step], y[step:]
            both = shared_sizes(sets[x], [sets[i] for i in now])
            for i in now[100 * both >= up * (sizes[x] + sizes[now] - both)]:
                if forest.join(int(comp[x]), int(comp[i])):
                    out.append((int(ids[x]), int(ids[i])))
            mine = forest.root(int(comp[x]))
            y, step = y[[forest.root(int(comp[i])) != mine for i in y]] if len(y) else y, min(4 * step, 256)
    return out


def tiled_links(mixed: DataFrame, sets: DataFrame, threshold: float, miss: float) -> DataFrame:
    """(a, b) of confirmed links that join the components of each bucket.

    mixed: (key, node, w, c, outside), w the node's weight, outside telling the nodes that are not in the bucket's largest component; only these ask.
    A bucket is cut into blocks of about TILE of weight by a hash of the node, the asking nodes and all nodes each on their own; an asking
    block and an answering block meet in a tile. Buckets of one tile are put together by a hash."""
    needs, up = least_matches(threshold, miss), round(threshold * 100)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("node", "ascending")])
        keys, nodes = (t.column(c).to_numpy() for c in ("key", "node"))
        own = np.ones(len(keys), bool)  # rows that repeat a node count once
        own[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        t = t.filter(pa.array(own))
        keys, nodes, comp, asks, answers = (t.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "c", "asks", "answers"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(keys), -1)
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in t.column("s")]
        ends = [*np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        out, a = [], 0
        for b in ends:
            out += tile_links(nodes[a:b], comp[a:b], asks[a:b], answers[a:b], sig[a:b], sets[a:b], needs, up)
            a = b
        return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})

    sizes = mixed.groupBy("key").agg(F.ceil(F.sum("w") / TILE).cast("int").alias("tm"), F.ceil(F.sum(F.when(F.col("outside"), F.col("w"))) / TILE).cast("int").alias("tu"))
    pools = max(1, int(mixed.agg(F.sum("w")).first()[0] or 0) // TILE)
    mb, ub = F.pmod(F.xxhash64("node"), F.col("tm")).cast("int"), F.when(F.col("outside"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("tu"))).cast("int")
    rows = mixed.join(sizes, "key").withColumn("mb", mb).withColumn("ub", ub)
    answer = F.transform(F.sequence(F.lit(0), F.col("tu") - 1), lambda i: F.struct(i.alias("i"), F.col("mb").alias("j")))
    ask = F.when(F.col("outside"), F.transform(F.sequence(F.lit(0), F.col("tm") - 1), lambda j: F.struct(F.col("ub").alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    rows = rows.withColumn("g", F.explode(F.array_union(answer, ask)))
    alone = (F.col("tm") == 1) & (F.col("tu") == 1)
    rows = rows.select(F.when(alone, F.pmod(F.xxhash64("key"), F.lit(pools))).otherwise(F.col("key")).alias("pool"), alone.alias("alone"), F.col("g.i").alias("i"), F.col("g.j").alias("j"), "key", "node", "c", (F.col("outside") & (F.col("ub") == F.col("g.i"))).alias("asks"), (F.col("mb") == F.col("g.j")).alias("answers"))
    return rows.join(sets, "node").groupBy("pool", "alone", "i", "j").applyInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, repeats: bool, doc_id: str, text: str) -> DataFrame:
    """(node, sig, s): the full sets, as sorted hashes, of the texts that wanted (node, id, rk, sig) asks for."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([shingle_set(t.as_py()).tobytes() for t in batch.column(2)], pa.binary())], names=["node", "sig", "s"])

    rows = docs.select(col(doc_id).cast("long").alias("i"), F.xxhash64(col(text)).alias("k"), col(text).alias("t"))
    rows = rows.join(wanted, F.col("i").eqNullSafe(F.col("id")) & (F.col("k") == F.col("rk"))).select("node", "sig", "t")
    return (rows.dropDuplicates(["node"]) if repeats else rows).mapInArrow(run, "node long, sig binary, s binary")


def near_rows(docs: DataFrame, threshold: float = 0.75, miss: float = 1e-6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, rk, n, family, component_id) of every row; family tells components apart, null for empty sets. All steps in Python run here, in small batches."""
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _near_rows(docs, threshold, miss, doc_id, text)


def _near_rows(docs: DataFrame, threshold: float, miss: float, doc_id: str, text: str) -> DataFrame:
    sk = stage(sketch_table(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "sketch")
    nodes = stage(sk.where("n > 0").groupBy("k1", "k2").agg(F.min("row").alias("node"), F.min("id").alias("low"), F.min("n").alias("n"), F.min_by("keys", "row").alias("keys")), "nodes")
    every = nodes.select("node", "n", F.explode("keys").alias("key"))
    crowd = every.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    buckets = stage(every.join(crowd, "key"), "buckets")
    fame = buckets.groupBy("node").agg(F.sum("m").alias("fame"))
    heads = buckets.join(fame, "node").groupBy("key").agg(-F.max(F.struct("fame", (-F.col("node")).alias("neg"))).getField("neg"), F.min("node").alias("least"), F.max("node").alias("most")).toDF("key", "centre", "least", "most")
    heads = heads.select("key", "centre", F.when(F.col("centre") != F.col("least"), F.col("least")).otherwise(F.col("most")).alias("other"))
    met = buckets.join(heads, "key").select("node", F.explode(F.array("centre", "other")).alias("o")).where("node <> o")
    pairs = stage(met.select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b")).distinct(), "pairs")
    repeats = not sk.groupBy("id", "rk").count().where("count > 1").isEmpty()
    wanted = sk.select("row", "id", "rk", "sig").join(buckets.select("node").distinct(), F.col("row") == F.col("node"))
    sets = stage(full_sets(docs, wanted.select("node", "id", "rk", "sig"), repeats, doc_id, text), "sets")
    survivors = stage(bayes_survivors(pairs, sets, threshold, miss), "survivors")
    links = stage(confirmed(survivors, sets, threshold), "links")
    unstage(pairs, survivors)
    comps = connected_components(links)
    # the stars have tested all pairs of buckets of up to three nodes
    now = buckets.where("m > 3").join(comps.toDF("node", "component"), "node", "left").select("key", "node", (F.col("n") + 64).alias("w"), F.coalesce("component", "node").alias("c"))
    now = stage(now, "labelled")
    by = now.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "c")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    mixed = stage(now.join(by.select("key", F.col("top.c").alias("largest")), "key").select("key", "node", "w", "c", (F.col("c") != F.col("largest")).alias("outside")), "mixed")
    more = stage(tiled_links(mixed, sets, threshold, miss), "links")
    unstage(buckets, now, mixed, sets)
    if not more.isEmpty():
        comps = connected_components(links.union(more))
    families = nodes.select("node", "low").join(comps.toDF("node", "component"), "node")
    families = stage(families.join(families.groupBy("component").agg(F.min("low").alias("smallest")), "component").select("node", "component", "smallest"), "families")
    unstage(links, more)
    of_set = nodes.select("k1", "k2", "node", "low").join(families, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("family"), F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("smallest")).alias("c"))
    out = sk.select("row", "id", "rk", "n", "k1", "k2").join(of_set, ["k1", "k2"], "left")
    return out.select("row", "id", "rk", "n", "family", F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("id")).alias("component_id"))


def near_duplicates(docs: DataFrame, threshold: float = 0.75, miss: float = 1e-6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: component_id is the smallest id reachable over links, kept tells the rows of that id."""
    rows = near_rows(docs, threshold, miss, doc_id, text)
    return rows.select("id", F.col("n").alias("n_shingles"), "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.75, miss: float = 1e-6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, one row of each component, all columns as they were: of the rows with the smallest id the first. Rows of empty sets all stay."""
    rows = stage(near_rows(docs, threshold, miss, doc_id, text), "verdicts")
    first = rows.where(F.col("component_id").eqNullSafe(F.col("id")) & (F.col("n") > 0)).groupBy("family").agg(F.min("row").alias("first"))
    rows = rows.join(first, F.col("row") == F.col("first"), "left").withColumn("stays", F.col("first").isNotNull() | (F.col("n") == 0))
    i, k, told = unused("i", docs), unused("k", docs), rows.groupBy("id", "rk").agg(F.bool_or("stays").alias("any"), F.bool_and("stays").alias("all"))
    told = stage(told.where("not all").select(F.col("id").alias(i), F.col("rk").alias(k), F.col("any").alias("any")), "gone")
    same = lambda t: col(doc_id).cast("long").eqNullSafe(t[i]) & (F.xxhash64(col(text)) == t[k])
    out = docs.join(told, same(told), "left_anti")
    again = told.where("any").drop("any")
    if again.isEmpty():
        return out
    names = [unused("id_", docs), unused("hash_", docs)]
    once = docs.withColumns({names[0]: col(doc_id).cast("long"), names[1]: F.xxhash64(col(text))}).join(again, same(again), "left_semi")
    return out.unionByName(once.dropDuplicates(names).drop(*names))
