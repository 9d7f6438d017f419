"""The training-data operators: against SQL, brute force, round trips and held-out accuracy, with awkward rows."""

import hashlib
import random

import numpy as np
import pytest
from conftest import SF, rows_of
from pyspark.sql import functions as F

from fathom.llm import registry
from fathom.llm.bpe import Encoder, decode_bpe, encode_bpe, load_vocabulary, merge_piece
from fathom.llm.common import connected_components
from fathom.llm.decontaminate import decontaminate, drop_contaminated, least_hits
from fathom.llm.licenses import Automaton, scan_licenses
from fathom.llm.line_dedup import dedup_lines
from fathom.llm.near_dedup import drop_near_duplicates, least_matches, near_duplicates, shingle_set
from fathom.llm.packing import best_fit_decreasing, documents_of, pack_documents, pack_round_trip, unpack_documents
from fathom.llm.quality import estimate_prior, fit_quality, score_quality
from fathom.llm.queries_text import tokenizer_path
from fathom.llm.topk import integer_vectors, maxscore, top_k
from fathom.llm.toxicity import fit_isotonic, fit_toxicity, fit_trees, raw_score, score_toxicity
from fathom.llm.warc import MAGIC, read_warc, warc_round_trip, write_warc

WORDS = [f"w{i}" for i in range(4000)]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def awkward(spark, schema="doc_id long, text string, id string, key string, n long"):
    """Null and empty texts, a null id, repeated rows, long words, columns named like internals."""
    long = "x" * 5000 + " " + "y z " * 4000
    rows = [(1, None), (2, ""), (None, "a b c"), (3, "one two"), (3, "one two"), (4, long), (5, " \n\t "), (6, "a b c")]
    return spark.createDataFrame([(*r, "i", "k", 7) for r in rows], schema)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_oracles(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


# BPE


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    lib, mine = Tokenizer.from_file(tokenizer_path()), Encoder(load_vocabulary(tokenizer_path()))
    rng = random.Random(5)
    bits = ["a", "the", " ", "  ", "\n", "\t", "é", "日本", "'ll", "1", "!?", "<|endoftext|>", "\r", " ", "ſ", "x" * 70]
    texts = ["", *["".join(rng.choices(bits, k=rng.randint(1, 20))) for _ in range(500)]]
    for t, ids, want in zip(texts, mine.encode_all(texts), lib.encode_batch(texts, add_special_tokens=False)):
        assert list(memoryview(ids).cast("I")) == want.ids
        assert mine.decode_all([ids])[0] == lib.decode(want.ids, skip_special_tokens=False)


def test_segment_tree_merges_like_a_scan():
    rng = random.Random(2)
    pairs = {(a, b): (i, 4 + i) for i, (a, b) in enumerate(rng.sample([(a, b) for a in range(8) for b in range(8)], 20))}
    for _ in range(300):
        ids = [rng.randrange(4) for _ in range(rng.randint(0, 30))]
        want = list(ids)
        while True:
            best = min(((pairs[p][0], i) for i, p in enumerate(zip(want, want[1:])) if p in pairs), default=None)
            if best is None:
                break
            i = best[1]
            want[i : i + 2] = [pairs[(want[i], want[i + 1])][1]]
        assert merge_piece(list(ids), pairs) == want


def test_bpe_awkward(spark):
    got = encode_bpe(awkward(spark), tokenizer_path(), decoded="n").collect()
    assert len(got) == 8 and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert all(r.n == (r.text or "") for r in got)
    assert encode_bpe(empty(spark), tokenizer_path()).count() == 0


# Packing


def test_packing_round_trip(spark):
    import public_tokenizers as P
    import tiktoken

    from fathom.llm.packing import load_ranks

    path = P.path("byte_bpe_50k.tiktoken")
    coder = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    df = awkward(spark)
    want = sorted((str(r.doc_id), len(ids := coder.encode_ordinary(r.text or "")), np.array(ids, "<u2").tobytes()) for r in df.collect())
    packed = pack_documents(df, path, P.PATTERN, length=64).cache()
    for r in packed.collect():
        assert len(r.ids) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens == sorted(r.cu_seqlens) and r.cu_seqlens[-1] <= 64
        assert set(r.resets) <= {*r.cu_seqlens} and (not r.resets or r.resets[0] == 0)
    pieces = [r for r in unpack_documents(packed).collect()]
    assert sum(r.n for r in pieces) == sum(w[1] for w in want)
    got = documents_of(unpack_documents(packed), 64)
    unique = {w for w in want}
    assert {(str(r.doc_id), r.n_tokens, bytes(r.ids)) for r in got.where("doc_id <> 3 or doc_id is null").collect()} == {w for w in unique if w[0] != "3"}
    assert pack_round_trip(empty(spark), path, P.PATTERN).count() == 0


def test_packing_of_long_repeats(spark):
    import public_tokenizers as P
    import tiktoken

    from fathom.llm.packing import load_ranks

    path = P.path("byte_bpe_50k.tiktoken")
    coder = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    long = prose(random.Random(14), 400)
    df = spark.createDataFrame([(1, long)] * 3 + [(None, long)] * 2 + [(2, long), (1, "one two")], "doc_id long, text string")
    want = sorted(((str(r.doc_id), len(ids := coder.encode_ordinary(r.text)), -(-len(ids) // 64), np.array(ids, "<u2").tobytes()) for r in df.collect()))
    for parts, shard in [(1, 4 << 20), (1, 100), (7, 4 << 20)]:  # repeats in one shard, in shards of their own, in tasks of their own
        packed = pack_documents(df.repartition(parts), path, P.PATTERN, length=64, shard_tokens=shard)
        got = documents_of(unpack_documents(packed), 64).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.n_pieces, bytes(r.ids)) for r in got) == want


def test_packing_of_wide_ids(spark, tmp_path):
    import base64

    path = tmp_path / "wide.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % (70_000 + b) for b in range(256)))
    df = spark.createDataFrame([(1, "hello"), (2, "x" * 5000), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pack_round_trip(df, str(path), r"\S+|\s+").collect()}
    for d, t in df.collect():
        assert bytes(got[d].ids) == np.array([70_000 + ord(c) for c in t or ""], "<u4").tobytes() and got[d].n_tokens == len(t or "")


def test_best_fit_equals_a_scan():
    rng = random.Random(1)
    sizes, rooms = [rng.randint(0, 100) for _ in range(400)], []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else 100) - s)
    used: dict[int, int] = {}
    for (row, start), s in zip(best_fit_decreasing(sizes, 100), sizes):
        assert start + s <= 100
        used[row] = used.get(row, 0) + s
    assert sorted(100 - u for u in used.values()) == sorted(rooms)


# Line dedup


def test_runs_across_documents(spark):
    rng = random.Random(3)
    run = [prose(rng, 12) for _ in range(6)]  # 72 words
    own = lambda: prose(rng, 15)
    short = run[:2]
    a, b, c = [own(), *run, own()], [own(), own(), *run], [own(), *short, own()]
    df = spark.createDataFrame([(1, "\n".join(a)), (2, "\n".join(b)), (3, "\n".join(c))], "doc_id long, text string")
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert got[1].text == "\n".join(a) and got[3].text == "\n".join(c)
    assert got[2].text == "\n".join(b[:2]) and got[2].n_removed == 6


def test_whole_run_goes_whatever_its_ends(spark):
    rng = random.Random(4)
    run = [prose(rng, 30), prose(rng, 30), prose(rng, 5)]
    df = spark.createDataFrame([(i, "\n".join([prose(rng, 9), *run, prose(rng, 9)])) for i in range(20)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in dedup_lines(df).collect()}
    assert got == {i: 0 if i == 0 else 3 for i in range(20)}


def test_line_dedup_awkward(spark):
    got = {(r.doc_id, r.text): r.n_removed for r in dedup_lines(awkward(spark)).collect()}
    assert set(got.values()) == {0} and dedup_lines(awkward(spark)).count() == 8
    assert dedup_lines(empty(spark)).count() == 0
    copy = spark.createDataFrame([(1, "a " * 60), (2, "a " * 60)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in dedup_lines(copy).collect()} == {1: "a " * 60, 2: ""}


# Near-dedup


def test_families_of_near_copies(spark):
    rng = random.Random(6)
    rows, base = [], prose(rng, 200).split()
    for i in range(60):  # each a few words off the base
        w = list(base)
        for _ in range(4):
            w[rng.randrange(200)] = rng.choice(WORDS)
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, prose(rng, 100)) for i in range(60)] + [(3000, rows[0][1]), (1, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: set(shingle_set(t).tolist()) for d, t in rows}
    comp = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for x in sets:
            for y in sets:
                both = len(sets[x] & sets[y])
                if x != y and 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both) and comp[y] < comp[x]:
                    comp[x], changed = comp[y], True
    got = {r.id: r for r in near_duplicates(df).collect()}
    assert {d: r.component_id for d, r in got.items()} == comp
    assert all(r.kept == (r.id == r.component_id) and r.n_shingles == len(sets[r.id]) for r in got.values())


def brute_components(rows):
    """Smallest id reachable from each id over links of all pairs, counted through a 0/1 matrix of shingles."""
    sets = [shingle_set(t) for _, t in rows]
    names = {h: i for i, h in enumerate(np.unique(np.concatenate(sets)).tolist())}
    m = np.zeros((len(rows), len(names)), np.float32)
    for i, s in enumerate(sets):
        m[i, [names[h] for h in s.tolist()]] = 1
    size = m.sum(1)
    both = m @ m.T
    link = 100 * both >= 75 * (size[:, None] + size[None, :] - both)
    ids = np.array([i for i, _ in rows])
    comp = ids.copy()
    while True:
        low = np.where(link, comp[None, :], np.iinfo(np.int64).max).min(1)
        if (low == comp).all():
            return dict(zip(ids.tolist(), comp.tolist()))
        comp = low


@pytest.mark.parametrize("tile", [1 << 13, None])
def test_one_bucket_of_thousands(spark, monkeypatch, tile):
    """A family whose members are alike enough to share buckets, many of them not linked with its centre."""
    from fathom.llm import near_dedup

    if tile:
        monkeypatch.setattr(near_dedup, "TILE", tile)
    rng = random.Random(16)
    base, rows = prose(rng, 60).split(), []
    for i in range(600 if tile else 2600):
        w = list(base)
        for _ in range(rng.choice([1, 2, 2, 3, 4])):
            w[rng.randrange(60)] = rng.choice(WORDS)
        rows.append((7000 - i, " ".join(w)))
    want = brute_components(rows)
    got = {r.id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 20


def test_near_dedup_awkward(spark):
    got = near_duplicates(awkward(spark)).collect()
    assert len(got) == 8 and all(r.n_shingles == 0 and r.component_id == r.id for r in got if r.id in (1, 2, 5))
    assert near_duplicates(empty(spark)).count() == 0
    assert drop_near_duplicates(awkward(spark)).columns == awkward(spark).columns


def test_near_dedup_null_and_repeated_ids(spark):
    rng = random.Random(17)
    a, b = prose(rng, 100), prose(rng, 100)
    near = a + " more"
    rows = [(5, a), (None, near), (5, b), (9, b), (7, a), (7, a), (None, "x y"), (None, "x y"), (1, None), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=repr)
    want = [(5, 96, 5, True), (None, 97, 5, False), (5, 96, 5, True), (9, 96, 5, False), (7, 96, 5, False), (7, 96, 5, False), (None, 1, None, True), (None, 1, None, True), (1, 0, 1, True), (1, 0, 1, True)]
    assert got == sorted(want, key=repr)
    left = sorted(((r.doc_id, r.text) for r in drop_near_duplicates(df).collect()), key=repr)
    assert left == sorted([(5, a), (5, b), (None, "x y"), (1, None), (1, None)], key=repr)


def test_pruning_bounds():
    for c, m in least_matches(0.75, 1e-7):
        assert 0 <= m < c * 0.75


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 51: 50}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# Decontamination


def test_items_in_long_documents(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randint(6, 60))) for i in range(40)]
    docs = [(i, f"{prose(rng, 1500)} {items[i][1].upper() if i % 2 else items[i][1]} {prose(rng, 1500)}") for i in range(30)] + [(100 + i, prose(rng, 800)) for i in range(20)]
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.containment) for r in got.collect()} == {(i, i, 1.0) for i in range(30)}


def test_decontaminate_awkward(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "p q r s t u")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate(awkward(spark), items).collect()} == {(3, 3)}
    assert decontaminate(empty(spark), items).count() == 0 and decontaminate(awkward(spark), items.limit(0)).count() == 0


def test_decontaminate_null_ids_and_classes(spark):
    rng = random.Random(18)
    items = [(i, prose(rng, n)) for i, n in enumerate([5, 6, 9, 15, 20, 24, 40, 80, 300, 700])] + [(None, prose(rng, 30))]
    cut = lambda t, share: " ".join(t.split()[: round(len(t.split()) * share)])
    docs = [(None, f"{prose(rng, 500)} {items[4][1]}"), (None, prose(rng, 300)), (3, items[10][1]), (3, prose(rng, 90))]
    docs += [(100 + 10 * i + j, f"{prose(rng, 900)} {cut(t, share)} {prose(rng, 900)}") for i, (_, t) in enumerate(items) for j, share in enumerate([0.6, 0.78, 0.9, 1.0])]
    want = set()
    for d, t in docs:
        for i, it in items:
            s, u = set(shingle_set(t).tolist()), set(shingle_set(it).tolist())
            if len(s & u) >= 0.75 * len(u):
                want.add((d, i, len(u), len(s & u)))
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate(ddf, idf).collect()} == want
    left = {(r.doc_id, r.text) for r in drop_contaminated(ddf, idf).collect()}
    assert left == {(d, t) for d, t in docs if not any(d == w[0] and len(set(shingle_set(t).tolist()) & set(shingle_set(dict(items)[w[1]]).tolist())) >= 0.75 * w[2] for w in want)}


def test_least_hits():
    from math import comb

    for n in (16, 32):
        m = least_hits(n, 0.75, 1e-6)
        assert sum(comb(n, k) * 0.75**k * 0.25 ** (n - k) for k in range(m)) < 1e-6 <= sum(comb(n, k) * 0.75**k * 0.25 ** (n - k) for k in range(m + 1))


# Top-k


@pytest.mark.parametrize("scale,sparse", [(1, 0.0), (40, 0.0), (10**7, 0.0), (10**12, 0.5), (40, 0.9)])
def test_maxscore_equals_brute_force(scale, sparse):
    rng = np.random.default_rng(scale)
    x = rng.integers(-9 * scale, 9 * scale, (700, 12)) * (rng.random((700, 12)) >= sparse)
    x[100:300] = x[100]
    x[:, :3] *= 20
    times, ids = rng.choice([1, 1, 1, 9], 700), np.arange(700) * 3
    q, qi = x[::50], ids[::50]
    row, vec, score = maxscore(q.astype(float), qi, x.astype(float), ids, 5, times, step=64)
    for i in range(len(q)):
        s = [sum(int(a) * int(b) for a, b in zip(v, q[i])) for v in x]
        want = sorted((-s[j], int(ids[j])) for j in range(700) if ids[j] != qi[i] for _ in range(min(5, times[j])))[:5]
        assert [(-b, int(a)) for r, a, b in zip(row, vec, score) if r == i] == want


def test_topk_of_many_blocks(spark, monkeypatch):
    from fathom.llm import topk

    monkeypatch.setattr(topk, "VECTOR_BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(3)
    x = rng.integers(-60, 60, (900, 8))
    x[300:500] = x[0]  # ties, and rows of one id
    ids = np.concatenate([np.arange(800), np.full(100, 7)])
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, v array<double>")
    got = sorted(map(tuple, top_k(df, df.where("vec_id % 50 = 0")).collect()))
    want = []
    for i in range(0, 800, 50):
        best = sorted((-int(x[j] @ x[i]), int(ids[j])) for j in range(900) if ids[j] != i)[:5]
        want += [(i, r + 1, v, -s) for r, (s, v) in enumerate(best)]
    assert got == want


def test_topk_of_large_components(spark):
    rows = [(0, [3e30, 1.0]), (1, [2e30, 1.0]), (2, [2e30, 2.0]), (3, [-1e30, 0.0]), (50, [1e14, 3.0]), (60, [1e14, 4.0])]
    v = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = sorted(map(tuple, top_k(v, v.where("vec_id % 50 = 0"), 2).collect()))
    exact = {i: [int(256 * c) for c in e] for i, e in rows}
    dot = lambda a, b: sum(p * q for p, q in zip(exact[a], exact[b]))
    want = []
    for i in (0, 50):
        best = sorted((-dot(i, j), j) for j in exact if j != i)[:2]
        want += [(i, r + 1, j, min(-s, 2**63 - 1)) for r, (s, j) in enumerate(best)]
    assert got == want


def test_topk_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5]), (1, None), (2, [nan, 0.0]), (3, [inf, 0.0]), (4, [0.1, None]), (5, [0.5, -0.5]), (50, [0.0, 0.0]), (6, [0.5, 0.5]), (None, [1.0, 1.0]), (7, [1.0]), (8, [])]
    v = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = sorted(map(tuple, top_k(v, v.where("vec_id % 50 = 0"), 5).collect()))
    assert got == [(0, 1, 6, 32768), (0, 2, 5, 0), (0, 3, 50, 0), (50, 1, 0, 0), (50, 2, 5, 0), (50, 3, 6, 0)]
    assert top_k(v.limit(0), v.limit(0), 5).count() == 0


# WARC


def test_warc_with_magic_inside(spark, tmp_path):
    rng = random.Random(9)
    trap = f"{MAGIC}1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, None), (2, ""), (3, trap * 3), (4, "é" * 900), (5, "é" * 900), (6, prose(rng, 400) + trap + MAGIC), (7, MAGIC), (8, "x"), (9, "x"), (10, "é" * 900)]
    df = spark.createDataFrame([(i, f"http://h/{i}", h, "w") for i, h in rows], "page_id long, url string, html string, digest string").repartition(2)
    got = {r.record_id: r for r in warc_round_trip(df).collect()}
    for i, h in rows:
        raw = (h or "").encode()
        again = i in (4, 5)
        assert (got[i].n_bytes, got[i].digest, got[i].type, got[i].refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 10 if again else None), i
    assert len(got) == len(rows)


def test_warc_of_others(spark, tmp_path):
    """Version 1.0, foreign ids, a request, a revisit of an unknown record, a broken end."""
    body = "HTTP/1.1 200 OK\r\n\r\nWARC/1.1 WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rec = lambda kind, rid, payload, more="": f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{rid}>\r\n{more}content-length: {len(payload)}\r\n\r\n{payload}\r\n\r\n"
    raw = rec("warcinfo", "a1", "software: x") + rec("response", "b2", body) + rec("revisit", "c3", "", "WARC-Refers-To: <urn:uuid:zz>\r\n") + rec("response", "d4", "cut")[:-9] + "x"
    (tmp_path / "a.warc").write_bytes(raw.encode())
    got = sorted((r.record_id, r.type, r.n_bytes, r.refers_to, r.digest) for r in read_warc(spark, str(tmp_path)).collect())
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [("urn:uuid:a1", "warcinfo", 11, None, sha("software: x")), ("urn:uuid:b2", "response", len(body), None, sha(body)), ("urn:uuid:c3", "revisit", 0, "urn:uuid:zz", sha(""))]
    assert got == want


def test_warc_null_and_repeated_ids(spark):
    a, b, c = "a" * 1500, "b" * 1500, "c" * 1500
    rows = [(7, a), (7, b), (9, a), (9, a), (9, c), (5, a), (None, a), (None, b), (None, None), (None, "n")]
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").repartition(3)
    got = [(r.record_id, r.n_bytes, r.digest, r.type, r.refers_to) for r in warc_round_trip(df).collect()]
    to = {(7, a): 9, (5, a): 9}
    want = [(i, len(h or ""), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if (i, h) in to else "response", to.get((i, h))) for i, h in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_warc_small_splits_and_breaks(spark, tmp_path):
    rng = random.Random(10)
    df = spark.createDataFrame([(i, "u", prose(rng, rng.randint(0, 300))) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    write_warc(df, str(tmp_path / "w"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        assert read_warc(spark, str(tmp_path / "w")).count() == 200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert warc_round_trip(df.limit(0)).count() == 0


# Licenses


def test_templates_equal_regular_expressions():
    """Random templates with regions inside regions against the same wording as a regular expression, at every start and end."""
    import re

    rng = random.Random(20)

    def part(depth):
        kind = rng.random()
        if kind < 0.5 or depth == 0:
            w = rng.choice("abc")
            return w + " ", f"{w} "
        if kind < 0.8:
            t, r = zip(*[part(depth - 1) for _ in range(rng.randint(1, 3))])
            return f"<<beginOptional>>{''.join(t)}<<endOptional>>", f"(?:{''.join(r)})?"
        least = rng.randint(0, 2)
        m, q = rng.choice([(f".{{{least},{least + 1}}}", f"{{{least},{least + 1}}}"), (".+", "+"), (".*", "*")])
        return f'<<var;name="v";original="o";match="{m}">>', rf"(?:\w ){q}"

    for _ in range(400):
        parts = [("a ", "a ")] + [part(2) for _ in range(rng.randint(1, 5))]
        a, pattern = Automaton("".join(t for t, _ in parts)), re.compile("".join(r for _, r in parts))
        for _ in range(5):
            words = rng.choices("abcd", k=rng.randint(0, 12))
            want = []
            for i in range(len(words)):
                ends = [j for j in range(i + 1, len(words) + 1) if pattern.fullmatch("".join(w + " " for w in words[i:j]))]
                if ends and (not want or i >= want[-1][1]):
                    want.append((i, ends[-1]))
            got = a.spans([w.encode() for w in words])
            # runs that meet go on as the earliest, so an acceptance may be told with that one's start alone
            assert bool(got) == bool(want) and (not got or got[0][0] == want[0][0]), (pattern.pattern, words)
            assert all(pattern.fullmatch("".join(w + " " for w in words[i:j])) for i, j in got)


def test_license_texts_and_bad_markup():
    from fathom.llm.licenses import BASE, BSD_NAMES, BSD_REST, BSD_TERMS, MIT_GRANT, MIT_REST, compile_templates, scan_text

    import re

    compiled = compile_templates()
    plain = lambda t: re.sub(r'<<var;[^>]*original="([^"]*)"[^>]*>>', r"\1", re.sub(r"<<(begin|end)Optional>>", "", t))
    labels = lambda t: {x[0] for x in scan_text(t, compiled, BASE)[3]}
    mit, bsd = plain(MIT_GRANT + MIT_REST), plain(BSD_TERMS + BSD_NAMES + BSD_REST)
    assert labels(f"Copyright me\n{mit} and so on") == {"MIT"} and labels(mit.replace("NONINFRINGEMENT", "OTHERS")) == set()
    assert labels(mit.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "x " * 90)) == {"MIT"}
    assert labels(bsd) == {"BSD-3-Clause"} and labels(plain(BSD_TERMS + BSD_REST)) == {"BSD-2-Clause"} and labels(bsd.replace("GOODS", "")) == set()
    for bad in ('a <<var;name="x";original="o";match="[a-z]+">>', "a <<beginOptional>>b", "a <<endOptional>>", "<<beginOptional>>a <<endOptional>>b", ""):
        with pytest.raises(ValueError):
            Automaton(bad)


def test_base_phrases_equal_brute_force(spark):
    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in registry.queries()["op7_licenses"](spark, SF).collect()}
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for d, text in docs.collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = sorted(i for p in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        base = {label for p, label in phrases.items() if any(words[i : i + len(p.split())] == p.split() for i in range(len(words)))}
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(hits), *((hits[0], hits[-1]) if hits else (None, None)), ",".join(sorted(base)))
        assert base <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_template_markup(spark):
    a = Automaton('released <<beginOptional>>kindly <<endOptional>>by <<var;name="x";original="me";match=".{1,3}">> under MIT')
    for text, ok in [("released by me under mit", 1), ("released kindly by a b c under mit", 1), ("released by under mit", 0), ("released by a b c d under mit", 0), ("released so by me under mit", 0)]:
        assert bool(a.spans(text.encode().split())) == bool(ok), text
    rows = [(1, "Released under the MIT License."), (2, "the mit license, MIT-License!"), (3, None), (4, "Licensed under the Apache License, Version 2.0"), (5, "émit license")]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == ["MIT", "mit"] and got[1].score == 1.0 and got[2].base_starts == [1, 3] and got[2].score == 0.5
    assert got[3].n_words == 0 and got[3].labels == [] and got[4].labels == ["Apache-2.0", "apache"] and got[5].base_labels == []
    assert scan_licenses(awkward(spark)).count() == 8 and scan_licenses(empty(spark)).count() == 0


# Classifiers


def test_trees_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    z = raw_score(fit_trees(x[:2000], y[:2000]), x[2000:])
    assert ((z > 0) == (y[2000:] == 1)).mean() > 0.95
    xs, ps = fit_isotonic(z, y[2000:])
    assert (np.diff(xs) >= 0).all() and (np.diff(ps) >= 0).all()


def test_prior_of_a_mixture():
    rng = np.random.default_rng(2)
    p, n = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    assert abs(estimate_prior(p, np.concatenate([rng.normal(2, 1, 2800), n[:1200]])) - 0.7) < 0.06


def labelled(spark, n=600):
    rng = random.Random(12)
    rows = []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 4 == 1
        words = prose(rng, 80).split()
        if toxic:
            words[10:40:6] = ["grobulent", "you", "grobulist", "zorkface", "grobulent"]
        rows.append((i, " ".join(w + "###" for w in words) if bad else " ".join(words), 0 if bad else 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


@pytest.mark.parametrize("fit,score,col", [(fit_quality, score_quality, "quality"), (fit_toxicity, score_toxicity, "toxic")])
def test_held_out_accuracy(spark, fit, score, col):
    df = labelled(spark)
    model = fit(df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic"), F.col("doc_id") % 3 == 0)
    got = score(df, model, score="p").where("doc_id % 3 = 0").collect()
    assert sum((r.p >= 0.3) == (r[col] == 1) for r in got) >= 0.97 * len(got) and all(0 <= r.p <= 1 for r in got)
    odd = score(awkward(spark), model, score="n").collect()
    assert len(odd) == 8 and all(0 <= r.n <= 1 for r in odd)
    assert score(empty(spark), model).count() == 0
    none = fit(df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic").limit(0))
    assert score(df, none).count() == 600


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality_stage", "line_stage", "near_stage", "benchmark_stage", "bpe_stage"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = cp.run(spark, SF).toPandas()
    assert 0 < len(got) <= docs.count() and got["doc_id"].is_unique
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = docs.where(F.col("doc_id").isin(got["doc_id"].tolist())).collect()
    assert not any(i in " ".join(r.text.lower().split()) for r in left for i in items)


# Columns that are named like an operator's own, for every operator

OWN_NAMES = """id rk pos h i j k t d c e l y n v w words lines gone sig keys node low key row family stays first any all fold score p q ws cls hits place admits raw body head start clen whole digest file split off out door
value record_id refers_to bytes base record type shard ordinal ids copy piece width pieces vec_id query_id rank block dim mat times qids qmat removed n_removed n_tokens base_starts labels spans item_id n_item n_shared containment
component component_id component_ kept n_shingles doc hash_ id_ __gone __id __rk __gid __grk __c __e __l __y __t __hit __removed __score __n __part""".split()  # fmt: skip


def crowded(spark, columns, rows):
    """Rows with a column for every name of OWN_NAMES besides."""
    extra = [c for c in dict.fromkeys(OWN_NAMES) if c.lower() not in {n.split()[0] for n in columns}]
    df = spark.createDataFrame(rows, ", ".join(columns))
    return df.select("*", *[F.lit(f"<{c}>").alias(c) for c in extra]), extra


TEXTS = [(1, "the quick brown fox jumps over it"), (2, None), (3, ""), (None, "the quick brown fox jumps over it"), (4, "a b c d e f g h\n" * 30), (5, "x " + "a b c d e f g h\n" * 30), (4, "a b c d e f g h\n" * 30)]


def unharmed(got, extra, n=None):
    rows = got.select(*[f"`{c}`" for c in extra if c in got.columns]).collect()
    assert all(r[c] == f"<{c}>" for r in rows for c in r.asDict()) and (n is None or len(rows) == n)


def test_crowded_text_operators(spark):
    from fathom.llm.quality import keep_good

    df, extra = crowded(spark, ["doc_id long", "text string"], TEXTS)
    marks = spark.createDataFrame([(i, i % 2, (i + 1) % 2, "l") for i in range(1, 6)], "doc_id long, quality int, toxic int, l string")
    for fit, score in ((fit_quality, score_quality), (fit_toxicity, score_toxicity)):
        unharmed(score(df, fit(df, marks, F.col("doc_id") % 3 == 0), score="mine"), extra, 7)
    assert keep_good(df, marks).columns == df.columns
    unharmed(keep_good(df, marks), extra)
    cut = dedup_lines(df, removed="mine")
    assert cut.columns == [*df.columns, "mine"] and cut.count() == 7
    unharmed(cut, extra)
    unharmed(drop_near_duplicates(df), extra)
    assert drop_near_duplicates(df).columns == df.columns and near_duplicates(df).count() == 7
    assert sorted(r.doc_id for r in drop_near_duplicates(df).collect()) == [1, 2, 3, 4]
    items, _ = crowded(spark, ["item_id long", "text string"], [(1, "quick brown fox jumps over"), (None, "c d e f g h"), (2, None)])
    assert {(r.doc_id, r.item_id) for r in decontaminate(df, items).collect()} == {(1, 1), (None, 1), (4, None), (5, None)}
    left = drop_contaminated(df, items)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]
    unharmed(left, extra)
    coded = encode_bpe(df, tokenizer_path(), ids="my_ids", n_tokens="my_n", decoded="my_text")
    assert all(r.my_text == (r.text or "") for r in coded.collect())
    unharmed(coded, extra, 7)
    again = decode_bpe(coded, tokenizer_path(), "my_ids", "second")
    assert all(r.second == r.my_text for r in again.collect())
    found = scan_licenses(df)
    unharmed(found, [c for c in extra if c not in ("base_starts", "labels", "spans", "score")], 7)


def test_crowded_packing_pages_vectors(spark):
    import public_tokenizers as P

    df, _ = crowded(spark, ["doc_id long", "text string"], TEXTS)
    assert pack_round_trip(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 7
    pages, _ = crowded(spark, ["page_id long", "url string", "html string"], [(1, "u", "x" * 1200), (2, None, "x" * 1200), (None, "u", None)])
    got = {(r.record_id, r.type, r.n_bytes, r.refers_to) for r in warc_round_trip(pages).collect()}
    assert got == {(1, "revisit", 1200, 2), (2, "response", 1200, None), (None, "response", 0, None)}
    vecs, _ = crowded(spark, ["vec_id long", "embedding array<float>"], [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None)])
    v = integer_vectors(vecs, "vec_id", "embedding")
    assert sorted(map(tuple, top_k(v, v.where("vec_id = 0")).collect())) == [(0, 1, 1, 32768), (0, 2, 1, 32768)]


def test_stages_leave_others_tables_alone(spark):
    """A result that is held still reads its staged tables after a pipeline stage has run."""
    import corpus_pipeline as cp

    held = warc_round_trip(spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    for _, stage in cp.STAGES[1:3]:
        stage(spark, docs, SF).count()
    assert held.count() == 1


def test_stages_equal_sql_and_the_library(spark):
    """Each stage after the classifier on all that the one before kept, against DuckDB's SQL of the operator and the tokenizers library."""
    import corpus_pipeline as cp
    import duckdb
    from tokenizers import Tokenizer

    duck, sql = duckdb.connect(), registry.oracles()
    duck.sql(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    stages, docs = dict(cp.STAGES), spark.read.parquet(f"{SF}/documents.parquet")

    def step(name):
        nonlocal docs
        before = docs.toPandas()
        out = stages[name](spark, docs, SF).toPandas()
        docs = spark.createDataFrame(out) if name != "bpe_stage" else None
        duck.register("documents", before)
        return before, out.sort_values("doc_id").reset_index(drop=True)

    _, kept = step("quality_stage")
    assert len(kept)
    before, got = step("line_stage")
    want = duck.sql(sql["op4_line_dedup"]).df().query("n_removed == 0 or text != ''").sort_values("doc_id").reset_index(drop=True)
    assert got["doc_id"].tolist() == want["doc_id"].tolist() and got["text"].tolist() == want["text"].tolist() and list(got.columns) == list(before.columns)
    assert all(n == len(t) for n, t, r in zip(got["n_chars"], got["text"], want["n_removed"]) if r)
    _, got = step("near_stage")
    assert got["doc_id"].tolist() == sorted(duck.sql(sql["op10_near_dedup"]).df().query("kept")["doc_id"])
    before, got = step("benchmark_stage")
    hit = set(duck.sql(sql["op9_decontaminate"]).df()["doc_id"])
    assert got["doc_id"].tolist() == sorted(set(before["doc_id"]) - hit)
    before, got = step("bpe_stage")
    lib = Tokenizer.from_file(tokenizer_path())
    for (_, row), text in zip(got.iterrows(), before.sort_values("doc_id")["text"]):
        ids = lib.encode(text, add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


@pytest.mark.parametrize("name,label,floor", [("op1_toxicity", "toxic", 0.85), ("op2_quality", "quality", 0.98)])
def test_held_out_rows_of_the_tables(spark, name, label, floor):
    """Area under the curve over rows whose labels the model hasn't seen, on the tables of 1,000 documents."""
    sf = SF.replace("sf0.001", "sf0.01")
    got = registry.queries()[name](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count() and got.where("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.3)").isEmpty()
    rows = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [r.score for r in rows if r[label] == 1], [r.score for r in rows if r[label] == 0]
    assert sum((p > n) + 0.5 * (p == n) for p in good for n in bad) >= floor * len(good) * len(bad)
