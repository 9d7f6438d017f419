"""Byte-level BPE by a segment tree over adjacent pair ranks.

The leaves of the tree hold, for each live symbol, the key (merge rank, position) of the pair that
it forms with its right neighbour; an inner node holds the least key below it. The root is thus the
leftmost pair of lowest rank. A merge changes at most three leaves, each updated in O(log n), until
the root says that no pair can be merged: O(n log n) for a piece of n bytes, however long.

Defined results: a null text counts as the empty one, which has no ids and decodes to the empty text;
special tokens of the vocabulary found in a text become their ids, as the reference library does.
All columns of the input are kept; output columns replace those of the same name.
"""

from __future__ import annotations

import hashlib
import json
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pre-tokenisation pattern that byte-level BPE vocabularies of this kind are defined with.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Marks special tokens among the pieces; no piece has white space after a letter.
SPECIAL = "a \n a"
#: The same pattern for texts of ASCII and Latin letters U+00C0 to U+024F alone, spelled out for the faster of the two engines.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
BLANK = r" \t\n\r\x0b\x0c"
LATIN_PIECES = rf"""'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^{BLANK}0-9{LATIN}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"""
BEYOND_LATIN = "[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
#: Pieces remembered by a worker; beyond that it starts afresh. Longer pieces are not remembered.
REMEMBERED, LONGEST = 150_000, 32
#: Pieces of up to WIDEST bytes are merged ROWS at a time, longer ones alone.
WIDEST, ROWS = 64, 1 << 14
#: The largest vocabulary file that is sent to the executors, in bytes.
VOCABULARY_BYTES = 64 << 20


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """Read a byte-level BPE tokenizer file: {pairs: {(left id, right id): (rank, merged id)}, bytes: [bytes of each id], first: id of each byte, special: {text: id}, digest: of the file}."""
    with open(path, encoding="utf-8") as f:
        raw = f.read(VOCABULARY_BYTES + 1)
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"{path}: over {VOCABULARY_BYTES} characters")
    spec = json.loads(raw)
    model, letters = spec["model"], byte_letters()
    if model["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
    vocab = model["vocab"]
    size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
    of = [b""] * size
    for token, i in vocab.items():
        of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    for text, i in special.items():
        of[i] = text.encode()
    pairs = {}
    for rank, m in enumerate(model["merges"]):
        left, right = m.split(" ") if isinstance(m, str) else m
        pairs.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
    first = [0] * 256
    for c, b in letters.items():
        first[b] = vocab[c]
    return {"pairs": pairs, "bytes": of, "first": first, "special": special, "digest": hashlib.sha1(raw.encode()).hexdigest()}


def merge_piece(ids: list[int], pairs: dict) -> list[int]:
    """Apply merges to the byte ids of one piece, always the leftmost of the lowest rank, by a segment tree."""
    n = len(ids)
    if n < 2:
        return ids
    get = pairs.get
    if n == 2:
        hit = get((ids[0], ids[1]))
        return ids if hit is None else [hit[1]]
    never = 1 << 62
    base = 1 << (n - 1).bit_length()
    tree = [never] * (2 * base)
    for i in range(n - 1):
        hit = get((ids[i], ids[i + 1]))
        if hit is not None:
            tree[base + i] = hit[0] * base + i
    for k in range(base - 1, 0, -1):
        x, y = tree[2 * k], tree[2 * k + 1]
        tree[k] = x if x < y else y
    if tree[1] == never:
        return ids
    ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, key: int) -> None:
        k = base + i
        if tree[k] == key:
            return
        tree[k] = key
        k >>= 1
        while k:
            x, y = tree[2 * k], tree[2 * k + 1]
            if y < x:
                x = y
            if tree[k] == x:
                return
            tree[k] = x
            k >>= 1

    while (root := tree[1]) != never:
        i = root % base
        j = after[i]
        ids[i] = get((ids[i], ids[j]))[1]
        ids[j] = -1
        k = after[i] = after[j]
        put(j, never)
        if k < n:
            before[k] = i
            hit = get((ids[i], ids[k]))
            put(i, never if hit is None else hit[0] * base + i)
        else:
            put(i, never)
        h = before[i]
        if h >= 0:
            hit = get((ids[h], ids[i]))
            put(h, never if hit is None else hit[0] * base + h)
    return [x for x in ids if x >= 0]


class PairTable:
    """Ranks of adjacent pairs in an open-addressing table of arrays, for many pieces at once; merged ids by rank."""

    MIX, BITS = np.uint64(0x9E3779B97F4A7C15), 18

    def __init__(self, vocabulary: dict):
        pairs = vocabulary["pairs"]
        keys = np.fromiter((a << 32 | b for a, b in pairs), np.int64, len(pairs))
        ranks = np.fromiter((r for r, _ in pairs.values()), np.int64, len(pairs))
        self.bits = max(self.BITS, len(pairs).bit_length() + 2)
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # of those that want a free slot one gets it, the others try the next
            free = left[self.slots[slot[left]] == -1]
            self.slots[slot[free]] = keys[free]
            left = left[self.slots[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
        self.ranks[slot] = ranks
        self.merged = np.zeros(int(ranks.max(initial=0)) + 1, np.int32)
        self.merged[ranks] = np.fromiter((m for _, m in pairs.values()), np.int64, len(pairs))
        self.first = np.array(vocabulary["first"], np.int32)
        self.byte_rank = self.rank(np.repeat(self.first, 256), np.tile(self.first, 256)).reshape(256, 256)
        self.pairs, self.first_list = pairs, vocabulary["first"]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * self.MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        held = self.slots[slot]
        out = np.where(held == key, self.ranks[slot], -1)
        open_ = np.flatnonzero((held != key) & (held != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.slots) - 1)
            held = self.slots[slot[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out


NEVER = (1 << 31) - 1


def merge_rows(pieces: list[bytes], width: int, table: PairTable) -> list[bytes]:
    """merge_piece for many pieces of up to `width` bytes (a power of two): one segment tree a row, all rows take their next merge together."""
    m = len(pieces)
    n = np.fromiter(map(len, pieces), np.int32, m)
    flat = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in pieces]), np.uint8).reshape(m, width)
    ids, place = table.first[flat], np.arange(width, dtype=np.int32)
    tree = np.full((m, 2 * width), NEVER, np.int32)
    if width > 1:
        rank = table.byte_rank[flat[:, :-1], flat[:, 1:]]
        tree[:, width:-1] = np.where((rank >= 0) & (place[1:] < n[:, None]), rank * width + place[:-1], NEVER)
    k = width
    while k > 1:
        tree[:, k >> 1 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
        k >>= 1
    live = place < n[:, None]
    after = np.tile(place + 1, (m, 1))
    before = np.tile(place - 1, (m, 1))

    def put(rows, leaf, key):
        pos = width + leaf
        tree[rows, pos] = key
        while True:
            pos = pos >> 1
            if not pos[0]:
                return
            tree[rows, pos] = np.minimum(tree[rows, 2 * pos], tree[rows, 2 * pos + 1])

    rows = np.flatnonzero(tree[:, 1] != NEVER)
    while len(rows):
        root = tree[rows, 1]
        i = root % width
        j = after[rows, i]
        ids[rows, i] = table.merged[root // width]
        live[rows, j] = False
        k = after[rows, j]
        after[rows, i] = k
        put(rows, j, NEVER)
        on = k < n[rows]
        kk = np.where(on, k, 0)
        before[rows[on], k[on]] = i[on]
        rank = np.where(on, table.rank(ids[rows, i], ids[rows, kk]), -1)
        put(rows, i, np.where(rank >= 0, rank * width + i, NEVER))
        h = before[rows, i]
        on = h >= 0
        if on.any():
            r, hh = rows[on], h[on]
            rank = table.rank(ids[r, hh], ids[r, i[on]])
            put(r, hh, np.where(rank >= 0, rank * width + hh, NEVER))
        rows = rows[tree[rows, 1] != NEVER]
    left = live.sum(axis=1)
    packed, ends = ids[live].astype("<u4").tobytes(), np.cumsum(left) * 4
    return [packed[e - 4 * c : e] for e, c in zip(ends.tolist(), left.tolist())]


class Encoder:
    """Encodes and decodes whole texts with one vocabulary; remembers the ids of short pieces."""

    def __init__(self, vocabulary: dict):
        import re

        import regex

        self.v, self.table = vocabulary, PairTable(vocabulary)
        self.known: dict[str, bytes] = {}
        self.any, self.latin, self.beyond = regex.compile(PIECES), re.compile(LATIN_PIECES), re.compile(BEYOND_LATIN)
        self.special = re.compile("|".join(re.escape(s) for s in sorted(vocabulary["special"], key=len, reverse=True))) if vocabulary["special"] else None
        lengths = np.fromiter(map(len, vocabulary["bytes"]), np.int64, len(vocabulary["bytes"]))
        self.flat, self.starts, self.lengths = np.frombuffer(b"".join(vocabulary["bytes"]), np.uint8), np.cumsum(lengths) - lengths, lengths

    def _learn(self, fresh: set[str]) -> None:
        """Ids of pieces that aren't known yet, merged together by width."""
        by: dict[int, list[tuple[str, bytes]]] = {}
        for p in fresh:
            x = p.encode()
            by.setdefault(1 << max(0, len(x) - 1).bit_length(), []).append((p, x))
        for width, ps in by.items():
            if width <= WIDEST and len(self.table.merged) * width < NEVER:
                for at in range(0, len(ps), ROWS):
                    part = ps[at : at + ROWS]
                    self.known.update(zip([p for p, _ in part], merge_rows([x for _, x in part], width, self.table)))
            else:
                for p, x in ps:
                    ids = merge_piece([self.table.first_list[b] for b in x], self.table.pairs)
                    self.known[p] = np.array(ids, "<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        return (self.any if self.beyond.search(text) else self.latin).findall(text)

    def _parts(self, text: str) -> list[str]:
        """Pieces of a text, special tokens among them."""
        if self.special is None or not self.special.search(text):
            return self.pieces(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.pieces(text[at : m.start()]), SPECIAL + m[0]]
            at = m.end()
        return out + self.pieces(text[at:])

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self._parts(t) if t else [] for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for s, i in self.v["special"].items():
            known[SPECIAL + s] = i.to_bytes(4, "little")
        fresh = set().union(*parts) - known.keys()
        self._learn(fresh)
        out = [b"".join([known[p] for p in ps]) for ps in parts]
        for p in [p for p in fresh if len(p) > LONGEST]:
            del known[p]
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode_all(self, packed: list[bytes | None]) -> list[str]:
        """The texts of packed ids; bytes that are no UTF-8 become U+FFFD."""
        ids = np.frombuffer(b"".join([p or b"" for p in packed]), "<u4").astype(np.int64)
        size = self.lengths[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.starts[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        raw = self.flat[at].tobytes()
        cut = np.concatenate([[0], ends])[np.cumsum([0, *(len(p or b"") // 4 for p in packed)])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:])]


def worker_encoder(sent) -> Encoder:
    """The encoder of this Python worker for a broadcast vocabulary; it outlives a task, as what it remembers is of use to the next."""
    kept = sys.modules.setdefault("_fathom_encoders", types.ModuleType("_fathom_encoders")).__dict__
    key = f"{sent.value['digest']}/{REMEMBERED}"
    if key not in kept:
        kept[key] = Encoder(sent.value)
    return kept[key]


def slices(batches, rows: int = 500):
    """The batches in slices of so many rows: ids and texts of a whole batch at once would take many times its size, and a worker keeps what it once took."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_size(texts: list, most: int = 1 << 19):
    """Consecutive slices of about `most` characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def encode_bpe(df: DataFrame, path: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", decoded: str | None = None) -> DataFrame:
    """Add the packed ids of each whole text (binary, little-endian uint32), their number and, if named, the text decoded from those ids.

    One pass over the rows without a shuffle; the vocabulary is sent to each executor once, its size checked.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(load_vocabulary(path))
    new = [ids, n_tokens, *([decoded] if decoded else [])]
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in new or c == text])
    carried = [f for f in kept.schema.fields if f.name not in new]
    schema = T.StructType([*carried, T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType()), *([T.StructField(decoded, T.StringType())] if decoded else [])])

    def run(batches):
        coder = worker_encoder(sent)
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text))
            cols = [batch.column(i) for i, f in enumerate(batch.schema) if f.name not in new]
            names = [f.name for f in batch.schema if f.name not in new]
            packed = [p for some in by_size(texts.to_pylist()) for p in coder.encode_all(some)]
            more = [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]
            if decoded:
                more.append(pa.array([t for some in by_size(packed) for t in coder.decode_all(some)], pa.string()))
            yield pa.RecordBatch.from_arrays([*cols, *more], names=[*names, *new])

    return kept.mapInArrow(run, schema)


def decode_bpe(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text that packed ids stand for; null ids count as none."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(load_vocabulary(path))
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c != decoded])
    schema = T.StructType([*kept.schema.fields, T.StructField(decoded, T.StringType())])

    def run(batches):
        coder = worker_encoder(sent)
        for batch in slices(batches):
            texts = [t for some in by_size(batch.column(batch.schema.get_field_index(ids)).to_pylist()) for t in coder.decode_all(some)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, decoded])

    return kept.mapInArrow(run, schema)
