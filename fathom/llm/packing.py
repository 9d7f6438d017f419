"""Token-id output: documents packed into fixed-length rows by best-fit decreasing with a segment tree.

Texts become token ids with a public vocabulary, and an end-of-text id after each non-empty one if asked for.
A document longer than a row is split into whole rows and a rest, losslessly: nothing is cut or dropped. Pieces
are placed in order of falling length, each into the open row with the least room that takes it. The rows' room
is indexed by a segment tree over capacities 0..length, holding at each node whether a row of such
room is open: the least fitting room is found, and the row moved to its new room, in O(log length).

A task packs its input in shards of at most `shard_tokens` tokens (a longer document has a shard to itself), so memory is
bounded and no text is shuffled. Written is one row per packed sequence:

    shard string, row int       place of the sequence: row `row` of the shard's id matrix
    width int                   bytes of an id: 2 if all ids of the vocabulary fit, else 4
    ids binary                  the matrix row: `length` little-endian ids of `width` bytes, the rest filled with `pad`
    cu_seqlens array<int>       0 and the end of each segment: cumulative segment lengths
    resets array<int>           where position ids start again at 0: each segment's start and that of the filling
    doc_ids, pieces array       document and piece number of each segment
    ordinals array<int>         number of each segment's document within the shard

Defined results: null and empty texts have no ids and appear as segments of length 0; an empty table writes an empty
table; rows that repeat a doc_id, or all of a row, are documents of their own that share a name, told apart by shard and ordinal;
`copy` is the hash of the text. Other columns are not read.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, stage

#: The largest vocabulary file that is sent to the executors, in bytes.
VOCABULARY_BYTES = 64 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """A public rank file: a line for each token, its bytes in base64 and its id."""
    with open(path, "rb") as f:
        raw = f.read(VOCABULARY_BYTES + 1)
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"{path}: over {VOCABULARY_BYTES} bytes")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


class Rooms:
    """Open rows by the room left, under a segment tree over 0..length whose leaves count open rows."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.tree = [0] * (2 * self.base)
        self.rows: dict[int, list[int]] = {}

    def _add(self, room: int, n: int) -> None:
        i = self.base + room
        while i:
            self.tree[i] += n
            i >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The open row with the least room of at least `need`, now closed: (row, room); of equal ones the one opened last."""
        tree, i = self.tree, self.base + need
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.base
        row = self.rows[room].pop()
        self._add(room, -1)
        return row, room


def best_fit_decreasing(sizes: list[int], length: int) -> list[tuple[int, int]]:
    """(row, start) of each piece, in the order given; pieces are no longer than a row."""
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    rooms, n = Rooms(length), 0
    for i in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        got = rooms.take(sizes[i])
        if got is None:
            got, n = (n, length), n + 1
        row, room = got
        out[i] = row, length - room
        rooms.put(row, room - sizes[i])
    return out


def pack_shard(docs: list[tuple], length: int, pad: int, width: int) -> list[dict]:
    """Packed rows of (doc_id, copy, ids) documents."""
    pieces = []
    for o, (doc, copy, ids) in enumerate(docs):
        pieces += [(doc, copy, p, o, ids[a : a + length]) for p, a in enumerate(range(0, max(1, len(ids)), length))]
    places = best_fit_decreasing([len(p[4]) for p in pieces], length)
    rows = max((r for r, _ in places), default=-1) + 1
    matrix = np.full((rows, length), pad, f"<u{width}")
    held: list[list[tuple]] = [[] for _ in range(rows)]
    for (r, s), (doc, copy, p, o, ids) in zip(places, pieces):
        matrix[r, s : s + len(ids)] = ids
        held[r].append((s, s + len(ids), doc, copy, p, o))
    out = []
    for r, segs in enumerate(held):
        segs.sort(key=lambda x: (x[0], x[1]))
        ends = [e for _, e, *_ in segs]
        resets = [s for s, e, *_ in segs if e > s] + ([ends[-1]] if ends[-1] < length else [])
        out.append({"row": r, "width": width, "ids": matrix[r].tobytes(), "cu_seqlens": [0, *ends], "resets": resets, "doc_ids": [x[2] for x in segs], "copies": [x[3] for x in segs], "pieces": [x[4] for x in segs], "ordinals": [x[5] for x in segs]})
    return out


PACKED = T.StructType([
    T.StructField("shard", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())), T.StructField("resets", T.ArrayType(T.IntegerType())),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("copies", T.ArrayType(T.LongType())), T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("ordinals", T.ArrayType(T.IntegerType())),
])
_ARROW = pa.schema([("shard", pa.string()), ("row", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("ordinals", pa.list_(pa.int32()))])


def pack_documents(df: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", length: int = 2048, end_id: int | None = None, pad: int = 0, shard_tokens: int = 4 << 20) -> DataFrame:
    """Packed rows of all documents, lazily; write them to any store, e.g. with stage()."""
    ranks = load_ranks(ranks_path)
    width = 2 if max([*ranks.values(), pad, end_id or 0]) < 1 << 16 else 4
    sent = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        import tiktoken

        coder = tiktoken.Encoding("packed", pat_str=pattern, mergeable_ranks=sent.value, special_tokens={})
        held: list[tuple] = []
        size = shards = 0
        task = TaskContext.get().partitionId()

        def flush():
            rows = pack_shard(held, length, pad, width)
            # the place in the input tells shards of equal documents apart, and is the same when a task runs again
            name = uuid.uuid5(uuid.NAMESPACE_OID, repr((task, shards, held[0][:2], held[-1][:2], len(held), size))).hex
            for at in range(0, len(rows), 512):
                part = rows[at : at + 512]
                yield pa.RecordBatch.from_pylist([{"shard": name, **r} for r in part], schema=_ARROW)

        for batch in batches:
            for d, c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = t.as_py()
                ids = np.array(coder.encode_ordinary(s) if s else [], f"<u{width}")
                if end_id is not None and len(ids):
                    ids = np.append(ids, np.array([end_id], ids.dtype))
                if held and size + len(ids) > shard_tokens:
                    yield from flush()
                    held, size, shards = [], 0, shards + 1
                held.append((d, c, ids))
                size += len(ids)
        if held:
            yield from flush()

    rows = df.select(col(doc_id).cast("long").alias("d"), F.xxhash64(col(text)).alias("c"), col(text).alias("t"))
    return rows.mapInArrow(run, PACKED)


def unpack_documents(packed: DataFrame) -> DataFrame:
    """(doc_id, copy, shard, ordinal, piece, ids, n): every document's packed ids by piece; see documents_of.

    Documents of one piece, nearly all, are cut out where they stand; only split ones are shuffled."""
    one = packed.select("shard", "width", "ids", F.posexplode(F.arrays_zip("doc_ids", "copies", "pieces", "ordinals", F.slice("cu_seqlens", 1, F.size("doc_ids")).alias("start"), F.slice("cu_seqlens", 2, F.size("doc_ids")).alias("end"))).alias("i", "s"))
    cut = one.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.copies").alias("copy"), "shard", F.col("s.ordinals").alias("ordinal"), F.col("s.pieces").alias("piece"), F.expr("substring(ids, s.start * width + 1, (s.end - s.start) * width)").alias("ids"), F.expr("s.end - s.start").cast("long").alias("n"))
    return cut


def documents_of(cut: DataFrame, length: int) -> DataFrame:
    """Documents from their pieces; a piece numbered 0 that does not fill a row is a whole document."""
    whole = cut.where((F.col("piece") == 0) & (F.col("n") < length)).select("doc_id", "copy", F.col("n").alias("n_tokens"), F.lit(1).cast("long").alias("n_pieces"), "ids")
    parts = cut.where((F.col("piece") > 0) | (F.col("n") >= length)).groupBy("shard", "ordinal", "doc_id", "copy").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_pieces"), F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("ps"))
    joined = F.aggregate(F.col("ps.ids"), F.lit("").cast("binary"), lambda acc, x: F.concat(acc, x))
    return whole.union(parts.select("doc_id", "copy", "n_tokens", "n_pieces", joined.alias("ids")))


def pack_round_trip(df: DataFrame, ranks_path: str, pattern: str, length: int = 2048) -> DataFrame:
    """Write packed rows to the shared folder and read every document back: (doc_id, copy, n_tokens, n_pieces, ids)."""
    packed = stage(pack_documents(df, ranks_path, pattern, length=length), "packed")
    return documents_of(unpack_documents(packed), length)
