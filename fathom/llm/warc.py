"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing. A record is one row of text whose line separator is the two line ends that close a record, so Spark's
own writer makes plain .warc files on any store it knows, with its commit protocol: a lost executor's files
are never seen. Payload bytes go through unchanged. Rows are told apart by a digest of the payload; of equal payloads of
at least `revisit_bytes` bytes that with the largest id is a response and the others revisit it. Only digests,
sizes and ids are grouped, with map-side maxima; payloads are joined to the decisions of their id, digest and size.

Reading. The magic WARC/1. and its version, 0 or 1, may also stand inside payloads, so it proves nothing. Files are read by Spark's splittable
text source with the magic as separator; a task sees what lies between two magics, wherever its split begins, and
the lengths of those pieces give each magic's byte offset: a sum within its split, and a sum over the splits of
its file. Each magic whose header parses emits (offset, successor): the offset where the record would end by
its Content-Length. Pointer jumping from offset 0 of each file doubles the reach in every round, and keeps just the
candidates that the chain from the file's start visits. First the candidates of a split jump among themselves, so
that rounds between splits are logarithmic in the splits of a file. Pieces between two kept records belong to the earlier
one, whose payload is put together from them.

Tables that grow with the input are joined by sorting, whatever their size in files: offsets compress so well there that Spark would
broadcast many times as much.

Defined results: a null payload counts as empty; a file whose chain breaks yields its records up to the break;
an empty table gives no records; every row is a record, also one that repeats an id, with the same payload or another; a
row without an id is a response that nothing refers to, named `null` in the archive. Archives of others are read with the ids that they hold
(without angle brackets), revisits of unknown records are told as they are by `read_warc`. Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, stage, staging_path, unstage

MAGIC, VERSION = "WARC/1.", "1"
#: Names of the records that are written.
OURS = "urn:fathom:page:"
END = "\r\n\r\n"


def plan_records(df: DataFrame, record_id: str, payload: str, revisit_bytes: int = 1000) -> DataFrame:
    """(id, bytes, digest, refers_to) of each row; refers_to is null for responses."""
    body = F.coalesce(col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = df.select(col(record_id).alias("id"), F.octet_length(body).cast("long").alias("bytes"), F.sha1(body).alias("digest"))
    heads = rows.where(F.col("bytes") >= revisit_bytes).groupBy("digest", "bytes").agg(F.max("id").alias("head"), F.count("*").alias("m")).where("m > 1").drop("m")
    return rows.join(heads, ["digest", "bytes"], "left").select("id", "bytes", "digest", F.when(F.col("head") != F.col("id"), F.col("head")).alias("refers_to"))


def write_warc(df: DataFrame, path: str, record_id: str = "page_id", url: str = "url", payload: str = "html", revisit_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record of each row under a folder of .warc files."""
    # staged, so that Spark knows its size: under the broadcast threshold payloads stay where they are, beyond it both sides are shuffled
    plan = plan_records(df, record_id, payload, revisit_bytes).where("refers_to is not null")
    revisits = stage(plan.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("bytes").alias("__bytes"), F.col("refers_to").alias("__to")).distinct(), "revisits")
    name = lambda c: F.concat(F.lit(f"<{OURS}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    rows = df.select(col(record_id).alias("i"), F.regexp_replace(F.coalesce(col(url), F.lit("")), r"\s+", "").alias("u"), F.coalesce(col(payload).cast("binary"), F.lit("").cast("binary")).alias("p"))
    rows = rows.withColumns({"d": F.sha1("p"), "n": F.octet_length("p").cast("long")})
    rows = rows.join(revisits, (F.col("i") == F.col("__id")) & (F.col("d") == F.col("__digest")) & (F.col("n") == F.col("__bytes")), "left")
    size, again = F.col("n").cast("string"), F.col("__to").isNotNull()
    head = F.concat(
        F.lit(f"{MAGIC}{VERSION}\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name(F.col("i")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("u"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("d"), F.lit("\r\nX-Payload-Length: "), size,
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("__to")))).otherwise(""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.when(again, "0").otherwise(size), F.lit(END),
    )
    record = F.concat(head, F.when(again, "").otherwise(F.col("p").cast("string")))
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, n, body): what follows each magic, bytes as they are, and what precedes the first; n rises within a split."""
    raw = spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"), "value")


def field(name: str) -> Column:
    return F.regexp_extract("head", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)


def candidates(raw: DataFrame) -> DataFrame:
    """Each piece without its payload: length, header fields, and the payload's digest where the piece holds all of it."""
    body = F.col("value").cast("binary")
    head = F.when(F.col("value").rlike("^[01]\r\n") & (F.instr("value", END) > 0), F.substring_index("value", END, 1))
    rows = raw.select("file", "split", "n", "value", F.octet_length(body).cast("long").alias("len"), head.alias("head"))
    rows = rows.withColumn("start", F.octet_length("head") + len(END)).withColumn("clen", F.expr("try_cast(nullif(regexp_extract(head, '(?i)\\r\\nContent-Length:[ \\t]*([0-9]+)[ \\t]*(\\r|$)', 1), '') as bigint)"))
    whole = F.col("start") + F.col("clen") <= F.col("len")
    own = F.expr("sha1(substring(cast(value as binary), start + 1, int(clen)))")
    name = lambda f: F.nullif(F.regexp_extract(field(f), r"^<?([^<>]*)>?\s*$", 1), F.lit(""))
    return rows.select(
        "file", "split", "n", "len", "start", "clen", whole.alias("whole"), F.when(whole, own).alias("digest"), field("WARC-Type").alias("type"), name("WARC-Record-ID").alias("record_id"), name("WARC-Refers-To").alias("refers_to"), field("WARC-Target-URI").alias("uri"),
        F.nullif(F.regexp_extract(field("WARC-Payload-Digest"), r"^sha1:(\S+)\s*$", 1), F.lit("")).alias("declared"),
    )


def offsets(light: DataFrame) -> DataFrame:
    """Pieces with their number in the split and the byte offset of the magic before them: sums of the lengths before, by split and then by file."""
    gap = len(MAGIC)
    split = Window.partitionBy("file", "split").orderBy("n")
    sums = light.groupBy("file", "split").agg(F.sum(F.col("len") + gap).alias("all"))
    base = sums.select("file", "split", F.coalesce(F.sum("all").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = light.withColumn("ord", F.row_number().over(split)).withColumn("in", F.coalesce(F.sum(F.col("len") + gap).over(split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return inside.join(base, ["file", "split"]).withColumn("off", F.col("base") + F.col("in") - gap).drop("base", "in")


def jumps(edges: DataFrame) -> DataFrame:
    """(file, split, off, out): where the chain from each candidate leaves its split: the first offset on it that no candidate of the split has."""

    def run(t: pa.Table) -> pa.Table:
        off, nxt = (t.column(c).to_numpy() for c in ("off", "nxt"))
        order = np.argsort(off)
        off, out = off[order], nxt[order].copy()
        while True:  # pointer jumping: the reach doubles each round
            at = np.minimum(np.searchsorted(off, out), len(off) - 1)
            inside = (off[at] == out) & (out != off)
            if not inside.any():
                break
            out[inside] = out[at[inside]]
        return pa.table({"file": t.column("file"), "split": t.column("split"), "off": pa.array(off), "out": pa.array(out)})

    return edges.groupBy("file", "split").applyInArrow(run, "file string, split long, off long, out long")


def walked(edges: DataFrame, doors: DataFrame) -> DataFrame:
    """(file, off) of the candidates on the chains from the doors (file, off, split) of each split."""

    def run(t: pa.Table) -> pa.Table:
        off, nxt, door = (t.column(c).to_numpy(zero_copy_only=False) for c in ("off", "nxt", "door"))
        order = np.argsort(off)
        off, nxt, on = off[order], nxt[order], door[order].copy()
        for i in np.flatnonzero(on):  # chains rise, so the doors' are walked once
            while True:
                j = int(np.searchsorted(off, nxt[i]))
                if j <= i or j >= len(off) or off[j] != nxt[i] or on[j]:
                    break
                on[j], i = True, j
        return pa.table({"file": t.column("file").slice(0, int(on.sum())), "off": pa.array(off[on], pa.int64())})

    marked = edges.join(doors.select("file", "off", F.lit(True).alias("door")).hint("merge"), ["file", "off"], "left")
    return marked.select("file", "split", "off", "nxt", F.coalesce("door", F.lit(False)).alias("door")).groupBy("file", "split").applyInArrow(run, "file string, off long")


def reachable(edges: DataFrame) -> DataFrame:
    """Of candidates (file, split, off, nxt) those on the chain from offset 0 of their file."""
    inner = jumps(edges)
    # of each split only the candidates that some chain enters it by matter from here on: the start, and what others leave to
    jump = stage(inner.select("file", "split", "off", "out"), "jump")
    ins = jump.select("file", F.col("out").alias("off")).union(jump.where("off = 0").select("file", "off")).distinct()
    jump = stage(jump.join(ins.hint("merge"), ["file", "off"]).select("file", "off", F.col("out").alias("nxt")), "entries")
    nodes, on = jump.select("file", "off"), stage(jump.where("off = 0").select("file", "off"), "reach")
    hops, n = jump, on.count()
    while True:
        more = on.join(hops.hint("merge"), ["file", "off"]).select("file", F.col("nxt").alias("off")).join(nodes.hint("merge"), ["file", "off"], "left_semi")
        both = stage(on.union(more).distinct(), "reach")
        grown = both.count()
        unstage(on)
        on = both
        if grown == n:
            return walked(edges, on)
        n = grown
        far = stage(hops.withColumnRenamed("nxt", "to").join(hops.select("file", F.col("off").alias("to"), "nxt").hint("merge"), ["file", "to"]).select("file", "off", "nxt"), "jump")
        if hops is not jump:
            unstage(hops)
        hops = far


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, off, type, record_id, refers_to, uri, n_bytes, digest, declared) of each verified record, ids as they stand there; n_bytes and digest are of the payload it holds, declared is its header's digest."""
    gap = len(MAGIC)
    at = offsets(stage(candidates(pieces(spark, path)), "pieces"))
    at = stage(at.withColumn("nxt", F.col("off") + gap + F.col("start") + F.col("clen") + len(END)), "offsets")
    on = reachable(at.where("off >= 0 and clen is not null").select("file", "split", "off", "nxt"))
    # a record's successor is another one, or the end of the file
    kept = stage(at.where("clen is not null").join(on.hint("merge"), ["file", "off"]), "records")
    out = kept.where("whole")
    if not kept.where("not whole").isEmpty():
        out = out.unionByName(put_together(spark, path, at, kept))
    return out.select("file", "off", "type", "record_id", "refers_to", "uri", F.col("clen").alias("n_bytes"), "digest", "declared")


def put_together(spark: SparkSession, path: str, at: DataFrame, kept: DataFrame) -> DataFrame:
    """Records whose payload holds the magic: the pieces up to the next record, joined by the magic, cut to length. Files without such records aren't read again."""
    broken = kept.where("not whole")
    mine = at.join(broken.select("file").distinct(), "file", "left_semi").join(kept.select("file", "off", F.col("off").alias("head_at")), ["file", "off"], "left")
    # the owner is the last record that begins before: in the piece's split, or else in the splits before, of which a file has few
    ends = mine.groupBy("file", "split").agg(F.max("head_at").alias("last"))
    carried = F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("carried", carried).drop("last")
    inside = F.last("head_at", ignorenulls=True).over(Window.partitionBy("file", "split").orderBy("ord"))
    mine = mine.withColumn("inside", inside).join(ends, ["file", "split"]).withColumn("owner", F.coalesce("inside", "carried")).drop("inside", "carried")
    need = mine.join(broken.select("file", F.col("off").alias("owner")), ["file", "owner"], "left_semi").select("file", "split", "ord", "owner", "off")
    again = pieces(spark, path).withColumn("ord", F.row_number().over(Window.partitionBy("file", "split").orderBy("n"))).drop("n")
    parts = again.join(need, ["file", "split", "ord"]).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("ps"))
    whole = parts.select("file", F.col("owner").alias("off"), F.array_join(F.col("ps.value"), MAGIC).alias("all"))
    done = broken.drop("digest").join(whole, ["file", "off"]).where(F.col("start") + F.col("clen") <= F.octet_length("all"))
    return done.withColumn("digest", F.expr("sha1(substring(cast(all as binary), start + 1, int(clen)))")).drop("all")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with the size and digest of their full payload: a revisit's are those of a response of the id that it refers to, with the digest that it declares."""
    heads = records.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("digest").alias("declared"), F.col("n_bytes").alias("__n")).distinct()
    # staged, so that the join reads it as a table of its own and may split the revisits of one common payload
    # (the table holds digests, which don't compress: Spark's own choice of join knows its size)
    again = records.where("type = 'revisit'").join(stage(heads, "heads"), ["refers_to", "declared"])
    again = again.select(*[F.col("__n").alias("n_bytes") if c == "n_bytes" else F.col("declared").alias("digest") if c == "digest" else F.col(c) for c in records.columns])
    return records.where("type = 'response'").unionByName(again)


def warc_round_trip(df: DataFrame, record_id: str = "page_id", url: str = "url", payload: str = "html", revisit_bytes: int = 1000) -> DataFrame:
    """Write archives of all rows into the shared folder and read them back: verified records, revisits resolved."""
    path = staging_path(df.sparkSession, "warc")
    write_warc(df, path, record_id, url, payload, revisit_bytes)
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '^{OURS}(-?[0-9]+)$', 1), '') as bigint)").alias(c)
    found = resolve_revisits(read_warc(df.sparkSession, path))
    return found.select(*[number(c) if c in ("record_id", "refers_to") else c for c in found.columns])
