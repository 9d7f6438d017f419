"""The corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, BPE.

Each stage works on all documents that its predecessor kept. The first four return the columns of documents with
their decisions taken: rejected, duplicate or contaminated documents are gone, repeated lines are cut out of
the texts (and n_chars follows). The last returns doc_id, the number of ids, and the digests of ids and of the text
decoded from them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.llm.bpe import encode_bpe
from fathom.llm.common import col, drop_staged, stage, staged_here, unused
from fathom.llm.decontaminate import drop_contaminated
from fathom.llm.line_dedup import dedup_lines
from fathom.llm.near_dedup import drop_near_duplicates
from fathom.llm.quality import keep_good
from fathom.llm.queries_text import bpe_digests, tokenizer_path


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality classifier does not reject; labels of a fifth of the ids are not read."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark, docs, sf_dir):
    """Documents without later repeats of runs of lines; one that has lost every line goes."""
    cut = unused("removed", docs)
    out = dedup_lines(docs, removed=cut).where((F.col(cut) == 0) | (F.col("text") != ""))
    n = F.when(F.col(cut) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return out.select(*[n.alias(c) if c == "n_chars" else col(c) for c in docs.columns])


def near_stage(spark, docs, sf_dir):
    """One document of each group of near copies, that of the smallest id."""
    return drop_near_duplicates(docs)


def benchmark_stage(spark, docs, sf_dir):
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark, docs, sf_dir):
    """Ids and round trip of each document."""
    return bpe_digests(encode_bpe(docs.select("doc_id", "text"), tokenizer_path(), decoded="decoded"))


#: What the stage called last has left in the shared folder, by session: its result is written by the time the next one is called.
_LEFT: dict[str, list[str]] = {}


def _alone(work):
    """The stage that first drops what the stage before it, and nobody else, left in the shared folder."""

    def run_stage(spark, docs, sf_dir):
        drop_staged(spark, _LEFT.pop(spark.sparkContext.applicationId, []))
        with staged_here() as mine:
            out = work(spark, docs, sf_dir)
        _LEFT[spark.sparkContext.applicationId] = mine
        return out

    return run_stage


WORK = (quality_stage, line_stage, near_stage, benchmark_stage, bpe_stage)
STAGES = [(f.__name__, _alone(f)) for f in WORK]

#: The classifier's decisions can't be expressed in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each result written to the shared folder and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for work in WORK[:-1]:
        with staged_here() as mine:
            written = stage(work(spark, docs, sf_dir), work.__name__)
        drop_staged(spark, last + [p for p in mine if p != written._staged_at])
        docs, last = written, [written._staged_at]
    return WORK[-1](spark, docs, sf_dir)
