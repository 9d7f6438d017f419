"""Structured Streaming forms of the timeline operators."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(stream: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Rows per key and tumbling window; rows later than the watermark are dropped by Spark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def sessions(stream: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Runs of rows no further apart than a gap: the streaming form of merged intervals around points."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def paired_markers(stream: DataFrame, key: str, time: str, kind: str, starts: tuple[str, ...], stops: tuple[str, ...]) -> DataFrame:
    """(key, start, end) of marker episodes; the state of a key is its open start. Rows of a micro-batch are taken in time order."""

    def step(k, frames, state):
        import pandas as pd

        opened = state.get[0] if state.exists else None
        opened = None if opened == -1 else opened
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        out = []
        for t, x in zip(rows[time], rows[kind]):
            if x in starts:
                opened = int(t)
            elif x in stops and opened is not None:
                out.append((k[0], opened, int(t)))
                opened = None
        state.update((-1 if opened is None else opened,))
        yield pd.DataFrame(out, columns=[key, "start", "end"])

    kt = stream.schema[key].dataType.simpleString()
    marks = stream.where(F.col(kind).isin(*starts, *stops)).select(key, time, kind)
    return marks.groupBy(key).applyInPandasWithState(step, f"{key} {kt}, start long, end long", "opened long", "append", "NoTimeout")


def asof_previous(stream: DataFrame, key: str, time: str, tick: str, value: str) -> DataFrame:
    """(key, time, value, error) for each tick row of a stream of samples and ticks: the sample at or before it of those seen so far.

    `tick` is a boolean column; the state of a key is its latest sample. Rows of a micro-batch are taken in time order, samples before ticks; a sample that comes
    after a later tick has been answered does not change that answer: a batch run over the whole log does."""

    def step(k, frames, state):
        import pandas as pd

        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values([time, tick], kind="stable")
        out = []
        for t, is_tick, v in zip(rows[time], rows[tick], rows[value]):
            if not is_tick:
                if last is None or int(t) >= last[0]:
                    last = (int(t), float(v))
            elif last is not None and last[0] <= int(t):
                out.append((k[0], int(t), last[1], int(t) - last[0]))
            else:
                out.append((k[0], int(t), None, None))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=[key, time, value, "error"]).astype({value: "float64", "error": "Int64"})

    kt = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, time, tick, F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kt}, {time} long, {value} double, error long", "t long, v double", "append", "NoTimeout")


def late_rows(query) -> int:
    """How many rows a query's watermark has dropped so far, from its progress."""
    told = [json.loads(p.json) for p in query.recentProgress]
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in told for op in p["stateOperators"])


def upsert_into(lake, table: str, key: str):
    """A foreachBatch function that upserts each micro-batch into a lake table; replaying a batch changes nothing."""

    def put(batch: DataFrame, _epoch: int) -> None:
        if not batch.isEmpty():
            lake.upsert(table, batch, key) if lake.versions(table) else lake.create(table, batch)

    return put


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drive a stream over all input there is into an in-memory table; for bounded inputs."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
