"""Catalogs in a lake: records under content ids with states, pages by digest-bound tokens, retention and holds, events.

One table holds the records of a family (evidence packs, rebuild plans, audit reports, views, comparisons, contexts, searches), another their events. A
record is written once: writing what is there changes nothing. States follow a machine that is given with the catalog.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lake import Lake, LakeError

RECORDS = "record_id string, sequence long, kind string, created_at long, body string, handles array<string>"
EVENTS = "record_id string, sequence long, state string, at long, note string"


class CatalogError(LakeError):
    pass


class Catalog:
    """The records of one family."""

    def __init__(self, lake: Lake, family: str, states: Mapping[str, Sequence[str]] | None = None):
        self.lake, self.family, self.states = lake, family, dict(states or {"": ["recorded"], "recorded": []})
        self.records, self.events = f"{family}_records", f"{family}_events"

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self.lake.versions(name):
            try:
                self.lake.create(name, self.lake.spark.createDataFrame([], schema))
            except LakeError:
                pass  # another writer was first
        return self.lake.table(name)

    def record(self, kind: str, body: Mapping, at: int, handles: Sequence[str] = ()) -> str:
        """The id of the record, the same for the same kind and body; its first state is the machine's first."""
        text = json.dumps(body, sort_keys=True, separators=(",", ":"))
        ident = f"{self.family}-" + hashlib.sha1(f"{kind}|{text}".encode()).hexdigest()[:16]
        known = self._table(self.records, RECORDS)
        if known.where(F.col("record_id") == ident).isEmpty():
            sequence = (known.agg(F.max("sequence")).first()[0] or 0) + 1
            self.lake.upsert(self.records, self.lake.spark.createDataFrame([(ident, sequence, kind, at, text, sorted(set(handles)))], RECORDS), "record_id")
            self.move(ident, self.states[""][0], at)
        return ident

    def last(self, kind: str | None = None) -> dict | None:
        """The record written last, of a kind if one is named."""
        rows = self._table(self.records, RECORDS)
        best = (rows if kind is None else rows.where(F.col("kind") == kind)).orderBy(F.desc("sequence"), "record_id").first()
        return None if best is None else best.asDict() | {"body": json.loads(best.body)}

    def get(self, record_id: str) -> dict:
        row = self._table(self.records, RECORDS).where(F.col("record_id") == record_id).first()
        if row is None:
            raise CatalogError(f"{self.family} has no record {record_id!r}")
        return row.asDict() | {"body": json.loads(row.body)}

    def find(self, handle: str) -> DataFrame:
        """Records that a handle is attached to."""
        return self._table(self.records, RECORDS).where(F.array_contains("handles", handle))

    def state(self, asof: int | None = None) -> DataFrame:
        """(record_id, state, at): the last event of each record, as of a time."""
        rows = self._table(self.events, EVENTS)
        last = (rows if asof is None else rows.where(F.col("at") <= asof)).groupBy("record_id").agg(F.max(F.struct("at", "sequence", "state")).alias("e"))
        return last.select("record_id", F.col("e.state").alias("state"), F.col("e.at").alias("at"))

    def move(self, record_id: str, state: str, at: int, note: str = "") -> None:
        """An event that brings a record into a state that its machine allows from the present one."""
        events = self._table(self.events, EVENTS).where(F.col("record_id") == record_id)
        now = events.orderBy(F.desc("at"), F.desc("sequence")).first()
        before = now.state if now else ""
        if state not in self.states.get(before, ()):
            raise CatalogError(f"{record_id}: {before or 'new'} can't become {state}")
        self.lake.append(self.events, self.lake.spark.createDataFrame([(record_id, (now.sequence if now else 0) + 1, state, at, note)], EVENTS))

    def page(self, limit: int, token: str | None = None, where: Column | None = None, name: str = "") -> tuple[DataFrame, str | None]:
        """Records, the newest first, and the token of the next page. A token is bound to the catalog, the filter's name and the limit: another query refuses it."""
        bound = hashlib.sha1(f"{self.family}|{name}|{limit}".encode()).hexdigest()[:12]
        rows = self._table(self.records, RECORDS)
        rows = rows if where is None else rows.where(where)
        if token is not None:
            try:
                digest, at, ident = json.loads(base64.urlsafe_b64decode(token))
            except ValueError:
                raise CatalogError("the token can't be read") from None
            if digest != bound:
                raise CatalogError("the token is of another query")
            rows = rows.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("record_id") > ident)))
        got = rows.orderBy(F.desc("created_at"), "record_id").limit(limit + 1).collect()  # a page
        more = got[limit - 1] if len(got) > limit else None
        nxt = base64.urlsafe_b64encode(json.dumps([bound, more.created_at, more.record_id]).encode()).decode() if more else None
        return self.lake.spark.createDataFrame(got[:limit], RECORDS), nxt

    def verdicts(self, keep: int, since: int, holds: DataFrame | None = None) -> DataFrame:
        """(record_id, verdict): protected by a hold, kept as among the last of its kind or recent, else expired."""
        from ..operators.records import retention

        return retention(self._table(self.records, RECORDS).withColumnRenamed("record_id", "id"), ["kind"], keep, since, protected=None if holds is None else holds.select(F.col("record_id").alias("id"))).select(F.col("id").alias("record_id"), "verdict")

    def expire(self, keep: int, since: int, holds: DataFrame | None = None) -> int:
        """Drop what the verdicts say; how many records went. Their events stay as the audit trail."""
        gone = self.verdicts(keep, since, holds).where("verdict = 'expired'").select("record_id")
        before = self._table(self.records, RECORDS)
        n = gone.count()
        if n:
            self.lake._replace(self.records, lambda old: old.join(gone, "record_id", "left_anti").select(before.columns))
        return n

    def export(self, path: str) -> None:
        """NDJSON of the records with their states."""
        from .formats import to_lines

        to_lines(self._table(self.records, RECORDS).join(self.state().withColumnRenamed("at", "state_at"), "record_id", "left"), path)
