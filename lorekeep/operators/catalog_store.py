"""The catalog in buckets: maintenance that reads and rewrites only the buckets a batch touches.

The steps themselves are the pure functions of ``upserts``; here they get the rows of some buckets and give them back. All
tables of one step change in one version, and a step that loses to another writer starts again from the winner's version.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace as replace_
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators import upserts as U
from lorekeep.sources.partitions import Change, Conflict, Manifest, PartitionStore

#: Columns that place the rows of each table.
KEYS = {"entries": U.KEY, "sections": ["entry_id"], "items": ["entry_id"], "summaries": ["entry_id"], "ledger": ["entry_id"]}

#: Tables whose rows hold whole texts: each task writes what it has, so that a commit does not move them to place them.
LOCAL = {"sections"}


class CatalogStore:
    """Tables of the catalog over a ``PartitionStore``; ``top_id`` of a version is the highest entry id ever given."""

    def __init__(self, store: PartitionStore, attempts: int = 5):
        self.store, self.attempts = store, attempts

    def create(self, tables: Mapping[str, DataFrame], buckets: int) -> bool:
        top = tables["entries"].agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0] if "entries" in tables else -1
        return self.store.create({n: (df, KEYS[n], buckets) for n, df in tables.items()}, {"top_id": int(top)}, LOCAL & set(tables))

    def read(self, table: str) -> DataFrame:
        return self.store.read(table)

    def _step(self, make: Callable[[Manifest], tuple[Mapping[str, Change], Mapping]]) -> int:
        for attempt in range(self.attempts):
            base = self.store.manifest()
            try:
                return self.store.commit(base.version, *make(base))
            except Conflict:
                if attempt + 1 == self.attempts:
                    raise
        raise ValueError("no attempts")

    def upsert(self, incoming: DataFrame, now: datetime) -> int:
        """``upsert_entries`` on the buckets of the incoming keys. New ids follow the highest of the version."""

        def make(base: Manifest):
            buckets = self.store.touched("entries", incoming.select(*U.KEY))
            held, top = self.store.read("entries", base.version, buckets), base.facts["top_id"]
            fresh = incoming.join(held.select(*U.KEY), U.KEY, "left_anti").count()
            return {"entries": Change(U.upsert_entries(held, incoming, now, top), buckets)}, {"top_id": top + fresh}

        return self._step(make)

    def write_sections(self, drafts: DataFrame, origin: str, replace: bool) -> int:
        """``write_sections`` on the buckets of the entries that have drafts."""
        step = lambda rows: U.write_sections(rows, drafts, origin, replace)
        return self._step(lambda base: ({"sections": replace_(self.store.update("sections", drafts.select("entry_id"), step), local=True)}, {}))

    def commit_summaries(self, done: DataFrame, now: datetime) -> int:
        """Sections, items, summaries and status of finished entries in their buckets, and their ledger rows added."""

        def make(base: Manifest):
            ids = done.select("entry_id")
            keys = self.store.read("entries", base.version).select("id", *U.KEY).join(ids.select(F.col("entry_id").alias("id")), "id", "left_semi")
            own = self.store.touched("sections", ids)
            buckets = {"entries": self.store.touched("entries", keys), "items": self.store.touched("items", ids), "summaries": self.store.touched("summaries", ids), "sections": own}
            held = {n: self.store.read(n, base.version, b) for n, b in buckets.items()}
            after = U.commit_summaries(held | {"ledger": self.store.read("ledger", base.version, [])}, done, now)
            return {n: Change(after[n], b, local=n in LOCAL) for n, b in buckets.items()} | {"ledger": Change(after["ledger"], append=True)}, {}

        return self._step(make)
