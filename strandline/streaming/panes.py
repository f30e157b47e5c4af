"""Panes that late events correct, kept by a stream in a store of bounded size."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.files import exists, names, read_text, remove, rename, write_text
from strandline.functions.times import DAY, HOUR, micros
from strandline.operators import late_events
from strandline.operators.unique_events import earliest


def write_once(spark: SparkSession, target: str, write: Callable[[str], None]) -> bool:
    """Run `write` on a draft and move it to `target`, unless that is there already: a batch that
    is tried again after a failure leaves one copy."""
    if exists(spark, target):
        return False
    folder, name = target.rsplit("/", 1)
    draft = f"{folder}/_draft-{name}"
    remove(spark, draft)
    write(draft)
    rename(spark, draft, target)
    return True


class PaneStore:
    """Panes and the uuids that made them, below one folder.

    taken/batch=N    events a micro-batch brought for the first time
    deltas/batch=N   what they add to each pane
    panes/fold=N/day=D, folds/N.json   sums up to batch N, a folder per day of panes; the newest
                     of the small files says which fold holds which day

    Every `fold_every` batches the deltas are added to the days they touch, and what the new file
    no longer names is removed, as are uuids that arrived `remember_us` before the newest arrival:
    a retry after that counts again. So a batch reads the uuids of that time, the deltas
    since the last fold and the days its windows lie in, however long the stream runs.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], pane_us: int = HOUR, lateness_us: int = 48 * HOUR, remember_us: int = 7 * DAY, fold_every: int = 20) -> None:
        self.spark, self.root, self.keys, self.pane_us, self.lateness_us = spark, root.rstrip("/"), keys, pane_us, lateness_us
        self.remember_us, self.fold_every = remember_us, fold_every

    def _batches(self, kind: str, after: int = -1, before: int | None = None) -> list[int]:
        found = (int(n.removeprefix("batch=")) for n in names(self.spark, f"{self.root}/{kind}") if n.startswith("batch="))
        return sorted(n for n in found if n > after and (before is None or n < before))

    def _read(self, kind: str, batches: list[int]) -> DataFrame | None:
        base = f"{self.root}/{kind}"
        return self.spark.read.option("basePath", base).parquet(*(f"{base}/batch={n}" for n in batches)) if batches else None

    def _state(self) -> dict:
        """upto: the last folded batch; days: the fold that holds each day."""
        folds = [n for n in names(self.spark, f"{self.root}/folds") if n.endswith(".json") and not n.startswith("_")]
        return json.loads(read_text(self.spark, f"{self.root}/folds/{folds[-1]}")) if folds else {"upto": -1, "days": {}}

    def add(self, batch: DataFrame, number: int) -> DataFrame:
        """Take in a micro-batch (uuid, keys, at, arrived_us) and return the panes it changed.

        Of a uuid the earliest event of the batch counts, with its first arrival there; one that an
        earlier batch had is a retry and counts nothing. Taking the last batch in again changes
        nothing and returns the same panes.
        """
        self.fold(number - 1)
        base, deltas = f"{self.root}/taken", f"{self.root}/deltas/batch={number}"
        once = earliest(batch, F.col("uuid"), F.col("at"), {"arrived_us": F.min("arrived_us")}, **{k: F.col(k) for k in self.keys}).withColumnRenamed("key", "uuid")
        seen = self._read("taken", self._batches("taken", before=number))
        new = once if seen is None else once.join(seen.select(F.col("uuid").alias("seen")), F.col("uuid") == F.col("seen"), "left_anti")
        write_once(self.spark, f"{base}/batch={number}", lambda p: new.write.parquet(p))
        taken = self._read("taken", [number])
        write_once(self.spark, deltas, lambda p: late_events.pane_deltas(taken, self.keys, self.pane_us, self.lateness_us).write.parquet(p))
        return self.spark.read.parquet(deltas)

    def fold(self, upto: int) -> None:
        """Add the deltas of batches up to `upto` to their days, if there are enough of them."""
        state = self._state()
        batches = self._batches("deltas", state["upto"], upto + 1)
        if len(batches) < self.fold_every:
            return
        sums = late_events.add_deltas(self._read("deltas", batches).drop("batch"), keys=self.keys).withColumn("day", self._day())
        touched = [r["day"] for r in sums.select("day").distinct().collect()]
        known = self._days(state, touched)
        whole = sums if known is None else late_events.add_deltas(sums.drop("day"), known, keys=self.keys).withColumn("day", self._day())
        write_once(self.spark, f"{self.root}/panes/fold={upto}", lambda p: whole.repartition("day").write.partitionBy("day").parquet(p))
        days = state["days"] | {str(d): upto for d in touched}
        write_text(self.spark, f"{self.root}/folds/{upto:012d}.json", json.dumps({"upto": upto, "days": days}))
        for n in batches:
            remove(self.spark, f"{self.root}/deltas/batch={n}")
        for d in set(map(str, touched)) & set(state["days"]):
            remove(self.spark, f"{self.root}/panes/fold={state['days'][d]}/day={d}")
        for name in names(self.spark, f"{self.root}/folds")[:-1]:
            remove(self.spark, f"{self.root}/folds/{name}")
        self._forget()

    def _forget(self) -> None:
        """Remove the uuids of batches that came too long before the newest arrival."""
        taken = self._read("taken", self._batches("taken"))
        latest = taken.groupBy("batch").agg(F.max("arrived_us").alias("at")).orderBy("batch").collect()
        clock = max((r["at"] for r in latest if r["at"] is not None), default=None)
        running = None
        for r in latest:
            running = max((x for x in (running, r["at"]) if x is not None), default=None)
            if running is not None and running < clock - self.remember_us:
                remove(self.spark, f"{self.root}/taken/batch={r['batch']}")

    def _day(self):
        return F.floor(F.col("pane") / F.lit(DAY)).cast("long")

    def _days(self, state: dict, days: list[int] | None = None) -> DataFrame | None:
        wanted = {d: f for d, f in state["days"].items() if days is None or int(d) in days}
        paths = [f"{self.root}/panes/fold={f}/day={d}" for d, f in wanted.items()]
        return self.spark.read.parquet(*paths).select(*self.keys, "pane", *late_events.COUNTS) if paths else None

    def panes(self, days: list[int] | None = None) -> DataFrame:
        """The panes as they are now, of all days or of some (days since 1970)."""
        state = self._state()
        fresh = self._read("deltas", self._batches("deltas", state["upto"]))
        if fresh is not None and days is not None:
            fresh = fresh.where(self._day().isin(days))
        parts = [p.select(*self.keys, "pane", *late_events.COUNTS) for p in (fresh, self._days(state, days)) if p is not None]
        if not parts:
            raise ValueError("no batch was taken in yet")
        return late_events.add_deltas(*parts, keys=self.keys)

    def windows(self, changed: DataFrame, window_us: int, slide_us: int) -> DataFrame:
        """The windows over changed panes, composed anew from the panes of the days they lie in."""
        day = lambda c: F.floor(c / F.lit(DAY)).cast("long")
        near = F.sequence(day(F.col("pane") - window_us), day(F.col("pane") + window_us))
        days = [r["day"] for r in changed.select(F.explode(near).alias("day")).distinct().collect()]
        return late_events.recompose(self.panes(days), changed, self.keys, window_us, slide_us, self.pane_us)


def late_counts(events: DataFrame, root: str, checkpoint: str, emit: Callable[[DataFrame, int], None], keys: list[str], window_us: int = HOUR, slide_us: int = HOUR, lateness_us: int = 48 * HOUR, remember_us: int = 7 * DAY, **trigger: object) -> StreamingQuery:
    """Start a stream of corrected counts: after each micro-batch `emit` gets the windows whose
    counts it changed, with their new values. Columns of `events`: uuid, keys, timestamp, arrived_us."""

    def take(batch: DataFrame, number: int) -> None:
        store = PaneStore(batch.sparkSession, root, keys, lateness_us=lateness_us, remember_us=remember_us)
        changed = store.add(batch.withColumn("at", micros(batch, "timestamp")), number)
        emit(store.windows(changed, window_us, slide_us), number)

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take).trigger(**(trigger or {"processingTime": "10 seconds"})).start()
