"""Keyed state machines over events in the order of their time: job lanes and an answer cache.

A machine takes one event after the other. On a stream the events of a key wait in state until the watermark has passed
them (Spark drops what comes later than that), and event-time timers wake the key for what is due; the machine's state
lies in value and map states. In batch the rows of a key are sorted and stream through one machine, of which only the
state is held, so a key may be of any size. Both give the same rows. A machine is a recurrence, so a key is one task.

Times are milliseconds. Events are ordered by time, then by id; rows without key, time or id are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How long a job of a kind may run, in milliseconds; others have the last.
CAPS = {"scan": 20_000, "marks": 8_000, "filter": 5_000}
OTHER_CAP = 10_000
FOREVER = (1 << 62) - 1


class Lane:
    """One running job and the newest waiting one. A request waits while a job runs and takes the place of what waited
    (``stale``); one that supersedes takes the running job's place too (``superseded``). A result ends the running job
    (``done``) if it carries its id and is ``late`` if not; a job that runs into its kind's cap ends with ``timeout``.
    ``cancel`` ends both. What waited starts when the running job ends."""

    EVENT = "kind string, action string, job long"
    OUT = "job long, outcome string, at long"
    STATES = {"active": "job long, kind string, deadline long", "pending": "job long, kind string"}

    def __init__(self, caps: dict[str, int] | None = None, other: int = OTHER_CAP) -> None:
        self.caps, self.other = dict(CAPS if caps is None else caps), other
        self.clear()

    def clear(self) -> None:
        self.active = self.pending = None

    def load(self, states: dict) -> None:
        self.active, self.pending = (tuple(states[s].get()) if states[s].exists() else None for s in self.STATES)

    def store(self, states: dict) -> None:
        for name in self.STATES:
            own = getattr(self, name)
            if own is not None:
                states[name].update(own)
            elif states[name].exists():
                states[name].clear()

    def due(self) -> int | None:
        return self.active and self.active[2]

    def _start(self, job: int, kind: str, at: int) -> None:
        self.active = job, kind, at + self.caps.get(kind, self.other)

    def _end(self, at: int) -> None:
        waited, self.active, self.pending = self.pending, None, None
        if waited:
            self._start(*waited, at)

    def advance(self, now: int) -> list[tuple]:
        """Jobs that run into their cap up to ``now``."""
        out = []
        while self.active and self.active[2] <= now:
            job, _, at = self.active
            out.append((job, "timeout", at))
            self._end(at)
        return out

    def step(self, at: int, kind: str, action: str, job: int) -> list[tuple]:
        out = []
        if action == "result":
            if self.active and self.active[0] == job:
                out.append((job, "done", at))
                self._end(at)
            else:
                out.append((job, "late", at))
            return out
        stops = action in ("supersede", "cancel")
        if self.pending and (self.active or stops):
            out.append((self.pending[0], "cancelled" if action == "cancel" else "stale", at))
            self.pending = None
        if stops and self.active:
            out.append((self.active[0], "cancelled" if action == "cancel" else "superseded", at))
            self.active = None
        if action != "cancel":
            if self.active:
                self.pending = job, kind
            else:
                self._start(job, kind, at)
        return out


class Cache:
    """Answers kept for ``ttl``: a lookup within it gets the kept answer (hit), another one its own, which is kept from
    then on. ``purge`` forgets all of the key."""

    EVENT = "item string, action string, answer string"
    OUT = "item string, hit boolean, answer string, at long"
    STATES: dict[str, str] = {}
    MAP = ("answers", "item string", "answer string, kept long")

    def __init__(self, ttl: int = 24 * 3600 * 1000) -> None:
        self.ttl = ttl
        self.clear()

    def clear(self) -> None:
        self.answers: dict[str, tuple[str, int]] = {}

    def load(self, states: dict) -> None:
        self.answers = {k[0]: tuple(v) for k, v in states["answers"].iterator()}

    def store(self, states: dict) -> None:
        """Only what changed is written."""
        held = {k[0]: tuple(v) for k, v in states["answers"].iterator()}
        for item in held.keys() - self.answers.keys():
            states["answers"].removeKey((item,))
        for item, own in self.answers.items():
            if held.get(item) != own:
                states["answers"].updateValue((item,), own)

    def due(self) -> int | None:
        return min((kept for _, kept in self.answers.values()), default=None) and min(kept for _, kept in self.answers.values()) + self.ttl

    def advance(self, now: int) -> list[tuple]:
        """Forget answers whose time is over, so that state doesn't grow."""
        self.answers = {k: v for k, v in self.answers.items() if now - v[1] < self.ttl}
        return []

    def step(self, at: int, item: str, action: str, answer: str) -> list[tuple]:
        if action == "purge":
            self.clear()
            return []
        held = self.answers.get(item)
        if held and at - held[1] < self.ttl:
            return [(item, True, held[0], at)]
        self.answers[item] = answer, at
        return [(item, False, answer, at)]


Machine = Lane | Cache


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(",")]


def events_for(machine: type, events: DataFrame, key: Column, at: Column, id_: Column, *fields: Column) -> DataFrame:
    """Rows as ``replayed`` and ``streamed`` take them: key, at, id and the machine's fields; ``ts`` for the watermark."""
    own = [f.cast(c.split()[1]).alias(c.split()[0]) for f, c in zip(fields, machine.EVENT.split(", "), strict=True)]
    ts = at.cast("timestamp")
    rows = events.select(key.cast("string").alias("key"), F.unix_millis(ts).alias("at"), id_.cast("long").alias("id"), *own, ts.alias("ts"))
    return rows.where("key is not null and at is not null and id is not null")


def replayed(rows: DataFrame, make: Callable[[], Machine]) -> DataFrame:
    """Batch: what the machine gives for each key, to the end of time."""
    kind = type(make())
    fields = _names(kind.EVENT)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, key, out = make(), None, []
        for batch in batches:
            for own, at, *event in batch[["key", "at", *fields]].astype(object).where(batch[["key", "at", *fields]].notna(), None).itertuples(index=False, name=None):
                if own != key:
                    if key is not None:
                        out += [(key, *x) for x in machine.advance(FOREVER)]
                    machine.clear()
                    key = own
                out += [(key, *x) for x in machine.advance(at)]
                out += [(key, *x) for x in machine.step(at, *event)]
            yield pd.DataFrame(out, columns=["key", *_names(kind.OUT)])
            out = []
        if key is not None:
            yield pd.DataFrame([(key, *x) for x in machine.advance(FOREVER)], columns=["key", *_names(kind.OUT)])

    return rows.drop("ts").repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(run, f"key string, {kind.OUT}")


class Waiting(StatefulProcessor):
    """Holds a key's events until the watermark has passed them, then hands them on in order."""

    def __init__(self, make: Callable[[], Machine]) -> None:
        self.make = make

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.machine = handle, self.make()
        self.fields = _names(self.machine.EVENT)
        self.waiting = handle.getListState("waiting", f"at long, id long, {self.machine.EVENT}")
        self.states = {name: handle.getValueState(name, ddl) for name, ddl in self.machine.STATES.items()}
        if hasattr(self.machine, "MAP"):
            name, key, value = self.machine.MAP
            self.states[name] = handle.getMapState(name, key, value)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for df in rows:
            part = df[["at", "id", *self.fields]]
            new += part.astype(object).where(part.notna(), None).itertuples(index=False, name=None)
        if new:
            self.waiting.appendList([tuple(r) for r in new])
            self.handle.registerTimer(min(int(r[0]) for r in new))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        ready, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        machine = self.machine
        machine.load(self.states)
        out = []
        for at, _, *event in ready:
            out += machine.advance(at)
            out += machine.step(at, *event)
        out += machine.advance(now)
        machine.store(self.states)
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        for at in {later[0][0] if later else None, machine.due()} - {None}:
            self.handle.registerTimer(int(at))
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["key", *_names(machine.OUT)])

    def close(self) -> None:
        pass


def streamed(rows: DataFrame, make: Callable[[], Machine], delay: str = "1 minute") -> DataFrame:
    """Stream, append mode: what the machine gives for each key, up to the watermark."""
    out = f"key string, {type(make()).OUT}"
    return rows.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(Waiting(make), out, "append", "eventTime")


# ---------------------------------------------------------------- results of requests


def current_results(requests: DataFrame, results: DataFrame, life: str = "1 hour") -> DataFrame:
    """Results whose request was made within ``life`` before and, when they came, was still its key's newest. requests:
    key, revision, asked (timestamp); results: key, revision, came (timestamp) and any more columns. On streams both
    sides have a watermark (on asked and came), and ``life`` bounds the state: a request is held until no result can refer
    to it any more, a result until no newer request from before it can arrive."""
    own = requests.select(F.col("key").alias("_key"), F.col("revision").alias("_revision"), "asked")
    met = results.join(own, (F.col("key") == F.col("_key")) & (F.col("revision") == F.col("_revision")) & (F.col("asked") <= F.col("came")) & (F.col("asked") >= F.col("came") - F.expr(f"interval {life}")))
    newer = requests.select(F.col("key").alias("_newer_key"), F.col("revision").alias("_newer"), F.col("asked").alias("_newer_asked"))
    late = (F.col("key") == F.col("_newer_key")) & (F.col("_newer") > F.col("revision")) & (F.col("_newer_asked") <= F.col("came")) & (F.col("_newer_asked") >= F.col("came") - F.expr(f"interval {life}"))
    return met.drop("_key", "_revision").join(newer, late, "left_outer").where("_newer_key is null").drop("_newer_key", "_newer", "_newer_asked")
