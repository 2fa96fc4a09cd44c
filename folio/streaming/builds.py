"""The state of builds from what happens to them, over a table of all events or over a stream as they come; both follow the same rules.

Events are (run_id, at TIMESTAMP, seq, event, step, fingerprint): seq breaks ties of time, step counts from 0 in the order of operators.incremental.STEPS, null standing for the step that is due.

A build's completed steps are always the first ones, so its state is how many those are (`done`), and whether the step after them is pending, running or failed (`phase`).
  submitted    with another fingerprint the build begins anew; with the same one a failed step is pending again. Not while a step runs under the same fingerprint.
  started      a step whose predecessors are all completed, while none runs; steps from it on are no longer completed.
  completed    the running step; with the last one the build is completed.
  failed       the running step.
  files_lost   of a completed step, by default the last; it and those behind it are pending again. Not while a step runs.
Anything else is rejected and counted, and changes nothing. A step that runs while its build hears nothing for longer than the patience is abandoned: it counts as failed.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.incremental import STEPS

EVENTS = ("submitted", "started", "completed", "failed", "files_lost")
N = len(STEPS)
STATE = "fingerprint string, done int, phase string, rejected int, abandoned int, at timestamp"
RESULT = f"run_id long, {STATE}, step string, status string"


def start() -> dict:
    return {"fingerprint": None, "done": 0, "phase": "pending", "rejected": 0, "abandoned": 0, "at": None}


def waited(s: dict, now, patience: timedelta) -> dict:
    """The state at a time: a running step that was not heard of for longer than the patience is abandoned."""
    if s["phase"] == "running" and now - s["at"] > patience:
        return {**s, "phase": "failed", "abandoned": s["abandoned"] + 1}
    return s


def advance(s: dict, e: dict, patience: timedelta) -> dict:
    """The state after an event. The same as `_merge` says as an expression."""
    s = {**waited(s, e["at"], patience), "at": e["at"]} if s["at"] is not None else {**s, "at": e["at"]}
    step, running = e["step"], s["phase"] == "running"
    if e["event"] == "submitted" and e["fingerprint"] is not None:
        if e["fingerprint"] != s["fingerprint"]:
            return {**s, "fingerprint": e["fingerprint"], "done": 0, "phase": "pending"}
        if not running:
            return {**s, "phase": "pending"}
    elif e["event"] == "started":
        step = s["done"] if step is None else step
        if s["fingerprint"] is not None and not running and 0 <= step <= s["done"] and step < N:
            return {**s, "done": step, "phase": "running"}
    elif e["event"] in ("completed", "failed"):
        if running and step in (None, s["done"]):
            return {**s, "phase": "failed"} if e["event"] == "failed" else {**s, "done": s["done"] + 1, "phase": "pending"}
    elif e["event"] == "files_lost":
        step = s["done"] - 1 if step is None else step
        if not running and 0 <= step < s["done"]:
            return {**s, "done": step, "phase": "pending"}
    return {**s, "rejected": s["rejected"] + 1}


def named(done: Column, phase: Column, fingerprint: Column) -> list[Column]:
    """(step, status): the step that is due, null if none, and unknown, completed, pending, running or failed."""
    status = F.when(fingerprint.isNull(), "unknown").when(done == N, "completed").otherwise(phase)
    return [F.get(F.array(*map(F.lit, STEPS)), done).alias("step"), status.alias("status")]


def _struct(s: Column, **new: Column) -> Column:
    kinds = {"done": "int", "rejected": "int", "abandoned": "int"}
    return F.struct(*[(new.get(c, s[c]).cast(kinds[c]) if c in kinds else new.get(c, s[c])).alias(c) for c in ("fingerprint", "done", "phase", "rejected", "abandoned", "at")])


def _waited(s: Column, now: Column, patience: timedelta) -> Column:
    late = (s["phase"] == "running") & (F.unix_micros(now) - F.unix_micros(s["at"]) > int(patience / timedelta(microseconds=1)))
    return F.when(F.coalesce(late, F.lit(False)), _struct(s, phase=F.lit("failed"), abandoned=s["abandoned"] + 1)).otherwise(s)


def _merge(given: Column, e: Column, patience: timedelta) -> Column:
    def after(s: Column) -> Column:
        running = s["phase"] == "running"
        pending, due = F.lit("pending"), F.coalesce(e["step"], s["done"])
        lost = F.coalesce(e["step"], s["done"] - 1)
        now = lambda **new: _struct(s, at=e["at"], **new)
        return (
            F.when((e["event"] == "submitted") & e["fingerprint"].isNotNull() & ~e["fingerprint"].eqNullSafe(s["fingerprint"]), now(fingerprint=e["fingerprint"], done=F.lit(0), phase=pending))
            .when((e["event"] == "submitted") & e["fingerprint"].isNotNull() & ~running, now(phase=pending))
            .when((e["event"] == "started") & s["fingerprint"].isNotNull() & ~running & due.between(0, N - 1) & (due <= s["done"]), now(done=due, phase=F.lit("running")))
            .when((e["event"] == "completed") & running & (due == s["done"]), now(done=s["done"] + 1, phase=pending))
            .when((e["event"] == "failed") & running & (due == s["done"]), now(phase=F.lit("failed")))
            .when((e["event"] == "files_lost") & ~running & (lost >= 0) & (lost < s["done"]), now(done=lost, phase=pending))
            .otherwise(now(rejected=s["rejected"] + 1))
        )

    return F.get(F.transform(F.array(_waited(given, e["at"], patience)), after), 0)


def build_states(events: DataFrame, patience: timedelta, horizon=None) -> DataFrame:
    """(run_id, fingerprint, done, phase, rejected, abandoned, at, step, status) of every run: its events in order, folded within the JVM. at: its last event.

    horizon: the time up to which was listened, by default that of the last event of all; steps that were silent for longer than the patience by then are abandoned.
    A run's events are gathered in one row, which holds as many as the run has. Events without a run, a time or a kind have no part; an unknown kind is rejected. An empty table gives no rows.
    """
    e = events.select("run_id", F.struct("at", "seq", "event", F.col("step").cast("int").alias("step"), "fingerprint").alias("e")).where("run_id IS NOT NULL AND e.at IS NOT NULL AND e.event IS NOT NULL")
    until = F.lit(horizon) if horizon is not None else F.lit(e.agg(F.max("e.at")).first()[0])
    zero = F.struct(F.lit(None).cast("string").alias("fingerprint"), F.lit(0).alias("done"), F.lit("pending").alias("phase"), F.lit(0).alias("rejected"), F.lit(0).alias("abandoned"), F.lit(None).cast("timestamp").alias("at"))
    each = e.groupBy("run_id").agg(F.array_sort(F.collect_list("e")).alias("all"))
    folded = each.select("run_id", F.aggregate("all", zero, lambda s, x: _merge(s, x, patience)).alias("s"))
    s = folded.select("run_id", _waited(F.col("s"), until.cast("timestamp"), patience).alias("s")).select("run_id", "s.*")
    return s.select("*", *named(F.col("done"), F.col("phase"), F.col("fingerprint")))


def _result(key, s: dict) -> pd.DataFrame:
    status = "unknown" if s["fingerprint"] is None else "completed" if s["done"] == N else s["phase"]
    return pd.DataFrame([{"run_id": key[0], **s, "step": STEPS[s["done"]] if s["done"] < N else None, "status": status}])


def build_states_stream(events: DataFrame, patience: timedelta, late: str = "0 seconds") -> DataFrame:
    """The same over a stream: a row for a run whenever its state may have changed, its last row being what build_states gives. Writes in update mode.

    A run's state is six values, kept in the state store; a timer set `patience` behind its last event, if a step runs, tells when it is abandoned. An event that is older than the watermark
    (`late` behind the newest) is dropped. The session needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    fields = [f.split()[0] for f in STATE.split(", ")]
    epoch = pd.Timestamp("1970-01-01")
    millis = lambda t: -(-(pd.Timestamp(t) - epoch) // timedelta(milliseconds=1))  # noqa: E731  whole ones, up

    class Builds(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.state = handle, handle.getValueState("state", STATE)

        def _load(self) -> dict:
            return dict(zip(fields, self.state.get(), strict=True)) if self.state.exists() else start()

        def _keep(self, s: dict) -> None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if s["phase"] == "running":
                self.handle.registerTimer(int(millis(s["at"] + patience)) + 1)
            self.state.update(tuple(s[f] for f in fields))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            s = self._load()
            every = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
            for e in every.to_dict("records"):
                s = advance(s, {**e, "at": e["at"].to_pydatetime(), "step": None if pd.isna(e["step"]) else int(e["step"]), "fingerprint": None if pd.isna(e["fingerprint"]) else e["fingerprint"]}, patience)
            self._keep(s)
            yield _result(key, s)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            s = self._load()
            if s["phase"] == "running":
                s = {**s, "phase": "failed", "abandoned": s["abandoned"] + 1}
                self._keep(s)
                yield _result(key, s)

    e = events.where("run_id IS NOT NULL AND at IS NOT NULL AND event IS NOT NULL").select("run_id", "at", "seq", "event", F.col("step").cast("int").alias("step"), "fingerprint").withWatermark("at", late)
    return e.groupBy("run_id").transformWithStateInPandas(Builds(), RESULT, "Update", "eventTime")
