"""Patches on a stream: each run's entries go to the keyed state of their patch, which decides whether it stays open.

The state of a patch is what it was born with, its state, and the bounded list of its latest entries, in
RocksDB; ended patches take no more entries. A timer ends asks that no run has seen for so many days, also
if no entry of theirs comes any more. Runs in a micro-batch are taken by their time, so that states are
those of the same runs in batch (operators.patches), one after the other, wherever the stream was cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT
from ..functions.numbers import DAY_MS
from ..operators import patches as fixed

FIELDS = ("built_ms", "fail", "sessions", "sample", "reach", "hold", "refused_rose", "engage")
ENTRY = "built_ms long, fail double, sessions int, sample int, reach int, hold double, refused_rose boolean, engage double"
FACTS = "mode int, born_ms long, base_fail double, base_engage double, action string, state string, via string"
#: Of a run: which patch, what it was born with, and the entry.
RUNS = f"id string, mode int, born_ms long, base_fail double, base_engage double, action string, {ENTRY}"
STATES = "id string, built_ms long, state string, via string, entries int"
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _slip(facts: dict, history: list[dict], age_days: float) -> tuple[str, str | None]:
    solid = lambda e: e["sample"] >= fixed.SLIP_SAMPLE
    last, base = history[-1], facts["base_fail"]
    if len(history) >= fixed.GRADUATE and all(solid(e) and e["sessions"] == 0 and (e["reach"] or 0) > 0 for e in history[-fixed.GRADUATE :]):
        return "healed", "graduated"
    holds = facts["action"] is None or (last["hold"] is not None and last["hold"] >= DEFAULT.fade and not last["refused_rose"])
    if len(history) >= fixed.CLOSE and holds and all(solid(e) and e["fail"] <= base * fixed.CLOSE_FACTOR for e in history[-fixed.CLOSE :]):
        return "healed", "closed"
    long = len(history) >= fixed.SLIP_FALSIFY and age_days >= fixed.SLIP_FALSIFY_DAYS
    if long and all(not solid(e) or e["fail"] > base * fixed.SLIP_FALSIFY_FACTOR for e in history):
        return "wrong", None
    return "open", None


def last_seen(facts: dict, history: list[dict]) -> int:
    return max([e["built_ms"] for e in history if e["sessions"] > 0], default=facts["born_ms"])


def _ask(facts: dict, history: list[dict], age_days: float, now_ms: int) -> tuple[str, str | None]:
    enough = lambda e: e["sample"] >= fixed.ASK_SAMPLE
    base, engage = facts["base_fail"], facts["base_engage"] or 0.0
    late = history[-fixed.LEARN :]
    if engage > 0 and len(history) >= fixed.LEARN and all(enough(e) and e["fail"] <= base * fixed.LEARN_FACTOR and (e["engage"] or 0.0) >= engage * fixed.ENGAGE_HOLD for e in late):
        return "healed", "learned"
    if now_ms - last_seen(facts, history) >= fixed.LAPSE_DAYS * DAY_MS:
        return "lapsed", None
    long = len(history) >= fixed.ASK_FALSIFY and age_days >= fixed.ASK_FALSIFY_DAYS
    if long and any(map(enough, history)) and all(not enough(e) or e["fail"] > base * fixed.ASK_FALSIFY_FACTOR for e in history):
        return "wrong", None
    return "open", None


def decide(facts: dict, history: list[dict], now_ms: int) -> tuple[str, str | None]:
    """State and way of healing of one patch, as operators.patches.next_state has them."""
    age_days = (now_ms - facts["born_ms"]) / DAY_MS
    return _slip(facts, history, age_days) if facts["mode"] == 1 else _ask(facts, history, age_days, now_ms)


def _plain(row: Any, fields: tuple[str, ...]) -> dict:
    """Values of a row of pandas, which has NaN for null."""
    return {f: None if pd.isna(getattr(row, f)) else getattr(row, f) for f in fields}


class PatchStates(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts, self.history = handle.getValueState("facts", FACTS), handle.getListState("history", ENTRY)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        runs = pd.concat(list(rows)).sort_values("built_ms", kind="stable")
        names = tuple(f.split()[0] for f in FACTS.split(", "))
        facts = dict(zip(names, self.facts.get(), strict=True)) if self.facts.exists() else None
        history = [dict(zip(FIELDS, e, strict=True)) for e in self.history.get()] if self.history.exists() else []
        out = []
        for run in runs.itertuples(index=False):
            if facts is None:
                facts = _plain(run, ("mode", "born_ms", "base_fail", "base_engage", "action")) | {"state": "open", "via": None}
            if facts["state"] != "open":
                break
            entry = _plain(run, FIELDS)
            history = [*(e for e in history if e["built_ms"] != entry["built_ms"]), entry][-DEFAULT.history :]
            state, via = decide(facts, history, int(entry["built_ms"]))
            facts |= {"state": state, "via": via}
            out.append((key[0], int(entry["built_ms"]), state, via, len(history)))
        if facts is not None and out:
            self.facts.update(tuple(_as(facts[n], t) for n, t in (f.split() for f in FACTS.split(", "))))
            self.history.put([tuple(_as(e[n], t) for n, t in (f.split() for f in ENTRY.split(", "))) for e in history])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if facts["state"] == "open" and facts["mode"] == 2:
                self.handle.registerTimer(int(last_seen(facts, history)) + fixed.LAPSE_DAYS * DAY_MS)
        yield pd.DataFrame(out, columns=["id", "built_ms", "state", "via", "entries"])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in FACTS.split(", ")]
        facts = dict(zip(names, self.facts.get(), strict=True))
        out = []
        if facts["state"] == "open":
            self.facts.update(tuple("lapsed" if n == "state" else facts[n] for n in names))
            out.append((key[0], expiredTimerInfo.getExpiryTimeInMs(), "lapsed", None, sum(1 for _ in self.history.get())))
        yield pd.DataFrame(out, columns=["id", "built_ms", "state", "via", "entries"])

    def close(self) -> None:
        pass


def _as(value: Any, kind: str) -> Any:
    if value is None:
        return None
    return {"int": int, "long": int, "double": float, "boolean": bool, "string": str}[kind](value)


def stream_runs(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """Entries of runs, a JSON file each, as they are added below a folder."""
    return spark.readStream.schema(RUNS).option("maxFilesPerTrigger", files_at_once).json(path)


def patch_states(runs: DataFrame) -> DataFrame:
    """(id, built_ms, state, via, entries) after each entry of a patch that was open before it.

    Times of entries are event time: a timer fires once runs are past it.
    """
    timed = runs.withColumn("at", F.timestamp_millis("built_ms")).withWatermark("at", "0 seconds")
    return timed.groupBy("id").transformWithStateInPandas(PatchStates(), STATES, "Update", "EventTime")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, as list state and timers need."""
    before = spark.conf.get(ROCKSDB[0])
    spark.conf.set(*ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(ROCKSDB[0], before)


def follow_patches(runs: DataFrame, sink: str, checkpoint: str):
    """Appends the changes of states to Parquet files, what is there; started again, it goes on from there."""

    def write(rows: DataFrame, batch: int) -> None:
        # A batch that runs twice writes the same folder twice.
        rows.write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    with rocksdb_state(runs.sparkSession):
        return patch_states(runs).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
