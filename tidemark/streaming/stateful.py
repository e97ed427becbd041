"""Streams that decide by what they decided before: caches with a time to live, rate limits, and histories of runs, as keyed state with timers.

Each is a processor for `transformWithStateInPandas`: its state is a row a key (a row a run for histories), kept in Spark's state store with the query's checkpoint, so a
query that starts again goes on where it was. An event-time timer drops the state of a key that has been quiet for longer than it can matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming import live

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EARTH_NM = 3440.065


@contextmanager
def state_store(spark: SparkSession):
    """The session with the state store that keyed state needs; as it was afterwards. Queries must be started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _nm(lat: float, lon: float, to_lat: float, to_lon: float) -> float:
    a, b, c, d = np.radians([lat, lon, to_lat, to_lon])
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * EARTH_NM * float(np.arcsin(min(1.0, np.sqrt(h))))


class Throttle(StatefulProcessor):
    """Marks rows that are `seconds` and, if given, `least_nm` after the last one taken of their key; a taken row that is not ok isn't remembered."""

    def __init__(self, order: list[str], seconds: float, least_nm: float | None, ok: str | None, keep: list[str]):
        self.order, self.seconds, self.least_nm, self.ok, self.keep = order, seconds, least_nm, ok, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, lat double, lon double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        b = pd.concat(list(rows))  # a key's rows of one micro-batch, whose size the source bounds
        b = b.sort_values(["event_us", *self.order], kind="stable")
        last = self.last.get() if self.last.exists() else None
        metres = self.least_nm is not None
        none = [0.0] * len(b)
        places = (b["lat"].tolist(), b["lon"].tolist()) if metres else (none, none)
        taken = []
        for us, lat, lon, good in zip(b["event_us"].tolist(), *places, b[self.ok].tolist() if self.ok else [True] * len(b), strict=True):
            late = last is None or us - last[0] >= self.seconds * 1e6
            take = late and (last is None or not metres or _nm(last[1], last[2], lat, lon) >= self.least_nm)
            if take and good:
                last = (us, lat, lon)
            taken.append(take)
        if last is not None:
            self.last.update(tuple(last))
            if not metres:  # with a distance to go, an old place still counts
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(int(last[0] // 1000 + self.seconds * 1000) + 1)
        yield b[self.keep].assign(taken=taken)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.last.clear()  # all that is to come is later than the time to live
        return iter(())

    def close(self) -> None:
        pass


def throttled(rows: DataFrame, keys: list[str], at: str, seconds: float, least_nm: float | None = None, ok: str | None = None, late: str = "1 hour") -> DataFrame:
    """The streaming form of `stations.throttled`: `rows` (a stream) with `taken`. Start it within `state_store`; rows more than `late` behind the newest may find their key's state gone.

    A micro-batch's rows are taken in the order of their times; a row that comes in a later batch than newer ones of its key is judged after those.
    """
    keep = [c for c in rows.columns]
    rest = [c for c in keep if c not in keys and c != at]
    dealt = rows.withColumn("event_us", F.unix_micros(at)).withWatermark(at, late)
    schema = T.StructType([*rows.schema.fields, T.StructField("taken", T.BooleanType())])
    return dealt.groupBy(*keys).transformWithStateInPandas(Throttle(rest, seconds, least_nm, ok, keep), schema, "Append", "EventTime")


class Runs(StatefulProcessor):
    """The runs of a key's present target date, the newest of each slot; a row for a new date clears them."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.date = handle.getValueState("date", "day date")
        self.runs = handle.getMapState("runs", "slot int", "us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        b = pd.concat(list(rows)).sort_values(["at_us", "slot"], kind="stable")
        day = self.date.get()[0] if self.date.exists() else None
        for r in b.itertuples():
            if day is None or r.target_date > day:
                day = r.target_date
                self.runs.clear()
            if r.target_date == day:
                old = self.runs.getValue((int(r.slot),)) if self.runs.containsKey((int(r.slot),)) else None
                if old is None or r.at_us >= old[0]:
                    self.runs.updateValue((int(r.slot),), (int(r.at_us),))
        self.date.update((day,))
        slots = sorted((int(s[0]), int(v[0])) for s, v in self.runs.iterator())
        out = pd.DataFrame({"target_date": [day] * len(slots), "slot": [s for s, _ in slots], "at_us": [u for _, u in slots]})
        for name, value in zip(self.keys, key, strict=True):
            out[name] = value
        yield out[[*self.keys, "target_date", "slot", "at_us"]]

    def close(self) -> None:
        pass


def run_histories(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, target_date, slot, at_us): after each batch the runs of the keys it touched, out of a stream of runs (keys, target_date, slot int, `at`).

    Runs of an older date than a key's present one are gone, and of a slot the newest run counts. Start it within `state_store`.
    """
    fields = [rows.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("target_date", T.DateType()), T.StructField("slot", T.IntegerType()), T.StructField("at_us", T.LongType())])
    dealt = rows.select(*keys, "target_date", "slot", F.unix_micros(at).alias("at_us"))
    return dealt.groupBy(*keys).transformWithStateInPandas(Runs(keys), schema, "Update", "None")


def settled(make, spark: SparkSession) -> DataFrame:
    """All rows that a stateful stream gives for what is there now, each batch written to the shared folder; `make` is a function without arguments that builds the stream."""
    root = live._root(spark)
    with state_store(spark):
        out = make()
        save = lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        out.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out/batch=*")
