"""Keyed state over streams: pacing, host memory and breakers as folds with state; log tailing and sessions with watermarks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Milliseconds of the reference's defaults: how far apart requests of a host are, and how long a block is remembered.
APART, MEMORY = 250, 900_000
#: Failures in a row that open a breaker.
OPENS = 3


def tailed(spark: SparkSession, path: str, schema: str, after: int) -> DataFrame:
    """A stream of log rows with an id beyond ``after``; offsets are kept in the query's checkpoint."""
    return spark.readStream.schema(schema).parquet(path).where(F.col("id") > after)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, opened, closed, n) of sessions in event time; rows later than ``late`` are dropped, as watermarks define."""
    out = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "n")


def pacing(requests: DataFrame, apart: int = APART) -> DataFrame:
    """(host, id, slot): slots at least ``apart`` milliseconds after the one before of the host, over micro-batches.

    ``requests`` is a stream of (host string, id long, now long). Within a batch a host's requests are served by (now, id).
    """

    def serve(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(batches).sort_values(["now", "id"])
        slots = []
        for now in rows["now"].tolist():
            last = now if last is None else max(now, last + apart)
            slots.append(last)
        state.update((last,))
        yield pd.DataFrame({"host": key[0], "id": rows["id"], "slot": slots})

    return requests.groupBy("host").applyInPandasWithState(serve, "host string, id long, slot long", "last long", "append", GroupStateTimeout.NoTimeout)


def host_memory(outcomes: DataFrame, memory: int = MEMORY) -> DataFrame:
    """(host, blocks, browser_first_until): how each host treats visits, after each micro-batch.

    ``outcomes`` is a stream of (host string, id long, ts long, blocked boolean, status int). A block counts up, from 0 if
    the last was longer ago than ``memory``; 403, 429 or a second block ask for a browser until ts + memory; a success
    resets the count.
    """

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        blocks, last, until = state.get if state.exists else (0, 0, 0)
        for r in pd.concat(batches).sort_values(["ts", "id"]).itertuples():
            if r.blocked:
                blocks = 1 if r.ts - last > memory else blocks + 1
                last = r.ts
                if r.status in (403, 429) or blocks >= 2:
                    until = r.ts + memory
            else:
                blocks = 0
        state.update((int(blocks), int(last), int(until)))
        yield pd.DataFrame({"host": [key[0]], "blocks": [int(blocks)], "browser_first_until": [int(until)]})

    return outcomes.groupBy("host").applyInPandasWithState(fold, "host string, blocks long, browser_first_until long", "blocks long, last long, until long", "update", GroupStateTimeout.NoTimeout)


def breakers(calls: DataFrame, opens: int = OPENS) -> DataFrame:
    """(provider, failures, open) after each micro-batch of (provider string, id long, ok boolean): open from ``opens`` failures in a row."""

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        for ok in pd.concat(batches).sort_values("id")["ok"].tolist():
            failures = 0 if ok else failures + 1
        state.update((int(failures),))
        yield pd.DataFrame({"provider": [key[0]], "failures": [int(failures)], "open": [failures >= opens]})

    return calls.groupBy("provider").applyInPandasWithState(fold, "provider string, failures long, open boolean", "failures long", "update", GroupStateTimeout.NoTimeout)
