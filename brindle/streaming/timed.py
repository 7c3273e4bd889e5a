"""Keyed state with event-time timers: a breaker that half-opens, and hosts that are forgotten after quiet time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Failures in a row that open a breaker, and milliseconds until it lets a call try again.
OPENS, COOLDOWN = 5, 60_000
#: Milliseconds that a block is remembered; blocks of a host in that time that ask for a browser; statuses that ask at once.
MEMORY, BLOCKS, FENDED = 900_000, 2, (403, 429)


def _ordered(batches: Iterator[pd.DataFrame]) -> Iterator[Any]:
    """A key's rows of one micro-batch by (ts, id); the source's rate limit bounds them."""
    yield from pd.concat(batches).sort_values(["ts", "id"]).itertuples()


class _Timed(StatefulProcessor):
    """One value state with the key's counters and a single timer, moved with each change."""

    schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.schema)

    def move_timer(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class Breaker(_Timed):
    """closed until ``opens`` failures in a row; open for ``cooldown``; then half_open: a success closes, a failure opens it anew."""

    schema = "failures long, opened long"

    def __init__(self, opens: int, cooldown: int):
        self.opens, self.cooldown = opens, cooldown

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        failures, opened = self.kept.get() if self.kept.exists() else (0, None)
        out = []
        for r in _ordered(rows):
            state = "closed" if opened is None else "open" if r.ts < opened + self.cooldown else "half_open"
            out.append((key[0], int(r.id), state))
            if r.ok:
                failures, opened = 0, None
            else:
                failures += 1
                if failures >= self.opens and state != "open":
                    opened = int(r.ts)
        if failures:
            self.kept.update((int(failures), opened))
        elif self.kept.exists():
            self.kept.clear()
        self.move_timer(None if opened is None else opened + self.cooldown)
        yield pd.DataFrame(out, columns=["provider", "id", "state"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"provider": [key[0]], "id": pd.array([None], dtype="Int64"), "state": ["half_open"]})


def guarded(calls: DataFrame, opens: int = OPENS, cooldown: int = COOLDOWN, late: str = "0 seconds") -> DataFrame:
    """(provider, id, state) of a stream of (provider string, id long, ts long ms, ok boolean): how each call finds its breaker.

    A row without an id says that the watermark has passed the end of a cool-down. A provider without failures keeps no state.
    A failure while open counts but doesn't lengthen the cool-down. Rows later than ``late`` are dropped, as watermarks define, and rows with a null.
    """
    timed = calls.dropna(subset=["provider", "id", "ts", "ok"]).withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    return timed.groupBy("provider").transformWithStateInPandas(Breaker(opens, cooldown), "provider string, id long, state string", "append", "eventtime")


class Host(_Timed):
    """Counts blocks, from none if the last is longer ago than ``memory``; all is dropped when the watermark is ``memory`` past the last block."""

    schema = "blocks long, blocked long, succeeded long, until long"

    def __init__(self, memory: int):
        self.memory = memory

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        blocks, blocked, succeeded, until = self.kept.get() if self.kept.exists() else (0, None, None, None)
        last = 0
        for r in _ordered(rows):
            last = int(r.ts)
            if r.blocked:
                if blocked is None or r.ts - blocked > self.memory:
                    blocks, until = 0, None
                blocks, blocked = blocks + 1, last
                if r.status in FENDED or blocks >= BLOCKS:
                    until = last + self.memory
            else:
                blocks, succeeded = 0, last
                if not r.browser:
                    until = None
        stands = blocked is not None and last - blocked <= self.memory and (succeeded is None or succeeded < blocked)
        if blocked is None:
            self.move_timer(None)  # only successes: nothing to remember
        else:
            self.kept.update((int(blocks), blocked, succeeded, until))
            self.move_timer(blocked + self.memory + 1)
        yield pd.DataFrame({"host": [key[0]], "blocks": [int(blocks)], "browser_first": [until is not None and until > last], "blocked": [stands]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        yield pd.DataFrame({"host": [key[0]], "blocks": [0], "browser_first": [False], "blocked": [False]})


def remembered(outcomes: DataFrame, memory: int = MEMORY, late: str = "0 seconds") -> DataFrame:
    """(host, blocks, browser_first, blocked): how a host is to be visited, after each micro-batch that names it and when it is forgotten.

    ``outcomes`` is a stream of (host string, id long, ts long ms, blocked boolean, status int, browser boolean). A success
    sets the count to 0, and takes back the wish for a browser unless it came by one. ``blocked``: the last block is newer than
    the last success and than ``memory``. A null status or browser says nothing, rows with another null are dropped. State lives for ``memory`` after a host's last block.
    """
    timed = outcomes.dropna(subset=["host", "id", "ts", "blocked"]).fillna({"browser": False, "status": 0}).withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    return timed.groupBy("host").transformWithStateInPandas(Host(memory), "host string, blocks long, browser_first boolean, blocked boolean", "update", "eventtime")
