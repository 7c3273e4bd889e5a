import pytest

from brindle.streaming import timed
from tests.test_streams_and_sinks import drained, stream


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def later(rows):
    """Times moved off 0, the watermark that a stream starts with."""
    return [(r[0], r[1], r[2] + 1_000_000, *r[3:]) for r in rows]


CALLS = "provider string, id long, ts long, ok boolean"
OUTCOMES = "host string, id long, ts long, blocked boolean, status int, browser boolean"


def test_breaker_half_opens_and_opens_anew(rocks, tmp_path):
    rows = [("p", 1, 0, False), ("p", 2, 10, False), ("p", 3, 20, True), ("p", 4, 105, False), ("p", 5, 120, True), ("q", 6, 130, True)]
    got = drained(rocks, timed.guarded(stream(rocks, later(rows), CALLS, tmp_path, 3), 2, 90), tmp_path, "append")
    assert {r["id"]: r["state"] for r in got if r["id"] is not None} == {1: "closed", 2: "closed", 3: "open", 4: "closed", 5: "closed", 6: "closed"}


def test_the_end_of_a_cool_down_is_told_without_a_call(rocks, tmp_path):
    rows = [("p", 1, 1, False), ("p", 2, 10, False), ("p", 3, 50, False), ("p", 4, 100, False), ("q", 5, 300, True), ("q", 6, 301, True), ("q", 7, 320, True), ("q", 8, 321, True), ("p", 9, 330, False), ("p", 10, 340, True)]
    got = drained(rocks, timed.guarded(stream(rocks, later(rows), CALLS, tmp_path, 5), 2, 90), tmp_path, "append")
    states = {1: "closed", 2: "closed", 3: "open", 4: "half_open", 5: "closed", 6: "closed", 7: "closed", 8: "closed", 9: "half_open", 10: "open"}
    assert {r["id"]: r["state"] for r in got if r["id"] is not None} == states
    assert [(r["provider"], r["state"]) for r in got if r["id"] is None] == [("p", "half_open")]  # 190 passed while only q was called


def test_hosts_are_forgotten(rocks, tmp_path):
    rows = [("a", 1, 0, True, 500, False), ("b", 2, 5, True, 403, False), ("a", 3, 10, True, 500, False), ("b", 4, 20, False, 200, True), ("c", 5, 2000, False, 200, False), ("b", 6, 2100, True, 500, False)]
    got = drained(rocks, timed.remembered(stream(rocks, later(rows), OUTCOMES, tmp_path, 3), 1000), tmp_path, "update")
    seen = [(r["host"], r["blocks"], r["browser_first"], r["blocked"]) for r in got]
    assert ("a", 1, False, True) in seen and ("a", 2, True, True) in seen
    assert ("b", 1, True, True) in seen and ("b", 0, True, False) in seen  # a success by a browser keeps the wish for one
    assert ("a", 0, False, False) in seen and ("b", 1, False, True) in seen  # forgotten, and counted from none


def test_null_keys_and_empty_streams(rocks, tmp_path):
    assert drained(rocks, timed.guarded(stream(rocks, [(None, 1, 1, False), ("p", None, 1, True), ("p", 1, None, True), ("p", 1, 1, None)], CALLS, tmp_path, 1)), tmp_path, "append") == []
    rows = [("h", 1, 1, True, None, None), ("h", 2, None, True, 403, False), (None, 3, 3, True, 403, False)]
    got = drained(rocks, timed.remembered(stream(rocks, rows, OUTCOMES, tmp_path / "b", 1)), tmp_path / "b", "update")
    assert [(r["host"], r["blocks"], r["browser_first"], r["blocked"]) for r in got] == [("h", 1, False, True)]
