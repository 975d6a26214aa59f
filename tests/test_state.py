"""Keyed state, in batch and from a stream."""

import datetime as dt

import pytest

from shellac.operators import state
from shellac.plans.commands import COMMANDS
from shellac.streaming.now_playing import stream_now_playing

SCHEMA = "guild long, ts timestamp_ntz, seq long, kind string, track string"


def events():
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    return [
        (1, t(0), 1, "play", "a"), (1, t(1), 2, "pause", None), (1, t(2), 3, "play", "b"), (1, t(3), 4, "loop", None),
        (2, t(0), 5, "play", "c"), (2, t(1), 6, "leave", None),
        (3, t(5), 7, "play", "d"), (3, t(5), 8, "play", "e"), (3, t(6), 9, "pause", None), (3, t(6), 10, "pause", None), (3, t(7), 11, "pause", None),
        (4, t(0), 12, "pause", None),
    ]


def test_last_play_wins_and_leaving_removes(spark):
    got = {r["guild"]: r["track"] for r in state.now_playing(spark.createDataFrame(events(), SCHEMA)).collect()}
    assert got == {1: "b", 3: "e"}


def test_require(spark):
    df = spark.createDataFrame(events(), SCHEMA)
    assert state.require_now_playing(df, 1).first()["track"] == "b"
    with pytest.raises(LookupError):
        state.require_now_playing(df, 2)


def test_commands_append_events(spark):
    df = spark.createDataFrame(events(), SCHEMA)
    later = dt.datetime(2025, 1, 1)
    after, now = COMMANDS["pause"](df, 1, later)
    assert [tuple(r) for r in now.collect()] == [(1, True, False)] and after.count() == df.count() + 1
    again, now = COMMANDS["loop_track"](after, 1, later)
    assert [tuple(r) for r in now.collect()] == [(1, True, True)]
    gone = COMMANDS["leave"](again, 1, later)
    assert {r["guild"] for r in state.now_playing(gone).collect()} == {3}
    with pytest.raises(LookupError):
        COMMANDS["pause"](gone, 1, later)


def test_toggles_start_anew_with_each_play(spark):
    got = {r["guild"]: (r["paused"], r["looping"]) for r in state.toggles(spark.createDataFrame(events(), SCHEMA)).collect()}
    assert got == {1: (False, False), 3: (True, True)}


def test_stream_ends_where_the_batch_does(spark, tmp_path):
    rows = events()
    for i, part in enumerate((rows[7:], rows[:4], rows[4:7])):  # late and out of order
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_now_playing(source).writeStream.outputMode("update").format("memory").queryName("playing").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last: dict = {}
    for r in spark.sql("SELECT * FROM playing").collect():
        last[r["guild"]] = r  # rows of a guild come in the order of their batches
    assert {g: r["track"] for g, r in last.items() if r["playing"]} == {1: "b", 3: "e"}
