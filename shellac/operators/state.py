"""State by key from events: what plays now (last write wins) and two toggles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLAY, LEAVE, PAUSE, LOOP = "play", "leave", "pause", "loop"


def now_playing(events: DataFrame) -> DataFrame:
    """What each guild plays after all events (guild, ts, seq, kind, track): guild, track, ts.

    The last play or leave by (ts, seq) decides; a guild that left has no row. One aggregate with a map side, so a hot
    guild is no hot task.
    """
    last = F.max_by(F.struct("kind", "track", "ts"), F.struct("ts", "seq"))
    decided = events.where(F.col("kind").isin(PLAY, LEAVE)).groupBy("guild").agg(last.alias("e"))
    return decided.where(F.col("e.kind") == PLAY).select("guild", F.col("e.track").alias("track"), F.col("e.ts").alias("ts"))


def require_now_playing(events: DataFrame, guild) -> DataFrame:
    """The row of one guild, or a ``LookupError``."""
    found = now_playing(events.where(F.col("guild") == F.lit(guild)))
    if found.isEmpty():
        raise LookupError(f"nothing plays in {guild!r}")
    return found


def append(events: DataFrame, guild, kind: str, ts) -> DataFrame:
    """The events with one more, the last of all by sequence number."""
    last = events.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("seq"))
    types = dict(events.dtypes)
    new = last.select(F.lit(guild).cast(types["guild"]).alias("guild"), F.lit(ts).cast(types["ts"]).alias("ts"), (F.col("seq") + 1).cast(types["seq"]).alias("seq"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("track"))
    return events.unionByName(new)


def leave(events: DataFrame, guild, ts) -> DataFrame:
    """The events after a guild has left; one that plays nothing may leave too."""
    return append(events, guild, LEAVE, ts)


def flip(events: DataFrame, guild, kind: str, ts) -> tuple[DataFrame, DataFrame]:
    """The events after one toggle of a guild is flipped, and the guild's new state (a row of ``toggles``); a ``LookupError`` if it
    plays nothing."""
    require_now_playing(events, guild)
    after = append(events, guild, kind, ts)
    return after, toggles(after.where(F.col("guild") == F.lit(guild)))


def toggles(events: DataFrame) -> DataFrame:
    """State of the toggles of each guild that plays: guild, paused, looping.

    Both start anew with each play: not paused, looping. Each pause or loop event after it flips its own.
    """
    start = now_playing(events).select("guild").join(
        events.where(F.col("kind") == PLAY).groupBy("guild").agg(F.max(F.struct("ts", "seq")).alias("since")), "guild"
    )
    after = events.where(F.col("kind").isin(PAUSE, LOOP)).join(start, "guild", "right").where(F.col("kind").isNull() | (F.struct("ts", "seq") > F.col("since")))
    flips = lambda kind: F.count_if(F.col("kind") == kind) % 2
    counted = after.groupBy("guild").agg(flips(PAUSE).alias("p"), flips(LOOP).alias("l"))
    return start.join(counted, "guild", "left").select("guild", F.coalesce(F.col("p") == 1, F.lit(False)).alias("paused"), F.coalesce(F.col("l") == 0, F.lit(True)).alias("looping"))
