"""What plays now, kept up to date from a stream of events (an extension of the batch form)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shellac.operators.state import LEAVE, PLAY

OUTPUT = "guild long, track string, ts timestamp_ntz, playing boolean"
STATE = "ts timestamp_ntz, seq long, kind string, track string"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best = state.get if state.exists else None
    for b in batches:
        for e in b[b["kind"].isin([PLAY, LEAVE])].itertuples(index=False):
            if best is None or (e.ts, e.seq) >= (best[0], best[1]):
                best = (e.ts, int(e.seq), e.kind, e.track)
    if best is not None:
        state.update(best)
        yield pd.DataFrame({"guild": [key[0]], "track": [best[3]], "ts": [best[0]], "playing": [best[2] == PLAY]})


def stream_now_playing(events: DataFrame) -> DataFrame:
    """A stream of changes (guild, track, ts, playing), in update mode: the state of each guild that a batch touches.

    Events (guild, ts, seq, kind, track) may come late or out of order: the last by (ts, seq) wins, whenever it comes.
    """
    return events.groupBy("guild").applyInPandasWithState(_update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
