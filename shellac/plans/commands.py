"""The user-callable surface. Every command is a function of a snapshot: reading ones return rows, changing ones a new
snapshot, and the keyed state is read from events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellac.functions.text import changed_fields
from shellac.operators import browse, dml, ingest, render, search, state
from shellac.schema import Dimension
from shellac.sources.catalogue import Catalogue


def _one(c: Catalogue, schema: str, *row) -> DataFrame:
    return c.tracks.sparkSession.createDataFrame([row], schema)


def play(c: Catalogue, text: str, fetch: ingest.Fetch | None = None) -> tuple[Catalogue, DataFrame]:
    """The catalogue and the track that an input names. One that isn't known is fetched and inserted; ``LookupError`` without a
    ``fetch``, ``ValueError`` if the input can't be downloaded."""
    asked = _one(c, "input string", text)
    known, missing = ingest.resolve(c, asked)
    if not known.isEmpty():
        return c, known
    row = missing.first()
    if not row["valid"]:
        raise ValueError("not a video link")
    if fetch is None:
        raise LookupError(f"{row['id']} must be downloaded first")
    return ingest.resolve_or_fetch(c, asked, fetch)


def download(c: Catalogue, record: DataFrame, artist: str | None = None, origin: str | None = None, title: str | None = None) -> Catalogue:
    """Insert a download record (id, upload_date, title), with names of one's own."""
    own = {"artist": artist, "origin": origin, "track_title": title}
    return dml.insert_downloads(c, record.withColumns({k: F.lit(v).cast("string") for k, v in own.items()}))


def add_tag(c: Catalogue, track_id: str, tag: str) -> Catalogue:
    return dml.add_tags(c, _one(c, "track_id string, tag string", track_id, tag))


def fix(c: Catalogue, track_id: str, title: str | None = None, artist: str | None = None, origin: str | None = None) -> tuple[Catalogue, str]:
    """Set any of three fields; also tells which ones, or that there are none."""
    patch = _one(c, "id string, title string, artist string, origin string", track_id, title, artist, origin)
    if title is None and artist is None and origin is None:
        return c, "no changes"
    said = patch.select(changed_fields(title=F.col("title"), artist=F.col("artist"), origin=F.col("origin")).alias("s")).first()["s"]
    return dml.patch_tracks(c, patch), said


COMMANDS: dict[str, Callable] = {
    "library": render.library_pages,
    "play": play,
    "now_playing": state.now_playing,
    "leave": state.leave,
    "pause": lambda events, guild, ts: state.flip(events, guild, state.PAUSE, ts),
    "loop_track": lambda events, guild, ts: state.flip(events, guild, state.LOOP, ts),
    "player": state.toggles,
    "download": download,
    "reset_tags": dml.reset_tags,
    "add_tag": add_tag,
    "set_title": dml.update_title,
    "set_artist": lambda c, track_id, name: dml.update_name(c, Dimension.ARTIST, track_id, name),
    "set_origin": lambda c, track_id, name: dml.update_name(c, Dimension.ORIGIN, track_id, name),
    "fix": fix,
    "complete_track": search.complete_tracks,
    "complete_incomplete": search.complete_incomplete,
    "complete_name": search.complete_names,
    "lookup": browse.require,
}
