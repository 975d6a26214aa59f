"""Browse views: the whole catalogue in five fixed orders.

Missing names are replaced by texts that differ from the sentinels. The orders end in title and id, so they are total. Every
view numbers its rows (pos); with a name for ``total`` each row also holds their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellac.operators.numbering import number_rows
from shellac.schema import MISSING_ARTIST, MISSING_ORIGIN, MISSING_TITLE, NO_ARTIST, NO_ORIGIN, NO_TAGS
from shellac.sources.catalogue import Catalogue


def with_artist(rows: DataFrame, c: Catalogue) -> DataFrame:
    """Add artist; a track without its artist row keeps a null."""
    return rows.join(c.artists.withColumnRenamed("id", "artist_id"), "artist_id", "left")


def with_origin(rows: DataFrame, c: Catalogue) -> DataFrame:
    """Add origin; a track without its origin row keeps a null."""
    return rows.join(c.origins.withColumnRenamed("id", "origin_id"), "origin_id", "left")


def with_tags(rows: DataFrame, c: Catalogue) -> DataFrame:
    """One row for each track and tag, and one with a null tag for a track without tags."""
    bridge = c.track_tags.withColumnRenamed("track_id", "id")
    return rows.join(bridge, "id", "left").join(c.tags.withColumnRenamed("id", "tag_id"), "tag_id", "left")


def tag_list(tag: str = "tag") -> Column:
    """Tags in code-point order, joined by a comma; null when all are null."""
    return F.expr(f"listagg({tag}, ', ') WITHIN GROUP (ORDER BY {tag})").alias("tags")


def tag_lists(c: Catalogue) -> DataFrame:
    """The tag list of each tagged track: id, tags. The bridge alone is shuffled, not the titles."""
    named = c.track_tags.join(c.tags.withColumnRenamed("id", "tag_id"), "tag_id")
    return named.groupBy(F.col("track_id").alias("id")).agg(tag_list())


def _or(c: str, text: str) -> Column:
    return F.coalesce(F.col(c), F.lit(text)).alias(c)


def _total(name: str | None) -> list[Column]:
    return [F.col(name).cast("long").alias(name)] if name else []


def browse_all(c: Catalogue, total: str | None = None) -> DataFrame:
    """All tracks with their tags, by title."""
    tracks = c.tracks.select("id", "track_title", "artist_id", "origin_id")
    rows = with_origin(with_artist(tracks, c), c).join(tag_lists(c), "id", "left")
    return number_rows(rows, ["track_title", "id"], total=total).select("pos", *_total(total), "id", _or("track_title", MISSING_TITLE), _or("artist", MISSING_ARTIST), _or("origin", MISSING_ORIGIN), _or("tags", ""))


def browse_artists(c: Catalogue, total: str | None = None) -> DataFrame:
    """All tracks by artist; those without an artist row come first."""
    rows = with_artist(c.tracks.select("id", "track_title", "artist_id"), c)
    return number_rows(rows, ["artist", "track_title", "id"], total=total).select("pos", *_total(total), "id", _or("artist", MISSING_ARTIST), _or("track_title", MISSING_TITLE))


def browse_origins(c: Catalogue, total: str | None = None) -> DataFrame:
    """All tracks by origin; those without an origin row come first."""
    rows = with_origin(c.tracks.select("id", "track_title", "origin_id"), c)
    return number_rows(rows, ["origin", "track_title", "id"], total=total).select("pos", *_total(total), "id", _or("origin", MISSING_ORIGIN), _or("track_title", MISSING_TITLE))


def browse_tags(c: Catalogue, total: str | None = None) -> DataFrame:
    """One row for each track and tag, by tag; tracks without tags come last, once."""
    rows = with_tags(c.tracks.select("id", "track_title"), c)
    return number_rows(rows, [F.col("tag").asc_nulls_last(), "track_title", "id"], total=total).select("pos", *_total(total), "id", _or("tag", NO_TAGS), _or("track_title", MISSING_TITLE))


def is_incomplete() -> Column:
    """Whether the artist or the origin is the sentinel, by text."""
    return (F.col("artist") == NO_ARTIST) | (F.col("origin") == NO_ORIGIN)


def browse_incomplete(c: Catalogue, total: str | None = None) -> DataFrame:
    """Tracks whose artist or origin is not known, by artist and origin."""
    rows = with_origin(with_artist(c.tracks.select("id", "track_title", "artist_id", "origin_id"), c), c).where(is_incomplete())
    return number_rows(rows, ["artist", "origin", "track_title", "id"], total=total).select("pos", *_total(total), "id", _or("track_title", MISSING_TITLE), _or("artist", MISSING_ARTIST), _or("origin", MISSING_ORIGIN))


MODES: dict[str, Callable[..., DataFrame]] = {
    "all": browse_all,
    "artist": browse_artists,
    "origin": browse_origins,
    "tags": browse_tags,
    "incomplete": browse_incomplete,
}


def browse(c: Catalogue, mode: str, total: str | None = None) -> DataFrame:
    """The view of a mode; on demand each row also tells how many there are, under the name ``total``."""
    return MODES[mode](c, total)


def lookup(c: Catalogue, track_id: str) -> DataFrame:
    """Id, title, artist and origin of one track; no row if there is none."""
    track = c.tracks.where(F.col("id") == track_id).select("id", "track_title", "artist_id", "origin_id")
    return with_origin(with_artist(track, c), c).select("id", F.col("track_title").alias("title"), "artist", "origin")


def require(c: Catalogue, track_id: str) -> DataFrame:
    """``lookup``, or a ``LookupError`` if there is no such track."""
    found = lookup(c, track_id)
    if found.isEmpty():
        raise LookupError(f"no track {track_id!r}")
    return found
