"""Batch ingest of track records, and resolving of inputs against the catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellac.functions.text import normalise_input, video_id
from shellac.operators.dml import add_names, add_tags, insert_downloads, insert_or_ignore, latest, with_name_ids
from shellac.schema import NO_ARTIST, NO_ORIGIN, Dimension
from shellac.sources.catalogue import Catalogue


def ingest(c: Catalogue, records: DataFrame, split_ws: bool = False, order: Column | None = None) -> Catalogue:
    """Add records (the ingest schema) in one batch.

    The first record of an id that is new makes the track, by ``order`` (its default: date, then titles); an id that is
    there keeps its row. Tags of all records are added either way. Missing artists and origins become the sentinels,
    missing ids, dates and titles the text ``null``. ``split_ws`` makes a tag of every word.
    """
    text = lambda x: F.coalesce(x, F.lit("null")).alias(x)
    rows = records.select(
        text("id"), text("upload_date"), text("yt_title"), text("track_title"),
        F.coalesce("track_artist", F.lit(NO_ARTIST)).alias("artist"), F.coalesce("track_origin", F.lit(NO_ORIGIN)).alias("origin"), "tags",
    )
    c = add_names(add_names(c, Dimension.ARTIST, rows.select("artist")), Dimension.ORIGIN, rows.select("origin"))
    keyed = with_name_ids(rows.drop("tags"), c)
    first = latest(keyed, ["id"], [order] if order is not None else [F.col(x) for x in ("upload_date", "yt_title", "track_title", "artist_id", "origin_id")])
    c = c.with_tables(tracks=insert_or_ignore(c.tracks, first, ["id"]))
    tags = rows.select(F.col("id").alias("track_id"), F.explode("tags").alias("tag")).where(F.col("tag").isNotNull())
    if split_ws:
        tags = tags.select("track_id", F.explode(F.split("tag", r"\s+")).alias("tag")).where("tag <> ''")
    return add_tags(c, tags)


#: From a table of ids to download records (id, upload_date, title) of those that could be had.
Fetch = Callable[[DataFrame], DataFrame]


def resolve_or_fetch(c: Catalogue, inputs: DataFrame, fetch: Fetch, column: str = "input") -> tuple[Catalogue, DataFrame]:
    """Resolve inputs, fetch the missing ones that can be downloaded, each id once, and insert what comes: the catalogue after it,
    and the known rows of all inputs."""
    ids = resolve(c, inputs, column)[1].where("valid").select("id").distinct()
    after = insert_downloads(c, fetch(ids))
    return after, resolve(after, inputs, column)[0]


def resolve(c: Catalogue, inputs: DataFrame, column: str = "input") -> tuple[DataFrame, DataFrame]:
    """Split inputs (URLs or ids) into known ones, with their track, and missing ones.

    Known: input, id, title, artist, origin. Missing: input, id, valid; only an input that is a video URL is valid, any
    other can't be downloaded.
    """
    from shellac.operators.browse import with_artist, with_origin

    keyed = inputs.select(F.col(column).alias("input"), normalise_input(F.col(column)).alias("id"), video_id(F.col(column)).isNotNull().alias("valid"))
    tracks = with_origin(with_artist(c.tracks.select("id", "track_title", "artist_id", "origin_id"), c), c)
    known = keyed.join(tracks, "id").select("input", "id", F.col("track_title").alias("title"), "artist", "origin")
    return known, keyed.join(c.tracks.select("id"), "id", "left_anti").select("input", "id", "valid")
