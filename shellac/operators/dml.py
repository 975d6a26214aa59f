"""Changes of a catalogue as functions from snapshot to snapshot. Nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shellac.operators.browse import require
from shellac.operators.numbering import number_rows
from shellac.schema import NO_ARTIST, NO_ORIGIN, UNKNOWN_DATE, UNKNOWN_TITLE, Dimension
from shellac.sources.catalogue import Catalogue


def encode_names(dimension: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """The dimension with every new name of ``names`` (one column) added, once, by exact text. Ids go on from the greatest
    one in order of the names; null names are left out."""
    new = names.select(F.col(names.columns[0]).alias(column)).where(F.col(column).isNotNull()).distinct().join(dimension.select(column), column, "left_anti")
    start = dimension.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_start"))  # one row
    numbered = number_rows(new, [column], "_n").join(F.broadcast(start))
    return dimension.unionByName(numbered.select((F.col("_start") + F.col("_n")).cast("long").alias("id"), column))


def add_names(c: Catalogue, kind: Dimension, names: DataFrame) -> Catalogue:
    """Get or insert names of a dimension."""
    return c.with_tables(**{kind.table: encode_names(c.dimension(kind), kind.column, names)})


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The old rows and those new ones whose key is not there yet; of new rows with one key, one is kept."""
    fresh = new.dropDuplicates(key).join(old.select(*key), key, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def insert_tracks(c: Catalogue, new: DataFrame) -> Catalogue:
    """Insert tracks (id, upload_date, yt_title, track_title, artist_id, origin_id); an id that is there or comes twice
    raises ``ValueError``. Null dates and titles get their defaults."""
    clash = new.join(c.tracks.select("id"), "id", "left_semi").select("id").union(new.groupBy("id").count().where("count > 1").select("id"))
    if not clash.isEmpty():
        raise ValueError(f"track id {clash.first()['id']!r} is there already")
    rows = new.withColumns({"upload_date": F.coalesce("upload_date", F.lit(UNKNOWN_DATE)), "yt_title": F.coalesce("yt_title", F.lit(UNKNOWN_TITLE)), "track_title": F.coalesce("track_title", "yt_title", F.lit(UNKNOWN_TITLE))})
    return c.with_tables(tracks=c.tracks.unionByName(rows.select(*c.tracks.columns)))


def insert_downloads(c: Catalogue, downloads: DataFrame) -> Catalogue:
    """Insert downloaded records (id, upload_date, title, and optionally track_title, artist, origin), with the names that
    they bring; missing names become the sentinels."""
    def given(name: str) -> Column:
        return F.col(name) if name in downloads.columns else F.lit(None).cast("string")

    rows = downloads.select(
        "id", "upload_date", F.coalesce("title", F.lit(UNKNOWN_TITLE)).alias("yt_title"), F.coalesce(given("track_title"), "title", F.lit(UNKNOWN_TITLE)).alias("track_title"),
        F.coalesce(given("artist"), F.lit(NO_ARTIST)).alias("artist"), F.coalesce(given("origin"), F.lit(NO_ORIGIN)).alias("origin"),
    )
    c = add_names(add_names(c, Dimension.ARTIST, rows.select("artist")), Dimension.ORIGIN, rows.select("origin"))
    return insert_tracks(c, with_name_ids(rows, c))


def with_name_ids(rows: DataFrame, c: Catalogue) -> DataFrame:
    """Replace artist and origin names by the ids of their rows."""
    rows = rows.join(c.artists.withColumnRenamed("id", "artist_id"), "artist").join(c.origins.withColumnRenamed("id", "origin_id"), "origin")
    return rows.drop("artist", "origin")


def add_tags(c: Catalogue, pairs: DataFrame) -> Catalogue:
    """Tag tracks (track_id, tag): new tags enter the dictionary, pairs that are there stay as they are."""
    c = add_names(c, Dimension.TAG, pairs.select("tag"))
    bridge = pairs.join(c.tags.withColumnRenamed("id", "tag_id"), "tag").select("track_id", "tag_id")
    return c.with_tables(track_tags=insert_or_ignore(c.track_tags, bridge, ["track_id", "tag_id"]))


def delete_tags(c: Catalogue, ids: DataFrame) -> Catalogue:
    """Remove all tags of the tracks in ``ids`` (id); the tags themselves stay in the dictionary."""
    gone = ids.select(F.col("id").alias("track_id"))
    return c.with_tables(track_tags=c.track_tags.join(gone, "track_id", "left_anti").select(*c.track_tags.columns))


def reset_tags(c: Catalogue, track_id: str) -> Catalogue:
    """Remove all tags of one track, which must exist."""
    return delete_tags(c, require(c, track_id).select("id"))


def update_column(c: Catalogue, track_id: str, column: str, value: Column) -> Catalogue:
    """Set one column of one track; an id that is not there changes nothing."""
    return c.with_tables(tracks=c.tracks.withColumn(column, F.when(F.col("id") == track_id, value).otherwise(F.col(column))))


def update_title(c: Catalogue, track_id: str, title: str) -> Catalogue:
    return update_column(c, track_id, "track_title", F.lit(title))


def update_name(c: Catalogue, kind: Dimension, track_id: str, name: str) -> Catalogue:
    """Give one track another artist or origin, new ones included."""
    spark = c.tracks.sparkSession
    return patch_tracks(c, spark.createDataFrame([(track_id, name)], f"id string, {kind.column} string"))


def patch_tracks(c: Catalogue, patch: DataFrame) -> Catalogue:
    """Set any of title, artist and origin of the tracks in ``patch`` (id and some of these); nulls leave a field as it is.

    Of several rows with one id the greatest value of each field counts; ids that are not there change nothing, yet their
    names enter the dictionaries.
    """
    given = [x for x in ("title", "artist", "origin") if x in patch.columns]
    patch = patch.groupBy("id").agg(*[F.max(x).alias(f"_{x}") for x in given])
    for kind in (Dimension.ARTIST, Dimension.ORIGIN):
        if kind.column in given:
            c = add_names(c, kind, patch.select(f"_{kind.column}"))
            patch = patch.join(c.dimension(kind).select(F.col("id").alias(f"_{kind.column}_id"), F.col(kind.column).alias(f"_{kind.column}")), f"_{kind.column}", "left")
    tracks = c.tracks.join(patch, "id", "left")
    new = {"track_title": "_title", "artist_id": "_artist_id", "origin_id": "_origin_id"}
    tracks = tracks.withColumns({column: F.coalesce(own, column) for column, own in new.items() if own in tracks.columns})
    return c.with_tables(tracks=tracks.select(*c.tracks.columns))


def cascade(c: Catalogue) -> Catalogue:
    """Drop what refers to rows that are gone: tracks without artist or origin, then bridge rows without track or tag."""
    tracks = c.tracks.join(c.artists.select(F.col("id").alias("artist_id")), "artist_id", "left_semi").join(c.origins.select(F.col("id").alias("origin_id")), "origin_id", "left_semi")
    bridge = c.track_tags.join(tracks.select(F.col("id").alias("track_id")), "track_id", "left_semi").join(c.tags.select(F.col("id").alias("tag_id")), "tag_id", "left_semi")
    return c.with_tables(tracks=tracks.select(*c.tracks.columns), track_tags=bridge.select(*c.track_tags.columns))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
