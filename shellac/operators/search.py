"""Substring search with bounded results, and the result lists that a prompt shows.

Results are the first by id (or by name) up to the limit; a result list is sorted by its text only after that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellac.functions.text import any_matches, fit_fields, matches, trim_bytes
from shellac.operators.browse import is_incomplete, tag_list, with_artist, with_origin, with_tags
from shellac.operators.numbering import number_rows
from shellac.schema import NO_TAGS, SEARCH_LIMIT, Dimension
from shellac.sources.catalogue import Catalogue


def search_dimension(c: Catalogue, kind: Dimension, needle: str, limit: int = SEARCH_LIMIT, fold: str = "ascii") -> DataFrame:
    """Distinct names of a dimension that contain the needle."""
    name = F.col(kind.column)
    return c.dimension(kind).where(matches(name, needle, fold)).select(name.alias("name")).distinct().orderBy("name").limit(limit)


def _named(c: Catalogue) -> DataFrame:
    return with_origin(with_artist(c.tracks.select("id", "track_title", "artist_id", "origin_id"), c), c)


def search_tracks(c: Catalogue, needle: str, limit: int = SEARCH_LIMIT, fold: str = "ascii") -> DataFrame:
    """Tracks whose title, artist, origin or a tag contains the needle.

    The filter stands before the aggregation: a track that is found through a tag alone shows its matching tags, one
    that is found through another field shows all.
    """
    own = any_matches([F.col(x) for x in ("track_title", "artist", "origin")], needle, fold)
    rows = with_tags(_named(c), c).where(own | matches(F.col("tag"), needle, fold))
    found = rows.groupBy("id", "track_title", "artist", "origin").agg(tag_list())
    return found.orderBy("id").limit(limit)


def search_incomplete(c: Catalogue, needle: str, limit: int = SEARCH_LIMIT, fold: str = "ascii") -> DataFrame:
    """Tracks without a known artist or origin whose title, artist or origin contains the needle, with all their tags."""
    own = any_matches([F.col(x) for x in ("track_title", "artist", "origin")], needle, fold)
    first = _named(c).where(is_incomplete() & own).orderBy("id").limit(limit)
    return with_tags(first, c).groupBy("id", "track_title", "artist", "origin").agg(tag_list())


def complete_names(c: Catalogue, kind: Dimension, needle: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """The result list of a dimension: each name cut to the display width, in order of what is shown."""
    shown = search_dimension(c, kind, needle, limit).select("name", trim_bytes(F.col("name")).alias("display"))
    return number_rows(shown, ["display", "name"]).select("pos", "display")


def _listed(found: DataFrame) -> DataFrame:
    fields = F.array("track_title", F.coalesce("artist", F.lit("")), F.coalesce("origin", F.lit("")), F.coalesce("tags", F.lit(NO_TAGS)))
    shown = found.select("id", fit_fields(fields).alias("display"))
    return number_rows(shown, ["display", "id"]).select("pos", "display", "id")


def complete_tracks(c: Catalogue, needle: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """The result list of ``search_tracks``: title, artist, origin and tags in one line, and the id it stands for."""
    return _listed(search_tracks(c, needle, limit))


def complete_incomplete(c: Catalogue, needle: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """The result list of ``search_incomplete``."""
    return _listed(search_incomplete(c, needle, limit))
