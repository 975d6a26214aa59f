"""Fixed schemas, sentinel texts and presentation constants of the catalogue."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T

# Fixed values of the data model, matched by text.
NO_ARTIST, NO_ORIGIN = "No artist provided", "No origin provided"
NO_TAGS, UNKNOWN_DATE, UNKNOWN_TITLE = "No tags", "Unknown Date", "Unknown Title"
MISSING_TITLE, MISSING_ARTIST, MISSING_ORIGIN = "No title", "No artist", "No origin"
SEARCH_LIMIT, PAGE_SIZE, TITLE_CHARS, META_CHARS = 25, 15, 36, 40
DISPLAY_BYTES, ELLIPSIS, SEPARATOR = 100, "…", " | "
FETCH_CONCURRENCY, FETCH_ATTEMPTS, BACKOFF_MS = 4, 3, 200


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


TRACKS = _table(("id", T.StringType()), ("upload_date", T.StringType()), ("yt_title", T.StringType()), ("track_title", T.StringType()), ("artist_id", T.LongType()), ("origin_id", T.LongType()))
ARTISTS = _table(("id", T.LongType()), ("artist", T.StringType()))
ORIGINS = _table(("id", T.LongType()), ("origin", T.StringType()))
TAGS = _table(("id", T.LongType()), ("tag", T.StringType()))
TRACK_TAGS = _table(("track_id", T.StringType()), ("tag_id", T.LongType()))
TABLES = {"tracks": TRACKS, "artists": ARTISTS, "origins": ORIGINS, "tags": TAGS, "track_tags": TRACK_TAGS}

INGEST = _table(
    ("id", T.StringType()), ("upload_date", T.StringType()), ("yt_title", T.StringType()), ("track_title", T.StringType()),
    ("track_artist", T.StringType()), ("track_origin", T.StringType()), ("tags", T.ArrayType(T.StringType())),
)
DOWNLOAD_KEYS = ("id", "upload_date", "title", "channel")
TRACK_INFO = _table(("id", T.StringType()), ("title", T.StringType()), ("artist", T.StringType()), ("origin", T.StringType()))


class Dimension(Enum):
    """A dictionary table and the column that holds its names."""

    ARTIST = ("artists", "artist")
    ORIGIN = ("origins", "origin")
    TAG = ("tags", "tag")

    @property
    def table(self) -> str:
        return self.value[0]

    @property
    def column(self) -> str:
        return self.value[1]
