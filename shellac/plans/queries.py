"""The catalogue's queries over the shared test tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellac.functions import text
from shellac.operators import browse, dml, ingest, render, search, state, sync
from shellac.schema import Dimension
from shellac.sources.adapters import adapted, oracle_views
from shellac.sources.catalogue import Catalogue, empty_catalogue
from shellac.sources.files import present_ids
from shellac.sources.json_files import parse_download, parse_ingest, read_ingest
from shellac.storage import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_Over = Callable[[Catalogue], DataFrame]


def _add(name: str, run: _Over, sql: str | None = None, adapter: str = "documents") -> None:
    QUERIES[name] = lambda spark, sf_dir: run(adapted(spark, sf_dir, adapter))
    if sql:
        ORACLES[name] = f"{oracle_views(adapter)}{sql}"


_NAMED = """, named AS (SELECT t.*, a.artist, o.origin FROM tracks t LEFT JOIN artists a ON t.artist_id = a.id LEFT JOIN origins o ON t.origin_id = o.id)
, tagged AS (SELECT n.*, g.tag FROM named n LEFT JOIN track_tags b ON b.track_id = n.id LEFT JOIN tags g ON g.id = b.tag_id)
, listed AS (SELECT id, track_title, artist, origin, string_agg(tag, ', ' ORDER BY tag) AS tags FROM tagged GROUP BY ALL)"""
_ALL = """, rows_ AS (SELECT cast(row_number() OVER (ORDER BY track_title NULLS FIRST, id) AS integer) AS pos, id, coalesce(track_title, 'No title') AS track_title,
  coalesce(artist, 'No artist') AS artist, coalesce(origin, 'No origin') AS origin, coalesce(tags, '') AS tags FROM listed)"""
_BY = {
    k: f""", rows_ AS (SELECT cast(row_number() OVER (ORDER BY {k} NULLS FIRST, track_title NULLS FIRST, id) AS integer) AS pos, id, coalesce({k}, 'No {k}') AS {k},
  coalesce(track_title, 'No title') AS track_title FROM named)"""
    for k in ("artist", "origin")
}
_BY["tag"] = """, rows_ AS (SELECT cast(row_number() OVER (ORDER BY tag NULLS LAST, track_title NULLS FIRST, id) AS integer) AS pos, id, coalesce(tag, 'No tags') AS tag,
  coalesce(track_title, 'No title') AS track_title FROM tagged)"""
_INCOMPLETE = """, rows_ AS (SELECT cast(row_number() OVER (ORDER BY artist, origin, track_title NULLS FIRST, id) AS integer) AS pos, id, coalesce(track_title, 'No title') AS track_title,
  artist, origin FROM named WHERE artist = 'No artist provided' OR origin = 'No origin provided')"""

for _adapter, _end in (("documents", ""), ("parts", "_parts")):
    _add(f"library_all{_end}", browse.browse_all, f"{_NAMED}{_ALL} SELECT * FROM rows_", _adapter)
    _add(f"library_by_artist{_end}", browse.browse_artists, f"{_NAMED}{_BY['artist']} SELECT * FROM rows_", _adapter)
    _add(f"library_by_origin{_end}", browse.browse_origins, f"{_NAMED}{_BY['origin']} SELECT * FROM rows_", _adapter)
    _add(f"library_by_tag{_end}", browse.browse_tags, f"{_NAMED}{_BY['tag']} SELECT * FROM rows_", _adapter)
    _add(f"library_incomplete{_end}", browse.browse_incomplete, f"{_NAMED}{_INCOMPLETE} SELECT * FROM rows_", _adapter)

_add("lookup_track", lambda c: browse.lookup(c, "7"), f"{_NAMED} SELECT id, track_title AS title, artist, origin FROM named WHERE id = '7'")
_add("lookup_missing", lambda c: browse.lookup(c, "no such id").agg(F.count("*").alias("n")), f"{_NAMED} SELECT count(*) AS n FROM named WHERE id = 'no such id'")
_add("require_track", lambda c: browse.require(c, "11"), f"{_NAMED} SELECT id, track_title AS title, artist, origin FROM named WHERE id = '11'")
_add("track_ids", lambda c: c.tracks.select("id"), " SELECT id FROM tracks")


# ---- search ----


def _fold(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _like(c: str, needle: str, fold: str = "ascii") -> str:
    folded, low = _fold(c) if fold == "ascii" else f"lower({c})", needle.lower().replace("'", "''")
    return f"{folded} LIKE '%{low}%'"


def _dimension_sql(table: str, column: str, needle: str) -> str:
    return f" SELECT DISTINCT {column} AS name FROM {table} WHERE {_like(column, needle)} ORDER BY name LIMIT 25"


def _tracks_sql(needle: str, fold: str = "ascii") -> str:
    found = " OR ".join(_like(c, needle, fold) for c in ("track_title", "artist", "origin", "tag"))
    return f"{_NAMED} SELECT id, track_title, artist, origin, string_agg(tag, ', ' ORDER BY tag) AS tags FROM tagged WHERE {found} GROUP BY id, track_title, artist, origin ORDER BY id LIMIT 25"


def _incomplete_sql(needle: str) -> str:
    found = " OR ".join(_like(c, needle) for c in ("track_title", "artist", "origin"))
    return f"{_NAMED} SELECT * FROM listed WHERE (artist = 'No artist provided' OR origin = 'No origin provided') AND ({found}) ORDER BY id LIMIT 25"


_add("search_artist", lambda c: search.search_dimension(c, Dimension.ARTIST, "SRC1"), _dimension_sql("artists", "artist", "SRC1"))
_add("search_origin", lambda c: search.search_dimension(c, Dimension.ORIGIN, "e"), _dimension_sql("origins", "origin", "e"))
_add("search_tag", lambda c: search.search_dimension(c, Dimension.TAG, "O"), _dimension_sql("tags", "tag", "O"))
for _name, _needle in {"search_tracks": "the", "search_tracks_by_tag": "toxic", "search_sentinel": "no artist", "search_wildcard": "a_d%e", "search_backslash": "a\\b", "search_empty_needle": "", "search_nonascii": "Étre"}.items():
    _add(_name, lambda c, n=_needle: search.search_tracks(c, n), _tracks_sql(_needle))
_add("search_unicode_fold", lambda c: search.search_tracks(c, "Étre", fold="unicode"), _tracks_sql("Étre", "unicode"))
_add("search_incomplete", lambda c: search.search_incomplete(c, "an"), _incomplete_sql("an"))
_add("search_tracks_parts", lambda c: search.search_tracks(c, "an"), _tracks_sql("an"), "parts")
_add("search_incomplete_parts", lambda c: search.search_incomplete(c, "e"), _incomplete_sql("e"), "parts")


# ---- rendering ----


def _trunc(c: str, most: int) -> str:
    return f"CASE WHEN length({c}) <= {most} THEN {c} ELSE left({c}, {most - 1}) || '…' END"


def _meta(*columns: str) -> str:
    kept = f"list_filter([{', '.join(columns)}], lambda p: p IS NOT NULL AND p NOT IN ('No artist provided', 'No origin provided', 'No tags', ''))"
    return f"array_to_string(list_transform({kept}, lambda p: {_trunc('p', 40)}), ' · ')"


_WIDTH = "length(cast((SELECT count(*) FROM rows_) AS varchar))"


def _entries(*meta: str) -> str:
    return f""", metas AS (SELECT *, coalesce({_meta(*meta)}, '') AS meta, {_WIDTH} AS width FROM rows_)
, entries AS (SELECT pos, lpad(cast(pos AS varchar), cast(width AS integer), ' ') || '. ' || {_trunc('track_title', 36)}
  || CASE WHEN meta = '' THEN '' ELSE chr(10) || repeat(' ', width + 4) || meta END || chr(10) AS entry FROM metas)"""


def _lines(key: str) -> str:
    return f""", marked AS (SELECT *, {_WIDTH} AS width, coalesce(lag({key}) OVER (ORDER BY pos), '') IS DISTINCT FROM {key} AS starts FROM rows_)
, grouped AS (SELECT *, sum(cast(starts AS integer)) OVER (ORDER BY pos) AS g FROM marked)
, spread AS (SELECT pos, unnest(CASE WHEN starts AND g > 1 THEN [1, 2, 3] WHEN starts THEN [2, 3] ELSE [3] END) AS part, {key} AS k, track_title, width FROM grouped)
, lines AS (SELECT cast(row_number() OVER (ORDER BY pos, part) AS integer) AS line_no, CASE part WHEN 1 THEN '' WHEN 2 THEN '── ' || {_trunc('k', 40)}
  ELSE '  ' || lpad(cast(pos AS varchar), cast(width AS integer), ' ') || '. ' || {_trunc('track_title', 36)} END AS line FROM spread)"""


def _pages(table: str, number: str, line: str) -> str:
    return f" SELECT cast(({number} - 1) // 15 + 1 AS integer) AS page, '```' || chr(10) || string_agg({line}, chr(10) ORDER BY {number}) || chr(10) || '```' AS body FROM {table} GROUP BY ALL"


_add("trunc_title", lambda c: c.tracks.select("id", text.trunc(F.col("track_title"), 36).alias("short")), f" SELECT id, {_trunc('track_title', 36)} AS short FROM tracks")
_add("meta_line", lambda c: browse.browse_all(c).select("id", text.meta_line(F.col("artist"), F.col("origin"), F.col("tags")).alias("meta")), f"{_NAMED}{_ALL} SELECT id, {_meta('artist', 'origin', 'tags')} AS meta FROM rows_")
_add("flat_entries", lambda c: render.flat_entries(browse.browse_all(c, "total"), "artist", "origin", "tags"), f"{_NAMED}{_ALL}{_entries('artist', 'origin', 'tags')} SELECT * FROM entries")
_add("grouped_lines", lambda c: render.grouped_lines(browse.browse_tags(c, "total"), "tag"), f"{_NAMED}{_BY['tag']}{_lines('tag')} SELECT * FROM lines")
_add("flat_pages", lambda c: render.library_pages(c, "all"), f"{_NAMED}{_ALL}{_entries('artist', 'origin', 'tags')}{_pages('entries', 'pos', 'entry')}")
_add("incomplete_pages", lambda c: render.library_pages(c, "incomplete"), f"{_NAMED}{_INCOMPLETE}{_entries('artist', 'origin')}{_pages('entries', 'pos', 'entry')}")
for _mode, _key in (("artist", "artist"), ("origin", "origin"), ("tags", "tag")):
    _add(f"{_mode}_pages", lambda c, m=_mode: render.library_pages(c, m), f"{_NAMED}{_BY[_key]}{_lines(_key)}{_pages('lines', 'line_no', 'line')}")


def _trim(c: str, most: int = 100) -> str:
    starts = f"list_filter(range(1, least(length({c}), {most}) + 1), lambda i: strlen(left({c}, cast(i - 1 AS integer))) <= {most - 1})"
    return f"CASE WHEN strlen({c}) <= {most} THEN {c} ELSE left({c}, cast(len({starts}) - 1 AS integer)) || '…' END"


_add("trim_bytes", lambda c: c.tracks.select("id", text.trim_bytes(F.col("track_title")).alias("short")), f" SELECT id, {_trim('track_title')} AS short FROM tracks")
_add(
    "autocomplete_artist",
    lambda c: search.complete_names(c, Dimension.ARTIST, "src"),
    f", found AS (SELECT DISTINCT artist AS name FROM artists WHERE {_like('artist', 'src')} ORDER BY name LIMIT 25) SELECT cast(row_number() OVER (ORDER BY display, name) AS integer) AS pos, display FROM (SELECT name, {_trim('name')} AS display FROM found)",
)
for _kind, _needle in ((Dimension.ORIGIN, "e"), (Dimension.TAG, "O")):
    _add(
        f"autocomplete_{_kind.column}",
        lambda c, k=_kind, n=_needle: search.complete_names(c, k, n),
        f", found AS ({_dimension_sql(_kind.table, _kind.column, _needle)}) SELECT cast(row_number() OVER (ORDER BY display, name) AS integer) AS pos, display FROM (SELECT name, {_trim('name')} AS display FROM found)",
    )
#: What each field has to give up, from sums over the longer fields of its row.
_FITTED = """, fields AS (SELECT id, unnest([track_title, coalesce(artist, ''), coalesce(origin, ''), coalesce(tags, 'No tags')]) AS f, unnest([1, 2, 3, 4]) AS place FROM found)
, sized AS (SELECT *, strlen(f) AS size, sum(strlen(f)) OVER (PARTITION BY id) - 89 AS excess FROM fields)
, asked AS (SELECT *, excess - coalesce(sum(size) OVER (PARTITION BY id ORDER BY size DESC, place DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS give FROM sized)
, kept AS (SELECT *, greatest(size - give, 0) AS rest FROM asked), cut AS (SELECT *, CASE WHEN rest > 3 THEN rest - 3 ELSE rest END AS room FROM kept)
, fitted AS (SELECT id, place, CASE WHEN give <= 0 THEN f ELSE left(f, cast(len(list_filter(range(1, least(length(f), cast(room AS bigint)) + 1), lambda i: strlen(left(f, cast(i AS integer))) <= room)) AS integer)) || '…' END AS shown FROM cut)
, lined AS (SELECT id, string_agg(shown, ' | ' ORDER BY place) AS display FROM fitted GROUP BY id)
SELECT cast(row_number() OVER (ORDER BY display, id) AS integer) AS pos, display, id FROM lined"""
_add("autocomplete_tracks", lambda c: search.complete_tracks(c, "the"), _tracks_sql("the").replace(f"{_NAMED} SELECT", f"{_NAMED}, found AS (SELECT") + ")" + _FITTED)
_add("autocomplete_incomplete", lambda c: search.complete_incomplete(c, "an"), _incomplete_sql("an").replace(f"{_NAMED} SELECT", f"{_NAMED}, found AS (SELECT") + ")" + _FITTED)


# ---- URLs ----

_URLS = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://youtu.be/' || page_id WHEN 1 THEN 'https://www.YouTube.com/watch?v=' || page_id || '&t=1'
  WHEN 2 THEN 'https://m.youtube.com/embed/' || page_id || '/x' WHEN 3 THEN url WHEN 4 THEN 'id' || page_id ELSE 'https://youtube.com/channel/' || page_id END AS input FROM {pages}"""
_URL_SQL = f"""WITH inputs AS ({_URLS.format(pages="pages")}), parts AS (SELECT *, lower(regexp_extract(input, '^https?://([^/?#]*)', 1)) AS host,
  regexp_extract(input, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(input, '[?&]v=([^&#]*)', 1) AS v FROM inputs)
, found AS (SELECT page_id, input, CASE WHEN host = 'youtu.be' THEN split_part(path, '/', 2) WHEN host IN ('youtube.com', 'www.youtube.com', 'm.youtube.com')
  THEN coalesce(nullif(v, ''), nullif(regexp_extract(path, '(^|/)embed/([^/]*)', 2), '')) END AS video_id FROM parts)"""


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_URLS.format(pages="{pages}"), pages=spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES["url_video_id"] = lambda spark, sf_dir: _inputs(spark, sf_dir).select("page_id", text.video_id(F.col("input")).alias("video_id"))
ORACLES["url_video_id"] = f"{_URL_SQL} SELECT page_id, video_id FROM found"
QUERIES["normalise_input"] = lambda spark, sf_dir: _inputs(spark, sf_dir).select("page_id", text.normalise_input(F.col("input")).alias("id"))
ORACLES["normalise_input"] = f"{_URL_SQL} SELECT page_id, coalesce(video_id, input) AS id FROM found"


# ---- changes ----

_STATE = " SELECT t.id, t.track_title, a.artist, o.origin FROM {tracks} t LEFT JOIN {artists} a ON t.artist_id = a.id LEFT JOIN {origins} o ON t.origin_id = o.id"


def _state(c: Catalogue) -> DataFrame:
    rows = browse.with_origin(browse.with_artist(c.tracks, c), c)
    return rows.select("id", "track_title", "artist", "origin")


def _bridge(c: Catalogue) -> DataFrame:
    return c.track_tags.join(c.tags.withColumnRenamed("id", "tag_id"), "tag_id").select("track_id", "tag")


def _third(c: Catalogue, *columns) -> DataFrame:
    return c.tracks.where(F.col("id").cast("long") % 3 == 0).select(*columns)


_add("dict_encode", lambda c: dml.encode_names(c.artists, "artist", c.tracks.select("track_title")).select("artist"), " SELECT artist FROM artists UNION SELECT track_title FROM tracks")
_add(
    "insert_track",
    lambda c: _state(dml.insert_downloads(c, c.tracks.select(F.concat(F.lit("new"), F.col("id")).alias("id"), F.lit(None).cast("string").alias("upload_date"), F.col("track_title").alias("title"), F.lit("someone").alias("artist")))),
    f"{_NAMED} SELECT id, track_title, artist, origin FROM named UNION ALL SELECT 'new' || id, track_title, 'someone', 'No origin provided' FROM tracks",
)
_add(
    "insert_or_ignore_tags",
    lambda c: _bridge(dml.add_tags(c, c.tracks.select(F.col("id").alias("track_id"), F.explode(F.array(F.lit("good"), F.lit("fresh"))).alias("tag")))),
    " SELECT track_id, tag FROM track_tags JOIN tags ON tags.id = tag_id UNION SELECT id, unnest(['good', 'fresh']) FROM tracks",
)
_add("delete_tags", lambda c: _bridge(dml.delete_tags(c, _third(c, "id"))), " SELECT track_id, tag FROM track_tags JOIN tags ON tags.id = tag_id WHERE cast(track_id AS bigint) % 3 <> 0")
_add("reset_tags", lambda c: _bridge(dml.reset_tags(c, "7")), " SELECT track_id, tag FROM track_tags JOIN tags ON tags.id = tag_id WHERE track_id <> '7'")
_add(
    "changed_fields",
    lambda c: c.tracks.select("id", text.changed_fields(**{n: F.when(F.col("id").cast("long") % k == 0, F.col("track_title")) for n, k in (("title", 2), ("artist", 3), ("origin", 5))}).alias("said")),
    " SELECT id, concat_ws(', ', CASE WHEN cast(id AS bigint) % 2 = 0 THEN 'title' END, CASE WHEN cast(id AS bigint) % 3 = 0 THEN 'artist' END, CASE WHEN cast(id AS bigint) % 5 = 0 THEN 'origin' END) AS said FROM tracks",
)
_add("update_title", lambda c: _state(dml.update_title(c, "7", "Another title")), f"{_NAMED} SELECT id, CASE WHEN id = '7' THEN 'Another title' ELSE track_title END AS track_title, artist, origin FROM named")
_add("update_artist", lambda c: _state(dml.update_name(c, Dimension.ARTIST, "7", "someone")), f"{_NAMED} SELECT id, track_title, CASE WHEN id = '7' THEN 'someone' ELSE artist END AS artist, origin FROM named")
_add("update_origin", lambda c: _state(dml.update_name(c, Dimension.ORIGIN, "7", "en")), f"{_NAMED} SELECT id, track_title, artist, CASE WHEN id = '7' THEN 'en' ELSE origin END AS origin FROM named")
_add(
    "patch_tracks",
    lambda c: _state(dml.patch_tracks(c, _third(c, "id", F.when(F.col("id").cast("long") % 2 == 0, F.concat(F.lit("fixed "), F.col("id"))).alias("title"), F.lit("someone").alias("artist"), F.lit(None).cast("string").alias("origin")))),
    f"{_NAMED} SELECT id, CASE WHEN cast(id AS bigint) % 6 = 0 THEN 'fixed ' || id ELSE track_title END AS track_title, CASE WHEN cast(id AS bigint) % 3 = 0 THEN 'someone' ELSE artist END AS artist, origin FROM named",
)
_add(
    "cascade_delete",
    lambda c: dml.cascade(c.with_tables(artists=c.artists.where("id % 4 <> 0"))).track_tags,
    " SELECT b.* FROM track_tags b JOIN tracks t ON t.id = b.track_id WHERE t.artist_id % 4 <> 0",
)


# ---- ingest ----


def _records(c: Catalogue) -> DataFrame:
    """Records of every track under its own id, and under a new one, with tags and a missing artist, from JSON texts."""
    return parse_ingest(_record_texts(c))


def _record_texts(c: Catalogue) -> DataFrame:
    both = c.tracks.select(F.explode(F.array("id", F.concat(F.lit("new"), F.col("id")))).alias("id"), "track_title")
    fields = F.struct("id", F.lit("2024").alias("upload_date"), F.col("track_title").alias("yt_title"), F.concat(F.lit("again "), F.col("track_title")).alias("track_title"), F.lit("fresh").alias("track_origin"), F.array(F.lit("boss fight"), F.lit("good")).alias("tags"))
    return both.select(F.to_json(fields).alias("value"))


_add(
    "ingest_json",
    lambda c: _state(ingest.ingest(c, _records(c))),
    f"{_NAMED} SELECT id, track_title, artist, origin FROM named UNION ALL SELECT 'new' || id, 'again ' || track_title, 'No artist provided', 'fresh' FROM tracks",
)
for _name, _split, _tags in (("ingest_json_tags", False, "['boss fight', 'good']"), ("ingest_json_split_tags", True, "['boss', 'fight', 'good']")):
    _add(
        _name,
        lambda c, s=_split: _bridge(ingest.ingest(c, _records(c), split_ws=s)),
        f" SELECT track_id, tag FROM track_tags JOIN tags ON tags.id = tag_id UNION SELECT unnest([id, 'new' || id]), t.tag FROM tracks, (SELECT unnest({_tags}) AS tag) t",
    )


def _ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tracks' records as files of one object each, read back and ingested: the new tracks' titles."""
    folder = new_path(spark, "records")
    names = spark.range(12).select(F.concat(F.lit("f"), F.col("id")).alias("id"), F.col("id").alias("k"))
    texts = names.select(F.to_json(F.struct("id", F.concat(F.lit("title\n"), F.col("k")).alias("track_title"), F.array(F.lit("a b")).alias("tags"))).alias("value"))
    texts.repartitionByRange(12, "value").write.option("maxRecordsPerFile", 1).text(folder)
    c = adapted(spark, sf_dir)
    return _state(ingest.ingest(c, read_ingest(spark, folder)))


QUERIES["ingest_files"] = _ingest_files
ORACLES["ingest_files"] = f"{oracle_views()}{_NAMED} SELECT id, track_title, artist, origin FROM named UNION ALL SELECT 'f' || k, 'title' || chr(10) || k, 'No artist provided', 'No origin provided' FROM range(12) r(k)"
#: The driver's tables, each a file or folder of its name.
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES["present_files"] = lambda spark, sf_dir: present_ids(spark, sf_dir, ".parquet")
ORACLES["present_files"] = f"SELECT unnest([{', '.join(repr(t) for t in _TABLES)}]) AS id"
QUERIES["seed_names"] = lambda spark, sf_dir: (lambda c: c.artists.select("id", F.col("artist").alias("name")).unionByName(c.origins.select("id", F.col("origin").alias("name"))))(empty_catalogue(spark))
ORACLES["seed_names"] = "SELECT cast(1 AS bigint) AS id, unnest(['No artist provided', 'No origin provided']) AS name"


def _downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k")
    value = F.concat(F.lit('{"id": "'), F.col("event_id").cast("string"), F.lit('", "upload_date": null, "title": "t'), k, F.lit('"'), F.when(F.col("event_id") % 2 == 0, F.lit(', "channel": 5}')).otherwise(F.lit("}")))
    return events.select(value.alias("value"))


def _download_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = parse_download(_downloads(spark, sf_dir))
    return good.select("id", "upload_date", "title")


QUERIES["download_json"] = _download_json
ORACLES["download_json"] = "SELECT cast(event_id AS varchar) AS id, cast(NULL AS varchar) AS upload_date, 't' || json_extract_string(props, '$.k') AS title FROM events WHERE event_id % 2 = 0"
QUERIES["download_json_rejects"] = lambda spark, sf_dir: parse_download(_downloads(spark, sf_dir))[1].agg(F.count("*").alias("n"))
ORACLES["download_json_rejects"] = "SELECT count(*) AS n FROM events WHERE event_id % 2 <> 0"


def _asked(c: Catalogue) -> DataFrame:
    return c.tracks.select(F.when(F.col("id").cast("long") % 2 == 0, F.concat(F.lit("https://youtu.be/"), F.col("id"))).otherwise(F.concat(F.lit("x"), F.col("id"))).alias("input"))


_add("resolve_known", lambda c: ingest.resolve(c, _asked(c))[0], f"{_NAMED} SELECT 'https://youtu.be/' || id AS input, id, track_title AS title, artist, origin FROM named WHERE cast(id AS bigint) % 2 = 0")
_add(
    "resolve_fetched",
    lambda c: ingest.resolve_or_fetch(
        c,
        c.tracks.select(F.concat(F.lit("https://youtu.be/"), F.when(F.col("id").cast("long") % 2 == 0, F.col("id")).otherwise(F.concat(F.lit("x"), F.col("id")))).alias("input")),
        lambda ids: ids.select("id", F.lit("2024").alias("upload_date"), F.concat(F.lit("fetched "), F.col("id")).alias("title")),
    )[1],
    f"{_NAMED} SELECT 'https://youtu.be/' || id AS input, id, track_title AS title, artist, origin FROM named WHERE cast(id AS bigint) % 2 = 0"
    " UNION ALL SELECT 'https://youtu.be/x' || id, 'x' || id, 'fetched x' || id, 'No artist provided', 'No origin provided' FROM tracks WHERE cast(id AS bigint) % 2 <> 0",
)
_add("resolve_missing", lambda c: ingest.resolve(c, _asked(c))[1], " SELECT 'x' || id AS input, 'x' || id AS id, false AS valid FROM tracks WHERE cast(id AS bigint) % 2 <> 0")


# ---- reconcile ----


def _files(c: Catalogue) -> DataFrame:
    return c.tracks.where("cast(id AS bigint) % 4 <> 0").select("id")


def _even(track_id: str) -> bool:
    """Stands for a download: ids that divide by 8 succeed, those by 12 raise, the others are refused."""
    if int(track_id) % 12 == 0:
        raise OSError(track_id)
    return int(track_id) % 8 == 0


_add("sync_missing", lambda c: sync.missing_files(c.tracks, _files(c)), " SELECT id, 'audio/' || id || '.mp3' AS path FROM tracks WHERE cast(id AS bigint) % 4 = 0")
_add(
    "sync_stats",
    lambda c: sync.sync_stats(sync.reconcile(c.tracks, _files(c), _even, pause=lambda s: None)),
    " SELECT count(*) AS total, count(*) FILTER (i % 4 <> 0) AS present, count(*) FILTER (i % 8 = 0 AND i % 12 <> 0) AS downloaded, cast(0 AS bigint) AS failed, count(*) FILTER (i % 4 = 0 AND (i % 8 <> 0 OR i % 12 = 0)) AS skipped FROM (SELECT cast(id AS bigint) AS i FROM tracks)",
)
_add("fetch_plan", lambda c: sync.fetch_plan(sync.missing_files(c.tracks, _files(c)).select("id")), " SELECT id, cast(row_number() OVER (ORDER BY id) AS integer) AS pos, cast((row_number() OVER (ORDER BY id) - 1) % 4 AS integer) AS slot FROM tracks WHERE cast(id AS bigint) % 4 = 0")
QUERIES["retry_backoff"] = lambda spark, sf_dir: spark.range(1, 4).select(F.col("id").alias("attempt"), sync.backoff_ms(F.col("id")).alias("pause_ms"))
ORACLES["retry_backoff"] = "SELECT a AS attempt, 200 * a AS pause_ms FROM range(1, 4) r(a)"


# ---- state ----

_EVENTS = "SELECT user_id AS guild, ts, event_id AS seq, CASE event_type WHEN 'view' THEN 'play' WHEN 'error' THEN 'leave' WHEN 'click' THEN 'pause' ELSE 'loop' END AS kind, cast(event_id AS varchar(20)) AS track FROM {events}"


def player_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player events made of the events table."""
    return spark.sql(_EVENTS.format(events="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


_EVENT_SQL = f"""WITH e AS ({_EVENTS.format(events="events")}), last AS (SELECT *, row_number() OVER (PARTITION BY guild ORDER BY ts DESC, seq DESC) AS n FROM e WHERE kind IN ('play', 'leave'))
, playing AS (SELECT guild, track, ts FROM last WHERE n = 1 AND kind = 'play')"""
QUERIES["now_playing"] = lambda spark, sf_dir: state.now_playing(player_events(spark, sf_dir))
ORACLES["now_playing"] = f"{_EVENT_SQL} SELECT guild, track, ts FROM playing"
QUERIES["toggle_state"] = lambda spark, sf_dir: state.toggles(player_events(spark, sf_dir))
ORACLES["toggle_state"] = f"""{_EVENT_SQL}, since AS (SELECT guild, max((ts, seq)) AS s FROM e WHERE kind = 'play' GROUP BY guild)
SELECT p.guild, count(*) FILTER (e.kind = 'pause' AND (e.ts, e.seq) > s) % 2 = 1 AS paused, count(*) FILTER (e.kind = 'loop' AND (e.ts, e.seq) > s) % 2 = 0 AS looping
FROM playing p JOIN since USING (guild) JOIN e ON e.guild = p.guild GROUP BY p.guild"""


def _first_guild(events: DataFrame):
    """The smallest guild that plays something."""
    return state.now_playing(events).agg(F.min("guild")).first()[0]


_LATER = "2100-01-01"


def _with_first(run: Callable[[DataFrame, object], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = player_events(spark, sf_dir)
        return run(events, _first_guild(events))

    return query


_FIRST = "(SELECT min(guild) FROM playing)"
QUERIES["require_now_playing"] = _with_first(state.require_now_playing)
ORACLES["require_now_playing"] = f"{_EVENT_SQL} SELECT guild, track, ts FROM playing WHERE guild = {_FIRST}"
QUERIES["leave_player"] = _with_first(lambda events, guild: state.now_playing(state.leave(events, guild, _LATER)))
ORACLES["leave_player"] = f"{_EVENT_SQL} SELECT guild, track, ts FROM playing WHERE guild <> {_FIRST}"
for _name, _kind, _paused, _looping in (("pause_player", state.PAUSE, "NOT paused", "looping"), ("loop_player", state.LOOP, "paused", "NOT looping")):
    QUERIES[_name] = _with_first(lambda events, guild, k=_kind: state.flip(events, guild, k, _LATER)[1])
    ORACLES[_name] = f"SELECT guild, {_paused} AS paused, {_looping} AS looping FROM ({ORACLES['toggle_state']}) t WHERE guild = (SELECT min(guild) FROM ({ORACLES['now_playing']}) p)"
