"""Catalogue views over the shared test tables. The definitions are SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import SparkSession

from shellac.schema import TABLES
from shellac.sources.catalogue import Catalogue

_ARTIST, _ORIGIN = "cast(cast(substring(source, 4) as int) + 1 as bigint)", "cast(case lang when 'de' then 1 when 'en' then 2 when 'es' then 3 else 4 end as bigint)"
#: The whole text: titles have no bound.
_TITLE = "text"

DOCUMENTS = {
    "tracks": f"SELECT cast(doc_id as varchar(20)) AS id, 'Unknown Date' AS upload_date, {_TITLE} AS yt_title, {_TITLE} AS track_title, {_ARTIST} AS artist_id, {_ORIGIN} AS origin_id FROM documents",
    "artists": f"SELECT DISTINCT {_ARTIST} AS id, CASE WHEN source = 'src0' THEN 'No artist provided' ELSE source END AS artist FROM documents",
    "origins": f"SELECT DISTINCT {_ORIGIN} AS id, CASE WHEN lang = 'de' THEN 'No origin provided' ELSE lang END AS origin FROM documents",
    "tags": "SELECT cast(v.id as bigint) AS id, v.tag AS tag FROM (VALUES (1, 'good'), (2, 'bad'), (3, 'toxic'), (4, 'short')) AS v(id, tag)",
    "track_tags": "SELECT cast(doc_id as varchar(20)) AS track_id, cast(CASE WHEN quality = 1 THEN 1 ELSE 2 END as bigint) AS tag_id FROM labels"
    " UNION ALL SELECT cast(doc_id as varchar(20)), cast(3 as bigint) FROM labels WHERE toxic = 1"
    " UNION ALL SELECT cast(doc_id as varchar(20)), cast(4 as bigint) FROM documents WHERE n_chars < 200",
}

_BRAND = "cast(substring(p_brand, 7) as bigint)"
_KIND = "cast(case p_type when 'ECONOMY' then 1 when 'LARGE' then 2 when 'MEDIUM' then 3 when 'PROMO' then 4 when 'SMALL' then 5 else 6 end as bigint)"

PARTS = {
    "tracks": f"SELECT cast(p_partkey as varchar(20)) AS id, 'Unknown Date' AS upload_date, p_name AS yt_title, p_name AS track_title, {_BRAND} AS artist_id, {_KIND} AS origin_id FROM part",
    "artists": f"SELECT DISTINCT {_BRAND} AS id, CASE WHEN p_brand = 'Brand#1' THEN 'No artist provided' ELSE p_brand END AS artist FROM part",
    "origins": f"SELECT DISTINCT {_KIND} AS id, CASE WHEN p_type = 'ECONOMY' THEN 'No origin provided' ELSE p_type END AS origin FROM part",
    "tags": "SELECT cast(n_nationkey as bigint) AS id, n_name AS tag FROM nation",
    "track_tags": "SELECT DISTINCT cast(l_partkey as varchar(20)) AS track_id, cast(s_nationkey as bigint) AS tag_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
}
ADAPTERS = {"documents": DOCUMENTS, "parts": PARTS}
_USES = {"documents": ("documents", "labels"), "parts": ("part", "nation", "lineitem", "supplier")}


def adapted(spark: SparkSession, sf_dir: str, adapter: str = "documents") -> Catalogue:
    """The catalogue that an adapter makes of the tables in a folder."""
    sources = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _USES[adapter]}
    return Catalogue(**{name: _cast(spark.sql(_named(sql, sources), **sources), name) for name, sql in ADAPTERS[adapter].items()})


def _named(sql: str, sources: dict) -> str:
    for name in sources:
        for lead in ("FROM ", "JOIN "):
            sql = sql.replace(f"{lead}{name}", f"{lead}{{{name}}}")
    return sql


def _cast(df, name: str):
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in TABLES[name]])


def oracle_views(adapter: str = "documents") -> str:
    """The adapter's tables as common table expressions, to stand before a DuckDB query."""
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in ADAPTERS[adapter].items())
