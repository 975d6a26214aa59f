"""The five catalogue tables as one value."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from shellac.schema import NO_ARTIST, NO_ORIGIN, TABLES, Dimension


@dataclass(frozen=True)
class Catalogue:
    """A snapshot: a track table, its artist and origin dimensions, tags and the bridge between tracks and tags."""

    tracks: DataFrame
    artists: DataFrame
    origins: DataFrame
    tags: DataFrame
    track_tags: DataFrame

    def dimension(self, kind: Dimension) -> DataFrame:
        return getattr(self, kind.table)

    def with_tables(self, **tables: DataFrame) -> Catalogue:
        """The snapshot with some tables replaced."""
        return replace(self, **tables)

    def register(self) -> None:
        """Register the tables as temporary views of their names."""
        for name in TABLES:
            getattr(self, name).createOrReplaceTempView(name)

    def write(self, folder: str) -> None:
        """Write all tables as Parquet to a new folder, committed table by table by Spark's protocol."""
        for name in TABLES:
            getattr(self, name).write.parquet(f"{folder}/{name}")


def read_catalogue(spark: SparkSession, folder: str) -> Catalogue:
    """Read the tables from a folder of Parquet tables, by the fixed schemas."""
    return Catalogue(**{name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in TABLES.items()})


def empty_catalogue(spark: SparkSession) -> Catalogue:
    """A fresh catalogue, which holds only the two sentinel names, both with id 1."""
    rows = {"artists": [(1, NO_ARTIST)], "origins": [(1, NO_ORIGIN)]}
    return Catalogue(**{name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in TABLES.items()})


def drop_catalogue(spark: SparkSession) -> None:
    """Drop the temporary views."""
    for name in TABLES:
        spark.catalog.dropTempView(name)
