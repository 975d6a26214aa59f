"""JSON inputs with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shellac.schema import DOWNLOAD_KEYS, INGEST


def read_ingest(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Track records, one JSON object a file."""
    return spark.read.schema(INGEST).option("multiLine", True).json(paths if isinstance(paths, str) else list(paths))


def parse_ingest(texts: DataFrame, column: str = "value") -> DataFrame:
    """Track records from a column of JSON texts; texts that are no JSON object give a row of nulls."""
    return texts.select(F.from_json(column, INGEST).alias("r")).select("r.*")


def parse_download(texts: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Download records of JSON texts and the texts that lack one of the four keys.

    A key that is there and null counts as there. Other keys are ignored; non-string values are null here, and get
    their defaults when a track is inserted. Inputs are not deleted.
    """
    keys = F.json_object_keys(F.col(column))
    whole = F.coalesce(F.size(F.array_intersect(keys, F.array(*map(F.lit, DOWNLOAD_KEYS)))) == len(DOWNLOAD_KEYS), F.lit(False))
    quoted = T.StructType([T.StructField(k, T.StringType()) for k in DOWNLOAD_KEYS])
    strings = F.struct(*[F.when(F.regexp_like(F.get_json_object(F.concat(F.lit("["), column, F.lit("]")), f"$[0].{k}"), F.lit("(?s).*")), F.from_json(column, quoted)[k]).alias(k) for k in DOWNLOAD_KEYS])
    return texts.where(whole).select(strings.alias("r")).select("r.*"), texts.where(~whole)
