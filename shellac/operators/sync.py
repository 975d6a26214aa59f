"""Reconcile job: rows of the catalogue against files, with bounded fetching and counts by outcome."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellac.functions.text import audio_path
from shellac.operators.numbering import number_rows
from shellac.schema import BACKOFF_MS, FETCH_ATTEMPTS, FETCH_CONCURRENCY

PRESENT, DOWNLOADED, FAILED, SKIPPED = "present", "downloaded", "failed", "skipped"


def missing_files(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """Ids (and the path wanted) of tracks that have no file."""
    return tracks.select("id").join(files.select("id"), "id", "left_anti").select("id", audio_path(F.col("id")).alias("path"))


def backoff_ms(attempt):
    """Pause after a failed attempt, in milliseconds."""
    return BACKOFF_MS * attempt


def fetch_with_retry(fetch: Callable[[str], bool], track_id: str, attempts: int = FETCH_ATTEMPTS, pause: Callable[[float], None] = time.sleep) -> str:
    """Outcome of fetching one file: an error is tried again, a plain False is not; used-up attempts count as skipped."""
    for attempt in range(1, attempts + 1):
        try:
            return DOWNLOADED if fetch(track_id) else SKIPPED
        except Exception:  # noqa: BLE001  any error of the injected fetch is one failed attempt
            if attempt < attempts:
                pause(backoff_ms(attempt) / 1000)
    return SKIPPED


def reconcile(tracks: DataFrame, files: DataFrame, fetch: Callable[[str], bool], concurrency: int = FETCH_CONCURRENCY, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """Outcome of every track: id, status. Missing files are fetched by at most ``concurrency`` tasks at a time."""
    there = tracks.select("id").join(files.select("id"), "id", "left_semi").select("id", F.lit(PRESENT).alias("status"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(status=[fetch_with_retry(fetch, i, pause=pause) for i in b["id"]])

    fetched = missing_files(tracks, files).select("id").repartition(concurrency).mapInPandas(run, "id string, status string")
    return there.unionByName(fetched)


def sync_stats(outcomes: DataFrame) -> DataFrame:
    """One row: total and the number of each outcome; ``failed`` stays 0, as used-up attempts count as skipped."""
    return outcomes.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in (PRESENT, DOWNLOADED, FAILED, SKIPPED)])


def fetch_plan(missing: DataFrame, concurrency: int = FETCH_CONCURRENCY) -> DataFrame:
    """Missing ids in order, with the slot that a serial deal to ``concurrency`` workers gives them."""
    return number_rows(missing, ["id"]).withColumn("slot", ((F.col("pos") - 1) % concurrency).cast("int"))
