"""Listings of files as DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Names that come from the JVM at once: one call for each would take long, one string of all much memory.
_AT_ONCE = 50_000


def present_ids(spark: SparkSession, folder: str, ending: str = ".mp3") -> DataFrame:
    """Ids of what is there as ``<id><ending>`` in a folder: files, empty and hidden ones too, and folders.

    The file system lists the folder once, on the driver and without its subfolders: Spark's readers pass over folders,
    empty files and names that begin with ``_`` or ``.``.
    """
    path, hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder), spark._jvm.org.apache.hadoop.fs
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    paths = spark._jvm.scala.Predef.genericWrapArray(hadoop.FileUtil.stat2Paths(files.listStatus(path)))
    parts = (paths.slice(start, start + _AT_ONCE).mkString("\0") for start in range(0, paths.length(), _AT_ONCE))
    names = (p.rsplit("/", 1)[-1] for part in parts for p in part.split("\0"))
    ids = [n.removesuffix(ending) for n in names if n.endswith(ending) and n != ending]
    return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.string())}))
