"""Text pages of the browse views: numbered entries or grouped lines, fifteen to a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellac.functions.text import meta_line, trunc
from shellac.operators import browse as views
from shellac.operators.numbering import number_rows
from shellac.schema import META_CHARS, PAGE_SIZE, TITLE_CHARS
from shellac.sources.catalogue import Catalogue


def _numbered(rows: DataFrame) -> DataFrame:
    """Add the number of each row, aligned to the right in as many places as the number of rows has."""
    width = F.length(F.col("total").cast("string"))
    return rows.withColumn("width", width).withColumn("number", F.lpad(F.col("pos").cast("string"), F.col("width"), F.lit(" ")))


def flat_entries(rows: DataFrame, *meta: str) -> DataFrame:
    """One entry a row (pos, entry) of rows with pos and total: number, title, and below it the row's other fields unless all are placeholders."""
    shown = _numbered(rows).withColumn("meta", meta_line(*[F.col(m) for m in meta]))
    below = F.when(F.col("meta") == "", F.lit("")).otherwise(F.concat(F.lit("\n"), F.repeat(F.lit(" "), F.col("width") + 4), F.col("meta")))
    entry = F.concat(F.col("number"), F.lit(". "), trunc(F.col("track_title"), TITLE_CHARS), below, F.lit("\n"))
    return shown.select("pos", entry.alias("entry"))


def grouped_lines(rows: DataFrame, key: str) -> DataFrame:
    """Lines (line_no, line) of rows (with pos and total) that are sorted by a key: a header where the key changes, a blank line before every
    header but the first, and the numbered titles, which are counted through all groups.

    A first group with an empty key gets no header. Where groups begin comes from a smallest number by key, so neither a
    long group nor the number of groups puts all rows in one task.
    """
    starts = rows.groupBy(F.col(key).alias("_key")).agg(F.min("pos").alias("_first"))
    bare = (F.col("_first") == 1) & (F.col("_key") == "")
    groups = number_rows(starts.where(~bare), ["_first"], "_group").unionByName(starts.where(bare).withColumn("_group", F.lit(0)))
    items = _numbered(rows).join(groups, F.col(key) == F.col("_key"))
    header = F.when((F.col("pos") == F.col("_first")) & (F.col("_group") > 0), F.concat(F.lit("── "), trunc(F.col(key), META_CHARS)))
    blank = F.when(header.isNotNull() & (F.col("_group") > 1), F.lit(""))
    item = F.concat(F.lit("  "), F.col("number"), F.lit(". "), trunc(F.col("track_title"), TITLE_CHARS))
    # before a title stand the titles of lower number, a header for each group so far, and a blank for each but the first
    at = F.col("pos") + F.when(F.col("_group") > 0, 2 * F.col("_group") - 1).otherwise(0)
    lines = items.select(at.alias("_at"), F.array_compact(F.array(blank, header, item)).alias("_lines"))
    spread = lines.select("_at", F.size("_lines").alias("_n"), F.posexplode("_lines").alias("_k", "line"))
    return spread.select((F.col("_at") - F.col("_n") + 1 + F.col("_k")).cast("int").alias("line_no"), "line")


def paginate(lines: DataFrame, number: str, text: str, size: int = PAGE_SIZE) -> DataFrame:
    """Pages (page from 1, body): each ``size`` lines or entries, headers and blanks included, inside a code fence."""
    page = F.floor((F.col(number) - 1) / size).cast("int") + 1
    body = F.expr(f"listagg({text}, chr(10)) WITHIN GROUP (ORDER BY {number})")
    return lines.groupBy(page.alias("page")).agg(F.concat(F.lit("```\n"), body, F.lit("\n```")).alias("body"))


def library_pages(c: Catalogue, mode: str) -> DataFrame:
    """The pages of a browse mode; no rows when there is nothing to show."""
    rows = views.browse(c, mode, total="total")
    if mode in ("artist", "origin", "tags"):
        return paginate(grouped_lines(rows, "tag" if mode == "tags" else mode), "line_no", "line")
    meta = ("artist", "origin") if mode == "incomplete" else ("artist", "origin", "tags")
    return paginate(flat_entries(rows, *meta), "pos", "entry")
