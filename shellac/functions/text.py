"""Text functions of search and display, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from shellac.schema import DISPLAY_BYTES, ELLIPSIS, META_CHARS, NO_ARTIST, NO_ORIGIN, NO_TAGS, SEPARATOR

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, as the stored side of a search is folded."""
    return F.translate(c, _UPPER, _LOWER)


def matches(c: Column, needle: str, fold: str = "ascii") -> Column:
    """Case-folded substring search. The needle is lower-cased in full Unicode, the column in ASCII (``fold="unicode"``: also in
    full). ``%`` and ``_`` in the needle are wildcards, no character escapes, an empty needle matches every text."""
    folded = ascii_lower(c) if fold == "ascii" else F.lower(c)
    low = needle.lower()
    if "%" not in low and "_" not in low:
        return F.contains(folded, F.lit(low))
    return F.like(folded, F.lit(f"%{low}%"), F.lit("\u0001" if "\u0001" not in low else "\u0002"))


def any_matches(columns: Sequence[Column], needle: str, fold: str = "ascii") -> Column:
    """Whether one of the columns matches; a null column alone decides nothing."""
    return reduce(or_, [matches(c, needle, fold) for c in columns])


def trunc(c: Column, most: int) -> Column:
    """At most ``most`` code points: longer texts keep one less and get an ellipsis."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit(ELLIPSIS)))


def trim_bytes(c: Column, most: int = DISPLAY_BYTES) -> Column:
    """Texts of more than ``most`` bytes are cut before the last character that starts by byte ``most - 1``, and get an
    ellipsis; a limit of 1 or less gives the ellipsis for every text."""
    if most <= 1:
        return F.when(c.isNotNull(), F.lit(ELLIPSIS))
    # no more than `most` characters can start in the first `most` bytes
    starts = F.filter(F.sequence(F.lit(1), F.least(F.length(c), F.lit(most))), lambda i: F.octet_length(F.substring(c, F.lit(1), i - 1)) <= most - 1)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.concat(F.substring(c, F.lit(1), F.size(starts) - 1), F.lit(ELLIPSIS)))


def byte_prefix(c: Column, most: Column) -> Column:
    """As many whole characters from the start as fit in ``most`` bytes."""
    fitting = F.filter(F.sequence(F.lit(1), F.least(F.length(c), most)), lambda i: F.octet_length(F.substring(c, F.lit(1), i)) <= most)
    return F.when((most <= 0) | (F.length(c) == 0), F.lit("")).otherwise(F.substring(c, F.lit(1), F.size(fitting)))


def fit_fields(fields: Column, most: int = DISPLAY_BYTES) -> Column:
    """An array of texts (null: empty) joined into about ``most`` bytes of UTF-8, for arrays of up to 16.

    The fields line up by length, of equally long ones the last comes first, and each gives up what the ones before it
    could not: nothing, a part or all of it. One that gives anything up ends in an ellipsis, for which it makes room
    where more than that is left, and never splits a character.
    """
    mark = len(ELLIPSIS.encode())
    parts = F.transform(fields, lambda f, i: F.struct(F.coalesce(f, F.lit("")).alias("text"), F.octet_length(F.coalesce(f, F.lit(""))).alias("size"), i.alias("at")))
    total = lambda kept: F.aggregate(kept, F.lit(0), lambda acc, p: acc + p["size"])
    over = total(parts) - (F.lit(most + 1) - F.lit(len(SEPARATOR.encode())) * F.size(fields))

    def shown(p: Column) -> Column:
        first = F.filter(parts, lambda o: (o["size"] > p["size"]) | (o["size"] == p["size"]) & (o["at"] > p["at"]))
        left = over - total(first)
        rest = F.greatest(p["size"] - left, F.lit(0))
        return F.when(left <= 0, p["text"]).otherwise(F.concat(byte_prefix(p["text"], F.when(rest > mark, rest - mark).otherwise(rest)), F.lit(ELLIPSIS)))

    return F.array_join(F.transform(parts, shown), SEPARATOR)


def meta_line(*columns: Column) -> Column:
    """The parts that are no placeholder, each cut to 40 characters, joined by a middle dot; null parts are left out."""
    present = F.filter(F.array(*columns), lambda p: ~p.isin(NO_ARTIST, NO_ORIGIN, NO_TAGS, ""))
    return F.concat_ws(" · ", F.transform(present, lambda p: trunc(p, META_CHARS)))


def video_id(url: Column) -> Column:
    """The video id in a URL: first path segment of the short host, the ``v`` parameter or the segment after ``embed`` on the
    long hosts; null for anything else."""
    host, path = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    parameter = F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("v")))
    embedded = F.when(F.regexp_like(path, F.lit("(^|/)embed/")), F.regexp_extract(path, "(^|/)embed/([^/]*)", 2))
    short = F.split_part(F.when(path == "", F.lit("/")).otherwise(path), F.lit("/"), F.lit(2))
    return F.when(host == "youtu.be", short).when(host.isin("www.youtube.com", "youtube.com", "m.youtube.com"), F.coalesce(parameter, embedded))


def normalise_input(text: Column) -> Column:
    """The video id of a URL, or the input itself."""
    return F.coalesce(video_id(text), text)


def audio_path(track_id: Column, folder: str = "audio") -> Column:
    return F.concat(F.lit(f"{folder}/"), track_id, F.lit(".mp3"))


def changed_fields(**changes: Column) -> Column:
    """Names of the fields that a patch sets, joined by a comma."""
    return F.concat_ws(", ", *[F.when(c.isNotNull(), F.lit(name)) for name, c in changes.items()])
