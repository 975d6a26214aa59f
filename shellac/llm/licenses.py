"""Licence scan with Spark expressions only: ordered signature rules behind a keyword prefilter.

Nothing is shuffled: a row's detections are found and resolved inside the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellac.llm.common import ascii_lower
from shellac.llm.license_rules import BASE, Rule, default_rules

#: Words from a keyword on that a rule is first matched against: more than the longest rule without open repeats can match (35).
REACH = 40
#: Rules with open repeats (``*`` over words) whose match takes more words than this are matched again, against all the rest. A
#: shorter match has not come near the end of its window, so more words would not change it.
OPEN_FROM = REACH // 2
#: Characters that are not part of a word, after A-Z became a-z.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def scan(docs: DataFrame, rules: Sequence[Rule] | None = None, base: Sequence[tuple[str, str]] = BASE, text: str = "text") -> DataFrame:
    """Scan every whole text; adds n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Words are runs of 0-9, a-z (A-Z lower-cased first) and characters beyond ASCII. Base phrases are counted wherever
    their words stand together. Rules start at their keyword: a word of the text picks the rules that it may open, and
    each is matched against the next words. A detection inside the interval of a rule with lower rank goes; equal
    intervals leave the lower rank. ``detections`` holds start, end (words, end not included), label, rank; ``labels``
    holds base labels and those of the detections; score is the greatest strength found, 0 without any.

    Null and empty texts have no words and no labels; columns of the added names are replaced; rows don't
    influence each other, so repeated rows, ties and empty tables need nothing special. The work is linear in
    the words, as a detection is held only against those that start at most ``REACH`` words before; the long end of an open
    rule's match holds numbers only, in which no detection starts.
    """
    rules = tuple(default_rules() if rules is None else rules)
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
    kept = [c for c in docs.columns if c not in added]
    words = F.trim(F.regexp_replace(ascii_lower(F.coalesce(F.col(text), F.lit(""))), _BETWEEN, " "))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.concat(F.lit(" "), words, F.lit(" ")).alias("_p"))
    p = F.col("_p")
    n_words = F.when(p == "  ", F.lit(0)).otherwise(_spaces(p) - 1)
    keywords = sorted({k for r in rules for k in r.keywords})
    known = F.array(*map(F.lit, keywords))
    split = F.split(F.trim(p), " ")
    # the keywords that a text has, by hash: the prefilter, and a short list to hold its words against
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], p, n_words.cast("long").alias("n_words"), F.array_intersect(split, known).alias("_here"))

    found = []
    for phrase, label in base:
        near = F.lit(f" {phrase} ")
        there = F.contains(p, near)
        first = _spaces(F.substring(p, F.lit(1), F.instr(p, near))) - 1
        last = F.col("n_words") - _spaces(F.substring_index(p, f" {phrase} ", -1)) - len(phrase.split(" "))
        found.append(F.when(there, F.struct(F.regexp_count(p, F.lit(f" {phrase}(?= )")).cast("long").alias("n"), first.cast("long").alias("first"), last.cast("long").alias("last"), F.lit(label).alias("label"))))
    rows = rows.withColumn("_base", F.array_compact(F.array(*found)))

    def entry(r: Rule) -> Column:
        return F.struct(F.lit(r.rank).alias("rank"), F.lit(r.label).alias("label"), F.lit(r.pattern).alias("pattern"), F.lit(r.strength).alias("strength"), F.lit(")*" in r.pattern).alias("open"))

    by_word = F.create_map(*[x for k in keywords for x in (F.lit(k), F.array(*[entry(r) for r in rules if k in r.keywords]))])
    none = F.array().cast("array<struct<start:int,end:int,label:string,rank:int,strength:double>>")
    rows = rows.withColumn("_words", F.when(F.size("_here") > 0, split))
    w = F.col("_words")
    anchors = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("i"), x.alias("word"))), lambda a: F.array_contains("_here", a["word"]))

    def at_anchor(a: Column) -> Column:
        window = F.array_join(F.slice(w, a["i"] + 1, F.lit(REACH)), " ")
        rest = F.array_join(F.slice(w, a["i"] + 1, F.size(w)), " ")

        def match(r: Column) -> Column:
            m = F.regexp_extract_all(window, r["pattern"], F.lit(0))
            long = r["open"] & (F.size(F.split(F.coalesce(F.get(m, F.lit(0)), F.lit("")), " ")) > OPEN_FROM)
            return F.struct(r.alias("r"), F.when(long, F.regexp_extract_all(rest, r["pattern"], F.lit(0))).otherwise(m).alias("m"))

        tried = F.transform(F.try_element_at(by_word, a["word"]), match)
        hits = F.transform(
            F.filter(tried, lambda t: F.size(t["m"]) > 0),
            lambda t: F.struct(a["i"].alias("start"), (a["i"] + F.size(F.split(F.get(t["m"], F.lit(0)), " "))).alias("end"), t["r"]["label"].alias("label"), t["r"]["rank"].alias("rank"), t["r"]["strength"].alias("strength")),
        )
        return hits

    rows = rows.withColumn("_hits", F.filter(F.transform(anchors, at_anchor), lambda h: F.size(h) > 0))
    hits = F.col("_hits")

    def resolved(own: Column, k: Column) -> Column:
        near = F.flatten(F.slice(hits, F.greatest(k - REACH, F.lit(0)) + 1, F.least(k, F.lit(REACH)) + 1))
        return F.filter(own, lambda d: ~F.exists(near, lambda e: (e["rank"] < d["rank"]) & (e["start"] <= d["start"]) & (e["end"] >= d["end"])))

    rows = rows.withColumn("detections", F.coalesce(F.flatten(F.transform(hits, resolved)), none))
    b, d = F.col("_base"), F.col("detections")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base_labels = F.transform(b, lambda x: x["label"])
    strengths = F.transform(d, lambda x: x["strength"])
    return rows.select(
        *[F.col(f"`{c}`") for c in kept],
        "n_words",
        F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("n_base"),
        F.array_min(F.transform(b, lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform(b, lambda x: x["last"])).alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, F.transform(d, lambda x: x["label"]))).alias("labels"),
        F.coalesce(F.greatest(F.array_max(strengths), F.when(F.size(b) > 0, F.lit(0.7))), F.lit(0.0)).alias("score"),
        "detections",
    )
