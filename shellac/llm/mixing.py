"""Mixing sources to target weights: hash-random keys, prefix sums of sizes within each source, a cut at the budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shellac.llm.common import broadcast_if_small, discard, materialise

#: Each source's keys are cut into 2**BLOCK_BITS ranges at least, whose sums are added up before any row is sorted; into more where
#: the table has over BLOCK_ROWS rows for each, so that the one range which is sorted stays as small.
BLOCK_BITS, BLOCK_ROWS = 12, 65_536


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def target_sizes(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Targets of a table (source, source_size), one row a source: adds target.

    Sources in code-point order, null last, take the weights in turn and split ``share`` of all sizes. A target stops at
    ``most`` times its source's size and what is over goes to the others by weight until none is above. That fixed
    point is reached when the sources with the smallest limit for their weight are full and the rest have one level.
    """
    by_name, by_limit = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("_limit", F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = (
        sources.withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_limit", F.col("_cap") / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(all_rows) * F.lit(float(share)))
        .withColumn("_left", F.col("_all") - F.sum("_cap").over(by_limit.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_cap"))
        .withColumn("_weights", F.sum("_w").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_full", F.col("_left") >= F.col("_limit") * F.col("_weights"))
    )
    level = (F.max("_all").over(all_rows) - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(all_rows), F.lit(0.0))) / F.sum(F.when(~F.col("_full"), F.col("_w"))).over(all_rows)
    return ranked.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("_w")))).select("source", "source_size", "target")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, text: str = "text") -> DataFrame:
    """Decide how much of each document the mix takes; adds size, source_size, target, taken and copies.

    A document's key is a hash of its doc_id, so order within a source is random and the same in every run. A source
    is gone through in key order, whole epochs first, and cut where its budget (the rounded target) ends: documents
    before the cut are taken once more, the one at the cut in part. ``taken`` counts words with repeats, exactly to the
    budget; ``copies`` counts whole documents, the one at the cut if at least half of it fits. Rows that share the key
    at the cut (a repeated doc_id, null ids) split the rest in proportion to size.

    Only sums by source and key range are shuffled, then the keys of one range per source; rows with their texts
    stay where they are. Null texts have size 0, a null source is a source, columns of the added names are replaced.
    """
    spark = docs.sparkSession
    key = F.xxhash64("doc_id", F.lit(seed))
    sized = materialise(docs.select("source", key.alias("key"), word_count(F.col(text)).alias("size")), "sizes")
    bits = min(40, max(BLOCK_BITS, (sized.count() // BLOCK_ROWS).bit_length()))
    block = F.shiftright("key", 64 - bits)
    blocks = sized.groupBy("source", block.alias("block")).agg(F.sum("size").alias("block_size"))
    by_block = Window.partitionBy("source").orderBy("block")
    blocks = materialise(blocks.withColumn("before", F.sum("block_size").over(by_block) - F.col("block_size")), "blocks")
    sources = target_sizes(blocks.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, share, most)
    budget = F.round("target").cast("long")
    sources = materialise(
        sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.when(F.col("source_size") > 0, budget - F.col("epochs") * F.col("source_size")).otherwise(F.lit(0)).cast("long")),
        "sources",
    )
    n = sources.count()
    s, b = broadcast_if_small(sources, n).alias("s"), blocks.alias("b")
    cut = (
        b.join(s, F.col("b.source").eqNullSafe(F.col("s.source")))
        .where((F.col("b.before") <= F.col("s.rest")) & (F.col("s.rest") < F.col("b.before") + F.col("b.block_size")))
        .select(F.col("s.source").alias("source"), "block", (F.col("s.rest") - F.col("b.before")).alias("rest"))
    )
    at_cut = (
        sized.alias("d").join(broadcast_if_small(cut, n).alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.shiftright("d.key", 64 - bits) == F.col("c.block")))
        .groupBy("c.source", "d.key", "c.rest").agg(F.sum("d.size").alias("key_size"))
        .withColumn("before", F.sum("key_size").over(Window.partitionBy("source").orderBy("key")) - F.col("key_size"))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("key_size")))
        .select("source", F.col("key").alias("cut_key"), (F.col("rest") - F.col("before")).alias("cut_rest"), F.col("key_size").alias("cut_size"))
    )
    plan = materialise(
        s.join(at_cut.alias("a"), F.col("s.source").eqNullSafe(F.col("a.source")), "left")
        .select(F.col("s.source").alias("_m_source"), "source_size", "target", "epochs", "cut_key", "cut_rest", "cut_size"),
        "plan",
    )
    for t in (sized, blocks, sources):
        discard(t)
    added = ("size", "source_size", "target", "taken", "copies")
    row = F.struct(*[F.col(f"m.{c}").alias(c) for c in ("source_size", "target", "epochs", "cut_key", "cut_rest", "cut_size")], key.alias("key"), word_count(F.col(f"d.{text}")).alias("size"))
    kept = [c for c in docs.columns if c not in added]
    joined = docs.alias("d").join(broadcast_if_small(plan, n).alias("m"), F.col("d.source").eqNullSafe(F.col("m._m_source")), "left")
    m = F.col("_m")
    before, there = F.coalesce(m["key"] < m["cut_key"], F.lit(False)), F.coalesce(m["key"] == m["cut_key"], F.lit(False))
    part = F.expr("_m.size * _m.cut_rest div _m.cut_size")
    return joined.select(*[F.col(f"d.`{c}`") for c in kept], row.alias("_m")).select(
        *[F.col(f"`{c}`") for c in kept],
        m["size"].alias("size"),
        m["source_size"].alias("source_size"),
        m["target"].alias("target"),
        (m["epochs"] * m["size"] + F.when(before, m["size"]).when(there, part).otherwise(0)).cast("long").alias("taken"),
        (m["epochs"] + F.when(before | there & (2 * m["cut_rest"] >= m["cut_size"]), 1).otherwise(0)).cast("int").alias("copies"),
    )


def take(mixed: DataFrame) -> DataFrame:
    """The documents of the mix: each row as often as ``copies`` says, without the added columns."""
    kept = [c for c in mixed.columns if c not in ("size", "source_size", "target", "taken", "copies")]
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"`{c}`") for c in kept])
