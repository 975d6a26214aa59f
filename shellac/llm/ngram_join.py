"""Self-join of documents on the Jaccard similarity of their word n-gram sets, by prefix trees over families.

1. Every document's set of n-gram hashes; equal sets form one class, which goes on alone.
2. Two linked sets share a token among the first few in any global order (the prefix of each). The order is by hash, with
   tokens that many prefixes share put last; classes that hold such tokens get their prefix anew.
3. Prefix tokens put classes that may be linked into one family: through pairs, where few classes share the token, whose
   shared tokens could still reach the bound; through leaders of size ranges, where many do.
4. Each family is joined in one task by a prefix tree, a large one in blocks. Links are counted for each class, copies
   included, and those that connect a family's classes come out; the pairs of a group are never listed.

No step caps or samples: the frequent-token list and the leaders change the order of work, not the links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shellac.llm.common import bound_batches, broadcast_if_small, discard, materialise, quoted, release_memory
from shellac.llm.components import connected_components
from shellac.llm.prefix_tree import counted_links, links
from shellac.llm.shingles import shingle_sets

#: A token that more prefixes share is frequent: it goes last in the order and makes leaders instead of pairs.
FEW = 32
#: Most tokens that are put last, the most frequent ones; the list is broadcast (8 bytes each).
FREQUENT_TOKENS = 500_000
#: Classes of a family that one task joins; larger families go in pairs of blocks of at most ``BLOCK``, and of ``BLOCKS`` blocks at
#: least, so that many tasks share the first that are beyond it.
FAMILY, BLOCK, BLOCKS = 2048, 4096, 4
#: Tokens kept beyond the prefix and a quarter of it, so that most classes with frequent tokens needn't be read again.
SPARE = 4
#: Times that the order is settled anew: other tokens move up into prefixes, and may be frequent.
ROUNDS = 3
#: The first in bytes of their sets; a block has half of them at most.
FAMILY_BYTES = 64 << 20
#: Sets that a task gets on average, and their bytes.
TASK_SETS, TASK_BYTES = 2000, 32 << 20
#: Parts of a component's rows, where its name is too large a table to broadcast.
SALTS = 16
_LAST = 1 << 62


def prefix_length(n: int, percent: int) -> int:
    """Tokens of a set of ``n`` of which one at least is in every set linked to it."""
    return n - -(-percent * n // 100) + 1


def _sets(size: int, percent: int, frequent, whole: bool):
    """Arrow function over (doc_id, text, carried columns): doc_id, the carried columns, n, key of the set, and its first tokens
    by hash, its prefix with the frequent tokens last, or the whole set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = None if frequent is None else frequent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                sets = shingle_sets(texts, size)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                out = []
                for s in sets:
                    if whole:
                        out.append(s.tobytes())
                        continue
                    if late is not None and len(s):
                        s = np.sort(s + np.where(late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s, _LAST, 0))
                    p = prefix_length(len(s), percent)
                    out.append(s[: p if late is not None else p + p // 4 + SPARE].tolist() if len(s) else [])
                kind = pa.binary() if whole else pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *part.columns[2:], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(out, kind)],
                    ["doc_id", *part.schema.names[2:], "n", "key", "tokens"],
                )
            release_memory()

    return run


def _prefixes(percent: int, frequent):
    """Arrow function over (cid, n, first tokens): cid, n, and the prefix without frequent tokens, null if too few are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        for batch in batches:
            tokens = batch.column(2)
            flat, starts = tokens.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(tokens).to_numpy())])
            rare = late[np.minimum(np.searchsorted(late, flat), len(late) - 1)] != flat if len(late) else np.ones(len(flat), bool)
            out = []
            for n, a, b in zip(batch.column(1).to_pylist(), starts, starts[1:]):
                p, own = prefix_length(n, percent), flat[a:b][rare[a:b]]
                out.append(own[:p].tolist() if len(own) >= p else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.int64()))], ["cid", "n", "prefix"])

    return run


def _documents_of(docs: DataFrame, classes: DataFrame, size: int, percent: int, frequent, whole: bool) -> DataFrame:
    """``_sets`` of one document for each class (key, rep): key, tokens. Texts move only if the classes are too many to
    broadcast their ids."""
    some = classes.select(F.col("rep").alias("_rep"), "key")
    ids = some.select("_rep").distinct()
    own = docs.join(broadcast_if_small(ids, ids.count()), docs["doc_id"].eqNullSafe(F.col("_rep")), "left_semi")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = own.mapInArrow(_sets(size, percent, frequent, whole), f"doc_id {kind}, n long, key binary, tokens {'binary' if whole else 'array<long>'}")
    return made.select("key", "tokens").join(some.select("key"), "key", "left_semi").groupBy("key").agg(F.first("tokens").alias("tokens"))


def _families(classes: DataFrame, percent: int, scratch: list[DataFrame], hot: bool) -> DataFrame:
    """Candidate links (a, b) of classes (cid, n, prefix): all linked classes are connected by them. ``hot`` tells whether any token
    may be frequent still; the rows of such a token never meet in one task. Tables that it writes are added to ``scratch``."""
    narrow = classes.select("cid", F.explode("prefix").alias("token")).select("token", "cid")
    often = narrow.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > FEW).select("token")
    often = materialise(often if hot else often.limit(0), "often")
    known = broadcast_if_small(often, often.count())
    rest = narrow.join(known, "token", "left_anti") if hot else narrow
    few = materialise(rest.withColumn("c", F.count("*").over(Window.partitionBy("token"))).where("c > 1").select("token", "cid"), "few")
    many = materialise(narrow.join(known, "token", "left_semi") if hot else narrow.limit(0), "many")
    shared = few.unionByName(many)
    scratch += [often, few, many]
    held = classes.select("cid", "n", F.size("prefix").alias("p"), F.element_at("prefix", -1).alias("last"))
    frequent = many.groupBy("cid").agg(F.count("*").alias("q"))
    held = materialise(held.join(shared.select("cid").distinct(), "cid", "left_semi").join(frequent, "cid", "left").fillna(0, ["q"]), "held")

    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.cid") < F.col("b.cid"))).groupBy(F.col("a.cid").alias("a"), F.col("b.cid").alias("b")).agg(F.count("*").alias("c"))
    one = lambda x: held.select(F.col("cid").alias(x), *[F.col(k).alias(f"{k}_{x}") for k in ("n", "p", "last", "q")])
    pairs = pairs.join(one("a"), "a").join(one("b"), "b")
    # beyond the smaller of the two last prefix tokens, the overlap is at most what its set has left
    left = F.when(F.col("last_a") <= F.col("last_b"), F.col("n_a") - F.col("p_a")).otherwise(F.col("n_b") - F.col("p_b"))
    most = F.least(F.col("c") + F.least("q_a", "q_b") + left, "n_a", "n_b")
    near = pairs.where((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")

    # linked sizes differ by less than one range, so a member, its range's leader and the next range's are connected
    ranged = many.join(held.select("cid", "n"), "cid").withColumn("r", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9))
    leaders = materialise(ranged.groupBy("token", "r").agg(F.min("cid").alias("leader")), "leaders")
    scratch += [held, leaders]
    to_own = ranged.join(broadcast_if_small(leaders, leaders.count()), ["token", "r"]).select(F.col("leader").alias("a"), F.col("cid").alias("b")).where("a <> b")
    to_next = leaders.join(leaders.select("token", (F.col("r") - 1).alias("r"), F.col("leader").alias("b")), ["token", "r"]).select(F.col("leader").alias("a"), "b").where("a <> b")
    return near.unionByName(to_own.distinct()).unionByName(to_next.distinct())


def _join_tasks(tasks: DataFrame, by: Column, percent: int, counted: bool) -> DataFrame:
    """Links (a, b, 0) of rows (task, cid, copies, probe, member, tokens): inside a task, each probe against all members; a Python call
    gets the tasks of one ``by``. If they are to be counted, rows (a, a, number) tell the copies of other classes that ``a`` is
    linked with in a task."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        for _, own in rows.sort_values(["task", "cid"], kind="stable").groupby("task", sort=False):
            sets = [np.frombuffer(t, np.int64) for t in own["tokens"]]
            cids = own["cid"].tolist()
            probes, members = (np.flatnonzero(own[k].to_numpy(bool)).tolist() for k in ("probe", "member"))
            if counted:
                found, counts = counted_links(sets, probes, members, percent, own["copies"].to_numpy())
                out += [(cids[k], cids[k], int(counts[k])) for k in np.flatnonzero(counts).tolist()]
            else:
                found = links(sets, probes, members, percent)
            out += [(cids[a], cids[b], 0) for a, b in found]
        release_memory()
        return pd.DataFrame(out, columns=["a", "b", "n"]).astype("int64")

    return tasks.groupBy(by).applyInPandas(lambda rows: join(rows), "a long, b long, n long")


def _small_family_links(small: DataFrame, percent: int, counted: bool) -> DataFrame:
    """Links of families that are a task each, many of them dealt to one Python call."""
    sets, size = small.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0))).first()
    n = max(1, -(-sets // TASK_SETS), -(-size // TASK_BYTES))
    return _join_tasks(small, F.pmod(F.xxhash64("task"), F.lit(n)).alias("_bucket"), percent, counted)


def _large_family_links(large: DataFrame, sets: DataFrame, percent: int, counted: bool) -> DataFrame:
    """Links of families beyond ``FAMILY`` or ``FAMILY_BYTES`` (family, cid, copies, m members, size of their sets), in blocks: each
    block against itself and every later one, as a task of its own."""
    n = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("size") / (FAMILY_BYTES // 2), F.lit(BLOCKS))).cast("int")
    own = large.select("family", "cid", "copies", n.alias("_n"), F.pmod(F.xxhash64("cid"), n).alias("_k"))
    pairs = own.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_j"))
    task = F.concat_ws("/", "family", F.least("_k", "_j"), F.greatest("_k", "_j"))
    rows = pairs.select(task.alias("task"), "cid", "copies", (F.col("_k") <= F.col("_j")).alias("probe"), (F.col("_k") >= F.col("_j")).alias("member"))
    return _join_tasks(rows.join(sets, "cid"), F.col("task"), percent, counted)


def _drop(scratch: list[DataFrame]) -> None:
    while scratch:
        discard(scratch.pop())


def _components(docs: DataFrame, size: int, percent: int, counted: bool = False) -> DataFrame:
    """One row a document: doc_id, columns other than the text, n, component (null without a set), component_id and, if they are
    counted, n_links."""
    bound_batches(docs.sparkSession)
    spark, carried = docs.sparkSession, [c for c in docs.columns if c not in ("doc_id", "text")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select("doc_id", *carried).schema)
    made = docs.select("doc_id", "text", *carried).mapInArrow(_sets(size, percent, None, False), f"{fields}, n long, key binary, tokens array<long>")
    rows = materialise(made.withColumn("cid", F.monotonically_increasing_id()), "sets")
    docs = docs.select("doc_id", "text")
    first = rows.where("key is not null").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "cid")).alias("r"), F.count("*").alias("copies")).select(F.col("r.cid").alias("cid"), "copies")
    first = materialise(first, "first")  # the row that stands for its class
    base = rows.join(broadcast_if_small(first, first.count()), "cid").select("cid", "key", F.col("doc_id").alias("rep"), "copies", "n", "tokens")
    late, scratch = np.empty(0, np.int64), []
    for _ in range(ROUNDS):
        _drop(scratch)
        shared = spark.sparkContext.broadcast(late)  # at most ROUNDS * FREQUENT_TOKENS numbers
        own = base.select("cid", "n", "tokens").mapInArrow(_prefixes(percent, shared), "cid long, n long, prefix array<long>")
        classes = materialise(own, "prefixes")
        scratch.append(classes)
        short = classes.where("prefix is null").select("cid")
        if len(late) and short.limit(1).count():
            short = materialise(base.join(broadcast_if_small(short, short.count()), "cid").select("cid", "key", "rep", "n"), "short")
            again = short.join(_documents_of(docs, short, size, percent, shared, False), "key").select("cid", "n", F.col("tokens").alias("prefix"))
            again = materialise(again, "again")
            classes = classes.where("prefix is not null").unionByName(again)
            scratch += [short, again]
        tokens = classes.select(F.explode("prefix").alias("token")).where(F.col("token") < _LAST)
        new = tokens.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > FEW).orderBy(F.col("c").desc(), "token").limit(FREQUENT_TOKENS).collect()
        if not new:
            break
        late = np.sort(np.concatenate([late, np.array([r["token"] for r in new], np.int64)]))

    linked = connected_components(_families(classes, percent, scratch, bool(new) or len(late) > 0))
    families = materialise(linked.select(F.col("node").alias("cid"), F.col("component").alias("family")).join(base.select("cid", "n"), "cid"), "families")
    _drop(scratch)
    whole = families.groupBy("family").agg(F.count("*").alias("m"), F.sum(8 * F.col("n")).alias("size"))
    large = materialise(whole.where((F.col("m") > FAMILY) | (F.col("size") > FAMILY_BYTES)), "large")
    named = families.drop("n").join(broadcast_if_small(large, large.count()), "family", "left")
    wanted = materialise(named.join(base.select("cid", "key", "rep", "copies"), "cid"), "wanted")
    sets = materialise(_documents_of(docs, wanted, size, percent, None, True).join(wanted.select("key", "cid"), "key").select("cid", "tokens"), "members")
    small = wanted.where("m is null").select(F.col("family").cast("string").alias("task"), "cid", "copies", F.lit(True).alias("probe"), F.lit(True).alias("member"))
    found = _small_family_links(small.join(sets, "cid"), percent, counted)
    if large.limit(1).count():
        found = found.unionByName(_large_family_links(wanted.where("m is not null").select("family", "cid", "copies", "m", "size"), sets, percent, counted))
    found = materialise(found, "links")
    parts = connected_components(found)
    named = base.select("cid", "key", "rep", "copies").join(parts.select(F.col("node").alias("cid"), "component"), "cid", "left")
    if counted:
        others = found.where("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
        named = named.join(others, "cid", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("others", F.lit(0)))
    grouped = _with_smallest(named)
    alone = rows.where("key is null").select(
        "doc_id", *carried, "n", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"), *([F.lit(0).cast("long").alias("n_links")] if counted else [])
    )
    out = materialise(rows.where("key is not null").drop("tokens").join(grouped, "key").select(*alone.columns).unionByName(alone), "components")
    _drop([rows, first, linked, families, large, wanted, sets, found, parts])
    return out


def _with_smallest(named: DataFrame) -> DataFrame:
    """key, component, component_id (its smallest rep) and n_links, if there, of classes (cid, key, rep, component, null if nothing is
    linked).

    A large component's rows don't meet in one task: the smallest ids are few enough to broadcast, or go to ``SALTS`` parts.
    """
    linked, counts = named.where("component is not null"), [c for c in named.columns if c == "n_links"]
    smallest = materialise(linked.groupBy("component").agg(F.min("rep").alias("component_id")), "smallest")
    n = smallest.count()
    alone = named.where("component is null").select("key", F.col("cid").alias("component"), F.col("rep").alias("component_id"), *counts)
    known = broadcast_if_small(smallest, n)
    if known is smallest:
        linked = linked.withColumn("_salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int"))
        known = smallest.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return linked.join(known, [c for c in known.columns if c != "component_id"]).select("key", "component", "component_id", *counts).unionByName(alone)


def similar_groups(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """Group documents whose sets of ``size``-word shingles have a Jaccard of at least ``percent`` / 100.

    Returns one row a document: doc_id, n_shingles (of its set), component_id (the smallest doc_id reachable by links, itself
    included), n_links (other rows that it is linked with, all counted). Words are runs of characters other than white space, A-Z lower-cased; a text of fewer words is one shingle;
    null and empty texts and texts without words have none and are linked with nothing. Repeated rows are linked like
    other equal texts and stay; rows without a doc_id take part, but don't name a component (null where all lack one).
    Sets are compared by 62-bit hashes of their shingles. An empty table gives no rows. Needs doc_id and text only.
    """
    found = _components(docs.select("doc_id", "text"), size, percent, counted=True)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of ``similar_groups``: the one with the smallest doc_id, all columns as they are.

    Documents without words stay, as they are linked with nothing. Rows without a doc_id go if one with an id is in their group;
    of equal rows one stays. Texts move only where rows repeat or the rows that go are too many to broadcast their keys.
    """
    mark = F.md5(F.coalesce("text", F.lit("")))
    found = _components(docs.select("doc_id", "text", mark.alias("_mark")), size, percent)
    grouped = found.where("component is not null")
    first = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_mark")).alias("r"))
    chosen = first.select("component", F.col("r.doc_id").alias("_id"), F.col("r._mark").alias("_mark"))
    same = (grouped["component"] == chosen["component"]) & grouped["doc_id"].eqNullSafe(chosen["_id"]) & (grouped["_mark"] == chosen["_mark"])
    gone = materialise(grouped.join(chosen, same, "left_anti").select(F.col("doc_id").alias("_id"), "_mark").distinct(), "gone")
    repeated = grouped.groupBy("doc_id", "_mark").count().where("count > 1").limit(1).count()
    discard(found)
    own = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_own_id"), mark.alias("_own"))  # clashes with no column
    kept = own.join(broadcast_if_small(gone, gone.count(), 8 << 20), F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_mark")), "left_anti")
    return (kept.dropDuplicates(["_own_id", "_own"]) if repeated else kept).select("_row.*")
