"""Approximate nearest neighbours by cosine: a robust-pruned graph for each shard, beam search of the queries in all."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shellac.llm import graph
from shellac.llm.common import bound_batches, discard, materialise

#: Vectors of a shard, whose graph one task builds, and queries that go through a graph together.
SHARD_VECTORS, BLOCK_QUERIES = 8192, 256
#: Most tasks that search; with more shards a task takes several, one after the other.
SEARCH_TASKS = 65_536


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid vectors as float64 bytes, with a key that equal vectors share."""
    names = ["vec_id", "key", "dim", "vector"]
    for b in batches:
        there = pc.and_(pc.is_valid(b.column(0)), pc.greater(pc.fill_null(pc.list_value_length(b.column(1)), 0), 0))
        ids, lists = b.column(0).filter(there), b.column(1).filter(there)
        dims = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(dims):
            continue
        x = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0  # null components become NaN, -0.0 becomes 0.0
        starts = np.concatenate([[0], np.cumsum(dims)])
        with np.errstate(over="ignore", invalid="ignore"):
            squares = np.add.reduceat(x * x, starts[:-1])  # NaN, infinite or too large: not finite
        valid = np.flatnonzero(np.isfinite(squares) & (squares > 0))
        data = [x[starts[i] : starts[i + 1]].tobytes() for i in valid.tolist()]
        keys = [hashlib.blake2b(raw, digest_size=16).digest() for raw in data]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(valid)).cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(dims[valid], pa.int32()), pa.array(data, pa.binary())], names)


def _unit(blob: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(blob, np.float64).reshape(-1, dim)
    norms = np.sqrt(np.einsum("nd,nd->n", x, x))
    return x, norms, (x / norms[:, None]).astype(np.float32)


def _nodes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the rows in order of these, and where each one's begin: vectors of one direction share a node."""
    distinct, of = np.unique(unit, axis=0, return_inverse=True)
    of = of.reshape(-1)
    return distinct, np.argsort(of, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(distinct)))])


def build_index(classes: DataFrame, shard_vectors: int = SHARD_VECTORS, degree: int = 32, beam: int = 64, alpha: float = 1.2) -> DataFrame:
    """One row a shard and dimension: shard, dim, keys, firsts, vectors and links (bytes each), entry.

    Every class (key of 16 bytes, first_id, dim, vector) is indexed; a hash of the key deals them to shards of about
    ``shard_vectors``.
    """
    shards = max(1, -(-classes.count() // shard_vectors))

    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", ignore_index=True)
        blob = b"".join(rows["vector"])
        g = graph.build(_nodes(_unit(blob, int(key[1]))[2])[0], degree, beam, alpha)
        firsts = rows["first_id"].to_numpy(np.int64).tobytes()
        return pd.DataFrame({"shard": [key[0]], "dim": [key[1]], "keys": [b"".join(rows["key"])], "firsts": [firsts], "vectors": [blob], "links": [g.links.tobytes()], "entry": [g.entry]})

    dealt = classes.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "dim", "key", "first_id", "vector")
    return dealt.groupBy("shard", "dim").applyInPandas(make, "shard int, dim int, keys binary, firsts binary, vectors binary, links binary, entry long")


class _Shard:
    """One row of the index, opened for search."""

    def __init__(self, row: dict, degree: int):
        self.dim, self.keys = row["dim"], row["keys"]
        self.x, self.norms, unit = _unit(row["vector"], self.dim)
        self.firsts = np.frombuffer(row["firsts"], np.int64)
        distinct, self.members, self.begin = _nodes(unit)
        self.graph = graph.Graph(distinct, np.frombuffer(row["links"], np.int32).reshape(-1, degree), row["entry"])
        self.nodes = len(distinct)

    def search(self, names: list[bytes], vectors: list[bytes], k: int, beam: int) -> list[tuple]:
        """(query, class key, first_id, score) of the ``k`` nearest classes of each query."""
        q, q_norms, q_unit = _unit(b"".join(vectors), self.dim)
        out = []
        near = self.graph.search(q_unit, max(k, min(beam, self.nodes)))[0][:, : 2 * k]
        for i, nodes in enumerate(near):
            c = np.concatenate([self.members[self.begin[n] : self.begin[n + 1]] for n in nodes if n >= 0])
            score = self.x[c] @ q[i] / (self.norms[c] * q_norms[i])
            best = np.lexsort((self.firsts[c], -score))[:k]
            out += [(names[i], self.keys[16 * j : 16 * j + 16], int(self.firsts[j]), s) for j, s in zip(c[best].tolist(), score[best].tolist())]
        return out


def search_index(index: DataFrame, queries: DataFrame, k: int, degree: int = 32, beam: int = 160, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The ``k`` nearest classes of each query (key, dim, vector) in every shard: key, found (a class key), first_id, score.

    A shard moves once: in its partition it sorts before the queries, which stream past it in blocks, so a task holds one
    shard and one batch however many queries there are. The beam ranks by single precision; the scores are cosines of
    the original vectors in double precision, ties go to the smaller first_id.
    """
    bound_batches(index.sparkSession)
    empty = F.lit(None).cast("binary")
    asked = queries.join(index.select("shard", "dim"), "dim")
    asked = asked.select("shard", "dim", "key", "vector", *[empty.alias(c) for c in ("keys", "firsts", "links")], F.lit(0).cast("long").alias("entry"))
    held = index.select("shard", "dim", empty.alias("key"), F.col("vectors").alias("vector"), "keys", "firsts", "links", "entry")
    tasks = min(max(1, index.count()), SEARCH_TASKS)
    rows = asked.unionByName(held).repartition(tasks, "shard", "dim").sortWithinPartitions("shard", "dim", F.col("key").isNotNull())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            of, keys, vectors = list(zip(*[batch.column(i).to_pylist() for i in (0, 1)])), batch.column(2).to_pylist(), batch.column(3)
            at = 0
            while at < len(of):
                if keys[at] is None:
                    shard = _Shard(batch.slice(at, 1).to_pylist()[0], degree)
                    at += 1
                    continue
                end = at + 1
                while end < len(of) and end - at < block_queries and keys[end] is not None and of[end] == of[at]:
                    end += 1
                out = shard.search(keys[at:end], vectors.slice(at, end - at).to_pylist(), k, beam)
                columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.binary(), pa.binary(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "found", "first_id", "score"])
                at = end

    return rows.mapInArrow(find, "key binary, found binary, first_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_vectors: int = SHARD_VECTORS, degree: int = 32, beam: int = 160) -> DataFrame:
    """The ``k`` nearest other rows of each query row by cosine: query_id, rank, vec_id, score.

    ``vectors`` and ``queries`` have vec_id (long) and embedding (array); a query's own vec_id is no candidate. Vectors
    that are null, empty, zero or hold null or non-finite components take no part, nor rows without an id; vectors
    of another length aren't compared. Equal vectors form one class, which the index holds once, beside its ``k + 1``
    smallest ids (more can't be among the ``k`` nearest); so thousands of copies neither crowd the graph nor meet in
    one task. Ties go to the smaller vec_id; fewer candidates than ``k`` give fewer rows; empty tables give none.
    A vec_id that is repeated with another vector is a row of its own, with the same vector it counts once.
    """
    schema = "vec_id long, key binary, dim int, vector binary"
    rows = materialise(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_as_bytes, schema), "vectors")
    asked = materialise(queries.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_as_bytes, schema), "queries")
    classes = materialise(rows.groupBy("key").agg(F.min("vec_id").alias("first_id"), F.first("dim").alias("dim"), F.first("vector").alias("vector")), "classes")
    by_id = Window.partitionBy("key").orderBy("vec_id")
    ids = rows.select("key", "vec_id").distinct().withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= k + 1)
    ids = ids.groupBy(F.col("key").alias("found")).agg(F.collect_list("vec_id").alias("ids"))
    index = materialise(build_index(classes, shard_vectors, degree), "graphs")
    alike = materialise(asked.groupBy("key").agg(F.first("dim").alias("dim"), F.first("vector").alias("vector")), "asked")
    by_score = Window.partitionBy("key").orderBy(F.col("score").desc(), "first_id")
    found = search_index(index, alike, k + 1, degree, beam).withColumn("_n", F.row_number().over(by_score)).where(F.col("_n") <= k + 1)
    by_key = found.join(ids, "found").groupBy("key").agg(F.collect_list(F.struct((-F.col("score")).alias("below"), "ids")).alias("near"))
    one = F.flatten(F.transform("near", lambda f: F.transform(f["ids"], lambda i: F.struct(f["below"].alias("below"), i.alias("vec_id")))))
    others = F.filter(F.array_distinct(one), lambda c: c["vec_id"] != F.col("query_id"))
    best = asked.select(F.col("vec_id").alias("query_id"), "key").distinct().join(by_key, "key").select("query_id", F.slice(F.array_sort(others), 1, k).alias("best"))
    told = best.select("query_id", F.posexplode("best").alias("at", "c"))
    out = told.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("c.vec_id").alias("vec_id"), (-F.col("c.below")).alias("score"))
    out = materialise(out, "nearest")
    for t in (rows, asked, classes, index, alike):
        discard(t)
    return out
