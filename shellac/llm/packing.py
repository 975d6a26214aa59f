"""Best-fit packing of token pieces into sequences of a fixed capacity by the sum-of-squares rule.

``tokenise_pieces`` cuts each document's ids into pieces, ``pack`` places pieces, ``assemble`` builds the packed
id sequences. Only piece lengths matter to the placement, so ``pack`` moves narrow rows and never ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellac.llm.common import bound_batches, quoted, release_memory

#: Pieces packed together by one task; a shard costs at most a few part-filled sequences.
SHARD_PIECES = 32_768
_PLACE_BITS = 40


def tokenise_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, text: str = "text", memo_words: int | None = None) -> DataFrame:
    """Cut every document's ids, with ``end_id`` behind, into pieces of at most ``capacity``.

    Only documents longer than the capacity are cut; their last piece may be shorter. Null texts count as empty
    (one piece that holds the end id). Columns: doc_id, piece int, start long, length long, ids binary
    (little-endian unsigned 32-bit). Repeated rows and doc_ids give pieces of their own each. ``memo_words`` bounds the
    words that a worker keeps with their ids.
    """
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from shellac.llm import tokens

        tokenizer_ = tokens.load(tokenizer, memo_words)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = tokenizer_.encode_many(part.column(1))
                doc, piece, start, length, data = [], [], [], [], []
                for d, b in zip(part.column(0).to_pylist(), ids):
                    b += end
                    for k, i in enumerate(range(0, len(b), step)):
                        own = b[i : i + step]
                        doc.append(d)
                        piece.append(k)
                        start.append(i // 4)
                        length.append(len(own) // 4)
                        data.append(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, part.schema.field(0).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"],
                )
        release_memory()

    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text)).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


def place_sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the given order.

    With n[g] the number of open bins that have g places left, each item goes where the sum of n[g]**2 comes out
    smallest: into a bin of some residual gap, or into a new bin. Ties go to the tightest gap.
    """
    n = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    far = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        # moving a bin from gap g to g - s changes the sum by 2 (n[g - s] - n[g] + 1); a bin that fills up leaves it
        change = np.where(n[s:] > 0, 2 * (n[: capacity + 1 - s] - n[s:] + 1), far)
        if n[s]:
            change[0] = 1 - 2 * n[s]
        best = int(change.argmin())
        fresh = 2 * int(n[capacity - s]) + 1 if s < capacity else 0
        if change[best] <= fresh:
            g = best + s
            b = bins[g].pop()
            n[g] -= 1
        else:
            g, b = capacity, len(used)
            used.append(0)
        where[i], offset[i] = b, used[b]
        used[b] += s
        if g > s:
            bins[g - s].append(b)
            n[g - s] += 1
    return where, offset


def pack(pieces: DataFrame, capacity: int = 4096, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Place pieces (any columns, with ``length`` from 1 to ``capacity``) into sequences; adds sequence_id, offset.

    Pieces are dealt to shards by a hash of their place in the table, so that a hot document or many equal rows
    spread. Each shard goes through the sum-of-squares rule, first the longest four fifths in random order, then
    the short ones, longest first, which fill what is open. Offsets in a sequence are gapless from 0. Give a written
    table: its rows are counted, then read once more, and their places must not change. An empty table gives
    an empty result. A length outside 1..capacity raises. Columns of the added names are replaced.
    """
    shards = max(1, -(-pieces.count() // shard_pieces))
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    shard = "_shard"
    while shard in names:
        shard += "_"
    pieces = pieces.select(*[F.col(quoted(c)) for c in names])
    dealt = pieces.withColumn(shard, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    order = ["length", *[c for c in names if c != "length"]]

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, ascending=[False] + [True] * (len(order) - 1), kind="stable", ignore_index=True)
        lengths = rows["length"].to_numpy(np.int64)
        if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
            raise ValueError("piece lengths must lie between 1 and the capacity")
        turn = np.arange(len(lengths))
        turn[: len(turn) * 4 // 5] = np.random.default_rng(0).permutation(len(turn) * 4 // 5)
        where, offset = np.empty(len(turn), np.int64), np.empty(len(turn), np.int64)
        where[turn], offset[turn] = place_sum_of_squares(lengths[turn], capacity)
        return rows.drop(columns=shard).assign(sequence_id=where + (int(key[0]) << _PLACE_BITS), offset=offset)

    schema = ", ".join([f"{quoted(f.name)} {f.dataType.simpleString()}" for f in pieces.schema] + ["sequence_id long", "offset long"])
    return dealt.groupBy(shard).applyInPandas(place, schema)


def assemble(placed: DataFrame) -> DataFrame:
    """The packed sequences of placed pieces that still carry ``ids``: sequence_id, ids array, and for each place
    the start offsets of its pieces (document boundaries for attention masks)."""
    by_place = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    to_ids = F.aggregate("parts", F.unhex(F.lit("")), lambda acc, p: F.concat(acc, p["ids"]))
    return (
        placed.groupBy("sequence_id").agg(by_place.alias("parts"))
        .select("sequence_id", to_ids.alias("ids"), F.transform("parts", lambda p: p["offset"]).alias("starts"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))
    )
