"""Token ids in Arrow stream files: batches of fixed-size lists of ids and masks, with a document index beside them.

Each file holds the ids of its documents end to end, cut into rows of ``sequence_length``; only the last row of a
file is padded (mask false). A row is found by its number alone and read without a copy from a memory map.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellac.llm.common import bound_batches, release_memory

#: Rows of a batch; every batch of a file but the last has as many, so a row's batch follows from its number.
BATCH_ROWS = 256
#: Bytes of ids that a reading task sends on at a time.
SEND_BYTES = 8_000_000


@dataclass(frozen=True)
class TokenSet:
    """A written set: for each file its path without ending, the ids in all files before it, its ids and documents."""

    files: tuple[tuple[str, int, int, int], ...]
    id_kind: str


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _ids_schema(kind: str, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.field("item", getattr(pa, kind)(), False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))], {"sequence_length": str(length)})


class _Writer:
    """One pair of files, written under names of the attempt and moved into place when whole."""

    def __init__(self, fs, base: str, attempt: str, kind: str, length: int, id_type: pa.DataType):
        self.fs, self.base, self.attempt, self.length = fs, base, attempt, length
        self.schema = _ids_schema(kind, length)
        self.dtype = np.dtype(kind)
        self.doc_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [fs.open_output_stream(f"{base}.{x}.{attempt}") for x in ("arrow", "docs")]
        self.out = pa.ipc.new_file(self.sinks[0], self.schema)
        self.docs = pa.ipc.new_file(self.sinks[1], self.doc_schema)
        self.open: list[np.ndarray] = []
        self.held = self.total = self.count = 0

    def add(self, doc_ids: list, texts_ids: list[bytes]) -> None:
        sizes = [len(b) // 4 for b in texts_ids]
        starts = self.total + np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int64) if sizes else np.empty(0, np.int64)
        self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, self.doc_schema.field(0).type), pa.array(starts), pa.array(sizes, pa.int64())], schema=self.doc_schema))
        ids = np.frombuffer(b"".join(texts_ids), "<u4").astype(self.dtype)
        self.total += len(ids)
        self.count += len(sizes)
        self.open.append(ids)
        self.held += len(ids)
        if self.held >= BATCH_ROWS * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids, step = np.concatenate(self.open) if self.open else np.empty(0, self.dtype), BATCH_ROWS * self.length
        at = 0
        while len(ids) - at >= step or last and at < len(ids):
            own = ids[at : at + step]
            at += len(own)
            rows = -(-len(own) // self.length)
            mask = np.arange(rows * self.length) < len(own)
            own = np.concatenate([own, np.zeros(len(mask) - len(own), self.dtype)])
            parts = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=self.schema.field(i).type) for i, x in enumerate((own, mask))]
            self.out.write_batch(pa.RecordBatch.from_arrays(parts, schema=self.schema))
        self.open = [ids[at:]]
        self.held = len(ids) - at

    def close(self) -> None:
        self._flush(True)
        self.out.close()
        self.docs.close()
        for sink, kind in zip(self.sinks, ("arrow", "docs")):
            sink.close()
            self.fs.move(f"{self.base}.{kind}.{self.attempt}", f"{self.base}.{kind}")


class TokenFile:
    """Random access to one written file."""

    def __init__(self, base: str):
        fs, path = _files(base)
        opened = (lambda p: pa.memory_map(p)) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file
        self.reader = pa.ipc.open_file(opened(f"{path}.arrow"))
        self.docs = pa.ipc.open_file(opened(f"{path}.docs"))
        self.length = int(self.reader.schema.metadata[b"sequence_length"])
        self._batch: tuple[int, np.ndarray] = (-1, np.empty(0))

    def sequence(self, row: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of one row, both without a copy: the mask stays in Arrow, whose booleans are bits."""
        batch = self.reader.get_batch(row // BATCH_ROWS)
        at = row % BATCH_ROWS
        ids, mask = (batch.column(i).slice(at, 1).flatten() for i in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def ids(self, start: int, n: int) -> np.ndarray:
        """The ids from ``start`` on."""
        step, parts = BATCH_ROWS * self.length, []
        while n > 0:
            k = start // step
            if self._batch[0] != k:
                self._batch = (k, self.reader.get_batch(k).column(0).flatten().to_numpy())
            own = self._batch[1][start - k * step : start - k * step + n]
            parts.append(own)
            start += len(own)
            n -= len(own)
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def write_token_files(docs: DataFrame, tokenizer: str, out: str, sequence_length: int = 2048, end_id: int = 0, partitions: int | None = None) -> TokenSet:
    """Encode every whole text, append ``end_id`` and write all ids in ascending doc_id order under ``out``.

    Files are numbered in that order. Null texts count as empty; null doc_ids come first; equal doc_ids are ordered by
    a hash of the text, then the text, and may lie in different files, so one hot doc_id doesn't fill one task. An empty
    table writes no file. Tasks write under names of their own and rename, so a repeated task does no harm.
    ``out`` must be a folder that all executors reach through pyarrow (file on shared storage, hdfs, s3, gs).
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    from shellac.llm import tokens

    kind = "uint16" if tokens.load(tokenizer).library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "uint32"
    fs, folder = _files(out)
    fs.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from shellac.llm import tokens

        encoder, end = tokens.load(tokenizer), np.array([end_id], "<u4").tobytes()
        fs, folder = _files(out)
        writer, at = None, -1
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                if writer is None:
                    at = part.column(2)[0].as_py()
                    writer = _Writer(fs, f"{folder}/part-{at:06d}", str(TaskContext.get().taskAttemptId()), kind, sequence_length, part.schema.field(0).type)
                texts = encoder.encode_many(part.column(1))
                writer.add(part.column(0).to_pylist(), [b + end for b in texts])
        if writer is not None:
            writer.close()
            release_memory()
            yield pa.RecordBatch.from_pydict({"file": pa.array([at], pa.int32()), "n_tokens": pa.array([writer.total], pa.int64()), "n_docs": pa.array([writer.count], pa.int64())})

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    ordered = keyed.repartitionByRange(n, "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text").select("doc_id", "text", F.spark_partition_id().alias("file"))
    written = sorted(tuple(r) for r in ordered.mapInArrow(write, "file int, n_tokens long, n_docs long").collect())  # one row a file
    files, before = [], 0
    for file, ids, count in written:
        files.append((f"{out.rstrip('/')}/part-{file:06d}", before, ids, count))
        before += ids
    return TokenSet(tuple(files), kind)


def read_documents(spark: SparkSession, written: TokenSet, id_type: str = "bigint") -> DataFrame:
    """Read every document back from the files: doc_id, start (ids of all documents before it), ids binary
    (little-endian unsigned 32-bit, with the end id)."""
    files = written.files

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                base, before, _, _ = files[k]
                file = TokenFile(base)
                for b in range(file.docs.num_record_batches):
                    index = file.docs.get_batch(b)
                    starts, sizes = index.column(1).to_numpy(), index.column(2).to_numpy()
                    at = 0
                    while at < len(sizes):
                        upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]) * 4, SEND_BYTES, "right")) + at)
                        data = [file.ids(int(s), int(n)).astype("<u4").tobytes() for s, n in zip(starts[at:upto], sizes[at:upto])]
                        yield pa.RecordBatch.from_arrays([index.column(0).slice(at, upto - at), pa.array(starts[at:upto] + before), pa.array(data, pa.binary())], ["doc_id", "start", "ids"])
                        at = upto

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(read, f"doc_id {id_type}, start long, ids binary")
