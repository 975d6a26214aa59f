import os
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from conftest import SF

from shellac.llm import queries, token_files, tokens
from shellac.llm.common import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_query_equals_brute_force(spark):
    got = [tuple(r) for r in queries.op5_token_files(spark, SF).orderBy("doc_id").collect()]
    library, want, at = tokens.load(PATH).library, [], 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    assert got == want


def test_files_are_fixed_size_rows_with_masks(spark):
    docs = spark.createDataFrame([(i, "a word " * (i * 37 % 90)) for i in range(200)], "doc_id long, text string")
    out = new_path(spark, "tokens")
    written = token_files.write_token_files(docs, PATH, out, sequence_length=16, partitions=3)
    assert written.id_kind == "uint16" and sum(f[3] for f in written.files) == 200
    for base, before, n, _ in written.files:
        file = token_files.TokenFile(base)
        assert file.reader.schema.field("ids").type == pa.list_(pa.field("item", pa.uint16(), False), 16)
        parts = [file.sequence(k) for k in range(-(-n // 16))]
        ids, mask = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        assert mask.sum() == n and mask[:n].all() and (file.ids(0, n) == ids[:n]).all()
        assert not [f for f in os.listdir(os.path.dirname(base.removeprefix("file://"))) if f.count(".") > 1]


def test_sequences_and_masks_are_not_copied(spark):
    docs = spark.createDataFrame([(i, "a word " * 30) for i in range(50)], "doc_id long, text string")
    (base, _, n, _), *_ = token_files.write_token_files(docs, PATH, new_path(spark, "tokens"), sequence_length=16, partitions=1).files
    file = token_files.TokenFile(base)
    before = pa.total_allocated_bytes()
    for row in range(n // 16):
        batch = file.reader.get_batch(row // token_files.BATCH_ROWS)
        ids, mask = file.sequence(row)
        held = [batch.column(i).flatten().buffers()[1] for i in (0, 1)]
        assert mask.buffers()[1].address == held[1].address and 0 <= ids.ctypes.data - held[0].address < held[0].size
        assert len(ids) == len(mask) == 16 and pa.total_allocated_bytes() == before


def test_edge_rows(spark):
    rows = [(None, None, 1), (5, "", 1), (5, "", 1), (5, "b", 1), (3, "x " * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    written = token_files.write_token_files(docs, PATH, new_path(spark, "tokens"), partitions=4)
    got = token_files.read_documents(spark, written).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 3, 5, 5, 5]
    at = 0
    for r in got:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    empty = token_files.write_token_files(docs.limit(0), PATH, new_path(spark, "tokens"))
    assert empty.files == () and token_files.read_documents(spark, empty).count() == 0


def test_writing_twice_gives_the_same(spark):
    docs = spark.createDataFrame([(i % 7, f"t{i}") for i in range(50)], "doc_id long, text string")
    read = lambda n: [tuple(r) for r in token_files.read_documents(spark, token_files.write_token_files(docs.repartition(n), PATH, new_path(spark, "tokens"))).orderBy("start").collect()]
    assert read(2) == read(5)
