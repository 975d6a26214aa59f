import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from shellac.llm import packing, queries, tokens
from shellac.llm.common import materialise

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  b", "a \n b", "\n\n", "foo\n \nbar", "don't 'tis it's", "x" * 5000, "É e\u0301 ß ẞ İ", "a\u00a0b\u2003c", "\x1cq\x85", "<|endoftext|> a<|endoftext|>", "日本語 text", "ab12cd, (x)!!", "a\r\nb\tc", "naïve... ¿qué?", "\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16")]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_ids_equal_the_librarys(path):
    own = tokens.WordTokenizer(path)
    for _ in range(2):  # the second time from the memo
        assert own.encode_many(ODD) == [array("I", own.library.encode(t, add_special_tokens=False).ids).tobytes() for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab.,'!É\u0301 \n\t\xa0s1Ωσς"), max_size=40), max_size=5))
def test_ids_equal_the_librarys_on_any_text(texts):
    for path in (WORDS, BYTES):
        own = tokens.load(path)
        assert own.encode_many(texts) == [array("I", own.library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


def test_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 50)
    own = tokens.WordTokenizer(BYTES)
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)]
    assert own.encode_many(texts) == [array("I", own.library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    for t in texts:  # one batch may go over the bound, the next starts a generation
        own.encode(t)
        assert len(own.old) <= 25 + 31 and len(own.young) <= 25


def test_a_long_text_is_worked_through_in_parts(monkeypatch):
    text = " ".join(f"w{i % 97}, é{i}\nb" for i in range(2000))
    want = {path: tokens.WordTokenizer(path).encode_many([text, "x", None]) for path in (WORDS, BYTES)}
    monkeypatch.setattr(tokens, "GROUP_BYTES", 400)
    for path in (WORDS, BYTES):
        own = tokens.WordTokenizer(path)
        assert own.encode_many([text, "x", None]) == want[path]
        assert want[path][0] == array("I", own.library.encode(text, add_special_tokens=False).ids).tobytes() and want[path][2] == b""


def check_layout(rows, capacity):
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_rule_minimises_the_sum_of_squares(lengths):
    where, offset = packing.place_sum_of_squares(np.array(lengths, np.int64), 32)
    fill: dict[int, int] = {}
    for s, b, o in zip(lengths, where.tolist(), offset.tolist()):
        gaps = [32 - f for f in fill.values() if f < 32]
        options = {None: [*gaps, 32 - s] if s < 32 else gaps}
        for g in set(gaps):
            if g >= s:
                rest = gaps.copy()
                rest.remove(g)
                options[g] = [*rest, g - s] if g > s else rest
        cost = {k: sum(v.count(x) ** 2 for x in set(v)) for k, v in options.items()}
        chosen = None if b not in fill else 32 - fill[b]
        assert cost[chosen] == min(cost.values())
        assert o == fill.get(b, 0) and o + s <= 32
        fill[b] = o + s


def test_query_equals_brute_force(spark):
    got = {(r["doc_id"], r["piece"]): r for r in queries.op1_best_fit_packing(spark, SF).collect()}
    library = tokens.load(WORDS).library
    want, total = {}, 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        for k, i in enumerate(range(0, len(ids), 4096)):
            own = ids[i : i + 4096]
            want[r["doc_id"], k] = (i, len(own), zlib.crc32(array("I", own).tobytes()))
    assert {k: (r["start"], r["length"], r["ids_crc32"]) for k, r in got.items()} == want
    n = check_layout(got.values(), 4096)
    assert n <= 1.03 * total / 4096 + 1


def test_edge_rows(spark):
    rows = [(None, None, "z"), (1, "", None), (1, "", None), (2, "word " * 20000, "s"), (2, "word " * 20000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    pieces = materialise(packing.tokenise_pieces(docs, WORDS, capacity=1000), "pieces")
    placed = packing.pack(pieces, 1000, shard_pieces=7)
    got = placed.collect()
    assert sum(r["length"] for r in got) == 3 + 2 * 20001 and len(got) == 3 + 2 * 21
    check_layout(got, 1000)
    sequences = packing.assemble(placed).collect()
    assert sum(len(r["ids"]) for r in sequences) == 4 * sum(r["length"] for r in got)
    assert packing.pack(pieces.limit(0)).count() == 0
    with pytest.raises(Exception, match="piece lengths"):
        packing.pack(pieces, 10).count()
