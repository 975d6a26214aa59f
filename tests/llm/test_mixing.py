import re

import pytest
from conftest import SF

from shellac.llm import mixing, queries


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    full: set = set()
    while True:
        rest = [n for n in names if n not in full]
        level = (share * sum(sizes.values()) - sum(most * sizes[n] for n in full)) / max(1, sum(weight[n] for n in rest))
        over = {n for n in rest if level * weight[n] > most * sizes[n]}
        if not over:
            return {n: most * sizes[n] if n in full else level * weight[n] for n in names}
        full |= over


def check(rows, texts_of):
    """Rows hold source; sizes, targets, budgets and limits are held against brute force."""
    sizes: dict = {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts_of(r) or ""))
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    targets = brute_targets(sizes)
    for n, size in sizes.items():
        own = [r for r in rows if r["source"] == n]
        assert {r["source_size"] for r in own} == {size}
        assert all(r["target"] == pytest.approx(targets[n], rel=1e-12) for r in own)
        assert abs(sum(r["taken"] for r in own) - targets[n]) <= 0.5 + 1e-6 + len(own) * (len({r["doc_id"] for r in own}) < len(own))


def test_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [r.asDict() | {"source": docs[r["doc_id"]]["source"]} for r in queries.op8_mix_sources(spark, SF).collect()]
    assert len(got) == len(docs)
    check(got, lambda r: docs[r["doc_id"]]["text"])
    again = {r["doc_id"]: r["taken"] for r in queries.op8_mix_sources(spark, SF).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_edge_rows(spark):
    rows = [(None, "a b c", None, 1)] * 3 + [(i, "w " * (i % 40), ["x", "é", "Z", "hot"][min(3, i % 9)], 1) for i in range(300)] + [(1, None, "x", 1), (2, "", "void", 1), (7, "long " * 60_000, "y", 1), (7, "long " * 60_000, "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    mixed = mixing.mix(df)
    assert mixed.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken", "copies"]
    got = [r.asDict() for r in mixed.collect()]
    assert len(got) == len(rows)
    check(got, lambda r: r["text"])
    key = lambda r: (str(r["doc_id"]), str(r["text"]), str(r["source"]), r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, (r.asDict() for r in mixing.mix(df.repartition(5)).collect())))
    assert mixing.mix(df.limit(0)).count() == 0


def test_whole_documents_come_near_the_targets(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 30), f"s{i % 7 % 3}") for i in range(2000)], "doc_id long, text string, source string")
    mixed = mixing.mix(df)
    taken = mixing.take(mixed)
    assert taken.columns == df.columns
    for r in mixed.groupBy("source").agg({"target": "max"}).collect():
        words = sum(len(x["text"].split()) for x in taken.where(taken.source == r["source"]).collect())
        assert abs(words - r["max(target)"]) <= 30


def test_more_ranges_give_the_same(spark, monkeypatch):
    want = {r["doc_id"]: r["taken"] for r in queries.op8_mix_sources(spark, SF).collect()}
    monkeypatch.setattr(mixing, "BLOCK_BITS", 2)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 3)
    assert {r["doc_id"]: r["taken"] for r in queries.op8_mix_sources(spark, SF).collect()} == want
