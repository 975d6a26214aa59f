import random
from collections import Counter

import numpy as np
import pytest
from conftest import SF, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from shellac.llm import ngram_join, queries
from shellac.llm.components import connected_components
from shellac.llm.prefix_tree import counted_links, links
from shellac.llm.shingles import shingle_sets


def shingles(text, size):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def roots(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def similar(a, b, percent):
    o = len(a & b)
    return o > 0 and 100 * o >= percent * (len(a) + len(b) - o)


def brute(rows, size=4, percent=85):
    sets = [shingles(t, size) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j], percent)]
    root, ends = roots(len(rows), pairs), Counter(k for p in pairs for k in p)
    names: dict = {}
    for r, (d, _) in zip(root, rows):
        if d is not None:
            names[r] = min(d, names.get(r, d))
    return sorted(((d, len(s), names.get(r) if s else d, ends[k]) for k, ((d, _), s, r) in enumerate(zip(rows, sets, root))), key=str)


def family(r, n, words, edits, start):
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        own = base.copy()
        for _ in range(r.randint(0, edits)):
            own[r.randrange(words)] = f"e{r.randrange(10**6)}"
        out.append((start + i, " ".join(own)))
    return out


@pytest.fixture
def corpus():
    r = random.Random(4)
    line = " ".join(f"common{i}" for i in range(14))
    rows = family(r, 60, 120, 3, 0) + family(r, 40, 200, 12, 100) + family(r, 30, 40, 2, 200)
    rows += [(300 + i, line + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randint(5, 60)))) for i in range(80)]
    rows += [(400, "One TWO three"), (401, "one two three"), (402, "one two"), (403, ""), (404, None), (405, " \n"), (406, "q " * 40_000), (407, "Q " * 30_000), (400, "one two three"), (None, "one two three"), (None, "lonely text here now")]
    return rows


def grouped(spark, rows, **k):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, key int")
    return sorted((tuple(r) for r in ngram_join.similar_groups(df, **k).collect()), key=str)


def test_groups_equal_brute_force(spark, corpus):
    assert grouped(spark, corpus) == brute(corpus)


def test_other_paths_give_the_same(spark, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", 3)
    monkeypatch.setattr(ngram_join, "FAMILY", 16)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "TASK_SETS", 20)
    assert grouped(spark, corpus) == brute(corpus)
    assert grouped(spark, corpus, size=5, percent=80) == brute(corpus, 5, 80)


def test_one_frequent_token_only_is_put_last(spark, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", 3)
    monkeypatch.setattr(ngram_join, "FREQUENT_TOKENS", 1)
    monkeypatch.setattr(ngram_join, "FAMILY", 8)
    assert grouped(spark, corpus, percent=70) == brute(corpus, percent=70)


def test_no_rows(spark):
    assert grouped(spark, []) == [] and grouped(spark, [(1, None), (2, "")]) == [(1, 0, 1, 0), (2, 0, 2, 0)]


def test_keep_one(spark, corpus):
    rows = [*corpus, corpus[0], (408, "words of a text that stands alone here")]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, _x string")
    kept = ngram_join.keep_one(df, 4, 85)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    best: dict = {}
    sets = [shingles(t, 4) for _, t in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j], 85)])
    for k, (d, _) in zip(root, rows):
        best[k] = min(best.get(k, (True, 0)), (d is None, d or 0)) if k in best else (d is None, d or 0)
    assert len(got) == len(best)
    assert sorted(str(d) for d, _ in got) == sorted(str(None if b[0] else b[1]) for b in best.values())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 12), min_size=1, max_size=10), min_size=1, max_size=12), st.sampled_from([50, 80, 85, 100]))
def test_prefix_tree_equals_brute_force(sets, percent):
    arrays = [np.array(sorted(s), np.int64) for s in sets]
    found = links(arrays, range(len(sets)), range(len(sets)), percent)
    assert all(similar(sets[a], sets[b], percent) for a, b in found)
    want = [(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j], percent)]
    assert roots(len(sets), found) == roots(len(sets), want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 12), min_size=1, max_size=10), min_size=1, max_size=12), st.sampled_from([50, 80, 85]), st.integers(0, 12), st.randoms())
def test_counts_of_links_equal_brute_force(sets, percent, cut, r):
    arrays, weights = [np.array(sorted(s), np.int64) for s in sets], np.array([r.randint(1, 5) for _ in sets])
    near = [[i != j and similar(a, b, percent) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    found, counts = counted_links(arrays, range(len(sets)), range(len(sets)), percent, weights)
    assert counts.tolist() == [sum(w for w, hit in zip(weights, row) if hit) for row in near]
    assert roots(len(sets), found) == roots(len(sets), links(arrays, range(len(sets)), range(len(sets)), percent))
    apart = counted_links(arrays, range(min(cut, len(sets))), range(cut, len(sets)), percent, weights)[1]
    assert apart.tolist() == [sum(w for j, (w, hit) in enumerate(zip(weights, row)) if hit and (i < cut) != (j < cut)) for i, row in enumerate(near)]


def test_a_large_group_is_counted_without_listing_pairs():
    r = random.Random(8)
    base = np.arange(400)
    sets = [np.union1d(np.delete(base, r.sample(range(400), r.randint(0, 30))), r.sample(range(1000, 5000), 10)).astype(np.int64) for _ in range(1500)]
    marked = np.zeros((len(sets), 5000), np.int32)
    for k, s in enumerate(sets):
        marked[k, s] = 1
    shared, sizes = (marked.astype(np.float32) @ marked.T.astype(np.float32)).astype(np.int64), marked.sum(axis=1)
    near = 185 * shared >= 85 * (sizes[:, None] + sizes)
    found, counts = counted_links(sets, range(len(sets)), range(len(sets)), 85, np.ones(len(sets)))
    assert counts.tolist() == (near.sum(axis=1) - 1).tolist() and len(found) < len(sets)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbé \n\t\xa0"), max_size=30), max_size=6), st.integers(1, 5))
def test_shingles_equal_brute_force(texts, size):
    got = shingle_sets([t.encode() for t in texts], size)
    want = [shingles(t, size) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    assert [[set(a) == set(b) for a in map(tuple, got)] for b in map(tuple, got)] == [[a == b for a in want] for b in want]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 164)] + [(5, i) for i in range(200, 260)] + [(7, 7), (None, 3), (5, 200)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 100 for i in range(100, 165)} | {i: 5 for i in [5, *range(200, 260)]}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_equals_its_sql(spark, duck):
    assert rows_of(queries.op10_ngram_join(spark, SF).toPandas()) == rows_of(duck.sql(queries.OP10_SQL).df())
