import random
import re
from collections import Counter

import numpy as np
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from shellac.llm import quality, queries


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t#é\xa0|日"), max_size=80))
def test_counts_equal_brute_force(text):
    assert quality.counts(text) == brute(text)


def good(r):
    return " ".join("".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 8))) for _ in range(r.randint(60, 200)))


def junk(r):
    return " ".join("".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 8))) + r.choice(["%%%", "$$$", " |", "!!"]) for _ in range(r.randint(60, 200)))


def test_held_out_accuracy_and_calibration():
    r = random.Random(1)
    rows = [(good(r), 1) for _ in range(300)] + [(junk(r), 0) for _ in range(300)]
    model = quality.fit(rows)
    test = [(good(r), 1) for _ in range(200)] + [(junk(r), 0) for _ in range(200)]
    p = model.scores([t.encode() for t, _ in test])
    assert ((p >= 0.5) == [bool(y) for _, y in test]).mean() >= 0.99
    assert np.abs(p - [y for _, y in test]).mean() < 0.1


def test_scores_follow_the_shares_of_all_labels():
    r = random.Random(5)
    mixed = lambda share: " ".join((good if r.random() < share else junk)(r) for _ in range(2))
    rows = [(mixed(0.7), 1) for _ in range(400)] + [(mixed(0.3), 0) for _ in range(400)]
    few = [(t, y) for i, (t, y) in enumerate(rows) if y or i % 8 == 0]
    even, told = quality.fit(rows, true=[50, 400]), quality.fit(few, true=[50, 400])
    texts = [mixed(0.5).encode() for _ in range(400)]
    plain = quality.fit(rows).scores(texts)
    assert even.scores(texts).mean() > plain.mean()
    odds = lambda p: np.log(p / (1 - p))
    assert np.allclose(odds(even.scores(texts)) - odds(plain), np.log(8)) and abs(told.scores(texts).mean() - even.scores(texts).mean()) < 0.1
    assert quality.fit(rows, true=[0, 3]).scores(texts).mean() == plain.mean()


def test_scores_do_not_depend_on_neighbours():
    r = random.Random(2)
    model = quality.fit([(good(r), 1) for _ in range(50)] + [(junk(r), 0) for _ in range(50)])
    texts = [b"", b" ", b"a", "é ".encode() * 50, good(r).encode(), b"x" * 100_000, b"", junk(r).encode()]
    alone = np.concatenate([model.scores([t]) for t in texts])
    assert np.allclose(model.scores(texts), alone, atol=1e-6) and ((0 <= alone) & (alone <= 1)).all()


def test_degenerate_training_sets():
    assert quality.fit([]).scores([b"x"])[0] == 0.5
    assert quality.fit([("a b c", 1)]).scores([b"a b"]).shape == (1,)


def test_edge_rows(spark):
    r = random.Random(3)
    model = quality.fit([(good(r), 1) for _ in range(80)] + [(junk(r), 0) for _ in range(80)])
    long = good(random.Random(9)) + " " + " ".join(good(r) for _ in range(300))
    rows = [(None, None, 1), (1, "", 1), (1, "", 1), (2, long, 1), (3, junk(r), 1), (4, "same words here " * 40, 1), (5, good(r), None)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, n_words int"), model)
    by = {x["doc_id"]: x for x in got.collect()}
    assert by[2]["kept"] and by[5]["kept"] and not by[3]["kept"]
    assert by[None]["base_failed"] and by[1]["base_failed"] and by[4]["base_failed"] and not by[4]["kept"]
    assert quality.judge(got.limit(0), model).columns == got.columns and quality.judge(got.limit(0), model).count() == 0


def test_query(spark):
    texts = {d["doc_id"]: d["text"] or "" for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op9_quality_rules(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for k, r in got.items():
        want = brute(texts[k])
        assert tuple(r[c] for c in quality.ADDED[:5]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["quality_score"] >= 0.2)
