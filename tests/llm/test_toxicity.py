import random
import zlib

from conftest import SF
from pyspark.sql import functions as F

from shellac.llm import queries, toxicity


def corpus(n, seed, toxic=0.3, group=0.0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioustrnl") for _ in range(r.randint(3, 8)))
    out = []
    for _ in range(n):
        words = [word() for _ in range(r.randint(5, 120))]
        y = r.random() < toxic
        if y:
            words[r.randrange(len(words))] = r.choice(["idiot", "scumbag", "scumheads"])
        if r.random() < (0.9 if y else group):
            words[r.randrange(len(words))] = "muslim"
        out.append((" ".join(words) + ".", int(y)))
    return out


def test_held_out_accuracy():
    model = toxicity.fit(corpus(600, 1, group=0.9))
    test = corpus(400, 2, group=0.9)
    hits = sum((model.score(t) >= 0.5) == bool(y) for t, y in test)
    assert hits >= 0.98 * len(test)


def neutral_mentions(n, seed):
    """Texts that name a group and hold nothing toxic."""
    return [f"{t[:-1]} muslim." for t, y in corpus(n, seed, toxic=0.0)]


def test_penalty_lowers_false_positives_on_neutral_mentions_at_the_defaults():
    """Some of the texts that were labelled toxic do no more than name a group, which few others name."""
    data, neutral = corpus(600, 3, group=0.02) + [(t, 1) for t in neutral_mentions(40, 5)], neutral_mentions(300, 4)
    free, even = toxicity.fit(data, evenness=0.0), toxicity.fit(data)
    falsely = lambda m: sum(m.score(t) >= 0.5 for t in neutral)
    gap = lambda m: abs(m.score("the muslim ate") - m.score("the jewish ate"))
    assert falsely(free) > 10 and falsely(even) < 0.5 * falsely(free)
    assert gap(even) < 0.5 * gap(free)
    assert sum(even.score(t) >= 0.5 for t, y in corpus(300, 6, toxic=1.0)) >= 290


def test_swapping_goes_through_every_term_of_a_kind():
    assert toxicity.swapped("He met a Muslim.") == ["she met a jewish.", "they met a hindu.", "he met a buddhist.", "she met a atheist.", "they met a christian."]
    assert toxicity.swapped("Young.") == ["old."] and toxicity.swapped("nothing here") == []
    changes = toxicity.score_changes("young here. Young there! none")
    assert len(changes) == 1 and {abs(x) - 1 for x in changes[0]} <= set(toxicity.word_features("young") + toxicity.word_features("old"))


def test_degenerate_training_sets():
    assert toxicity.fit([]).score("x") == 0.5
    assert toxicity.fit([("a b", 1)] * 5).score("a") > 0.5 > toxicity.fit([("a b", 0)] * 5).score("a")
    assert 0 <= toxicity.fit(corpus(50, 4)).score("") <= 1


def test_edge_rows(spark):
    model = toxicity.fit(corpus(300, 5))
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "clean words " * 30_000 + "idiot", 3), (3, "fine", None)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score long"), model)
    assert got.columns == ["doc_id", "text", "score", "predicted"] and dict(got.dtypes)["score"] == "double"
    scores = [r["score"] for r in got.orderBy("doc_id").collect()]
    assert scores[0] == scores[1] == scores[2] == model.score("") and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(got.limit(0), model).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.training_rows(*empty).count() == 0 and toxicity.train(*empty).score("x") == 0.5


def test_training_sample_is_bounded_and_skips_nulls(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(100)] + [(5, "again"), (None, "n"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (3, None), (4, 9), (200, 1)], "doc_id long, toxic int")
    rows = sorted(toxicity.training_rows(docs, labels, sample=10).collect())
    assert sum(r["y"] for r in rows) == 10 and len(rows) == 30
    assert rows == sorted(toxicity.training_rows(docs.repartition(3), labels.repartition(2), sample=10).collect())


def test_training_on_executors_equals_training_here(spark):
    data = corpus(200, 7, group=0.1)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)], "doc_id long, toxic int")
    here, there = toxicity.fit(data), toxicity.train(docs, labels)
    assert here.weights.keys() == there.weights.keys() and all(abs(here.weights[f] - there.weights[f]) < 1e-6 for f in here.weights)


def test_class_weights_undo_the_shares_of_the_sample():
    assert toxicity._class_weights([200, 100], [900, 100]) == [0.9 * 1.5, 0.1 * 3] and toxicity._class_weights([0, 0], None) == [1.0, 1.0]


def test_query_uses_no_held_out_labels(spark):
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert got.keys() == {d["doc_id"] for d in docs}
    for k, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7)


def test_held_out_labels_change_nothing(spark):
    docs, labels = (queries.table(spark, SF, x) for x in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(queries._held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert labels.exceptAll(flipped).count() > 0
    a, b = queries.toxic_model(docs, labels), queries.toxic_model(docs, flipped)
    assert a.weights and a == b


def test_penalty_changes_the_model_of_the_query(spark):
    docs, labels = (queries.table(spark, SF.replace("0.001", "0.01"), x) for x in ("documents", "labels"))
    known = labels.where(~queries._held_out(F.col("doc_id")))
    assert toxicity.train(docs, known).weights != toxicity.train(docs, known, evenness=0.0).weights
