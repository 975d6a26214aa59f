from conftest import SF

import corpus_pipeline
from shellac.llm import mixing, ngram_join, toxicity
from shellac.llm.common import materialise
from shellac.llm.queries import table


def test_stages_keep_the_columns_and_their_decisions_take_effect(spark):
    docs = table(spark, SF, "documents")
    kinds, seen = docs.dtypes, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], SF)
        assert out.dtypes == kinds
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage{len(seen)}-{id(out)}"
        out.write.parquet(path)
        seen.append(spark.read.parquet(path))
    ids = [sorted(r["doc_id"] for r in d.select("doc_id").collect()) for d in seen]
    assert all(set(b) <= set(a) for a, b in zip(ids, ids[1:]))
    assert len(ids[1]) < len(ids[0]) and len(ids[2]) < len(ids[1]) and len(ids[3]) <= len(ids[2]) and len(set(ids[3])) == len(ids[3])
    groups = ngram_join.similar_groups(seen[2], 5, 80)
    assert ids[3] == sorted(r["doc_id"] for r in groups.where("doc_id = component_id").collect())
    mixed = {r["doc_id"]: r["copies"] for r in mixing.mix(seen[3]).collect()}
    assert ids[4] == sorted(d for d, n in mixed.items() for _ in range(n))
    packed = corpus_pipeline.pack_sequences(spark, seen[4], SF).collect()
    assert sorted({r["doc_id"] for r in packed}) == sorted(set(ids[4])) and sum(r["piece"] == 0 for r in packed) == len(ids[4])


def test_run_ends_with_packed_pieces(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0


def test_toxic_training_labels_reach_the_stage(spark):
    docs = table(spark, SF, "documents")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    model = corpus_pipeline.toxic_model(docs, table(spark, SF, "labels"))
    assert kept == {r["doc_id"] for r in docs.collect() if toxicity.ToxicModel.score(model, r["text"] or "") < 0.7}


def odd_documents(spark):
    """Documents with columns of the names that stages add, nulls in any column, repeated rows and ties."""
    from pyspark.sql import functions as F

    docs = table(spark, SF, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 7 > 0, F.col("source")).alias("source"))
    clash = ("size", "target", "taken", "copies", "source_size", "score", "predicted", "n_words", "kept", "base_failed", "_id", "_mark", "_own", "_shard", "sequence_id", "offset", "a.b", "_kept0")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id")) for c in clash})
    some = docs.where("doc_id < 20")
    nulls = some.withColumn("doc_id", F.lit(None).cast("long")).unionByName(some.withColumn("text", F.lit(None).cast("string")))
    return docs.unionByName(some).unionByName(nulls)


def test_odd_rows_and_clashing_columns_go_through_all_stages(spark):
    seen = materialise(odd_documents(spark), "odd")
    kinds = seen.dtypes
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        seen = materialise(stage(spark, seen, SF), f"odd{k}")
        assert seen.dtypes == kinds
    rows = seen.collect()
    assert rows and all(r["text"] for r in rows) and all(r["size"] == f"size:{r['score'][6:]}" and r["a.b"] == f"a.b:{r['score'][6:]}" for r in rows)
    known = [r for r in rows if r["doc_id"] is not None]
    assert all(r["kept"] == f"kept:{r['doc_id']}" for r in known)
    packed = corpus_pipeline.pack_sequences(spark, seen, SF).collect()
    assert sum(r["piece"] == 0 for r in packed) == len(rows)


def test_no_documents_go_through_all_stages(spark):
    seen = odd_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, SF)
        assert seen.count() == 0
    assert corpus_pipeline.pack_sequences(spark, seen, SF).count() == 0
