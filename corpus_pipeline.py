"""A corpus pipeline: toxic and poor documents go, one of each group of near copies stays, sources are mixed, and the mix is
packed into training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept, written as Parquet in between. Null texts
count as empty and are poor; a null source is a source; rows without a doc_id are judged like others; of repeated rows one stays;
an empty table gives empty results; columns beside those that a stage reads are carried along under any name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellac.llm import mixing, ngram_join, packing, quality, toxicity
from shellac.llm.common import discard, materialise, quoted
from shellac.llm.queries import quality_model, table, tokenizer_file, toxic_model

#: Words that a worker keeps with their ids while it packs; the workers of the earlier stages still hold memory of their own.
MEMO_WORDS = 150_000


#: The columns that a stage may read.
READ = ("doc_id", "text", "source")


def aside(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with all columns that it doesn't read under names of their own while it runs, so that none clashes with a column
    that it adds, and with the columns of the documents again behind it."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = {c: c if c in READ else f"_kept{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(quoted(c)).alias(own) for c, own in held.items()]), sf_dir)
        return out.select(*[F.col(own).alias(c) for c, own in held.items()])

    return run_stage


@aside
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on those with labels, does not call toxic."""
    scored = toxicity.score(docs, toxic_model(docs, table(spark, sf_dir, "labels")))
    return scored.where("predicted = 0")


@aside
def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the quality model keep."""
    judged = quality.judge(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return judged.where("kept")


@aside
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a Jaccard of 0.8 or more."""
    return ngram_join.keep_one(docs, size=5, percent=80)


@aside
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, some of them twice, so that each source comes near its target."""
    return mixing.take(mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of the mix in sequences of 4096 tokens."""
    pieces = packing.tokenise_pieces(docs, tokenizer_file("word_bpe_49k.json"), memo_words=MEMO_WORDS)
    return packing.pack(materialise(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express the models, the tokenizer or the packing; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table; every stage but the last is written and read again, and its table removed when the
    next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
        if k:
            discard(before)  # the last stage has written its pieces
    return docs
