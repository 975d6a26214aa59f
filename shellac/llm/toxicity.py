"""Toxicity classifier on hashed word and word-part features, evened out between groups of people.

Sentences that name a group are repeated with another group's term; a penalty draws the score change to 0, so that
the mention of a group alone does not count for toxic.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shellac.llm.common import bound_batches, discard, materialise, release_memory
from shellac.llm.linear import sigmoid

#: Terms that stand for one another in counterfactual sentences, by kind.
IDENTITY_TERMS = (
    ("he", "she", "they"),
    ("him", "her", "them"),
    ("his", "hers", "theirs"),
    ("man", "woman", "person"),
    ("men", "women", "people"),
    ("boy", "girl", "child"),
    ("boys", "girls", "children"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("old", "young"),
    ("immigrant", "native", "refugee"),
    ("immigrants", "natives", "refugees"),
    ("disabled", "blind", "deaf"),
)
BITS = 20
#: Distinct words kept with their features per worker; the memo starts anew beyond it.
MEMO_WORDS = 120_000
#: The same while features are made for training.
FIT_WORDS = 30_000
#: Strength of the penalty on score changes.
EVENNESS = 2.0
_WORD, _SENTENCE = re.compile(r"\w+"), re.compile(r"[^.!?\n]+")


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word: the word, its openings of 4 to 6 letters, its parts of 5 letters."""
    names = ["w" + word]
    names += ["p" + word[:k] for k in (4, 5, 6) if len(word) > k]
    marked = f"^{word}$"
    names += ["c" + marked[i : i + 5] for i in range(len(marked) - 4)]
    return [zlib.crc32(x.encode()) >> (32 - BITS) for x in names]


def text_words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(text: str, memo: dict[str, list[int]] | None = None) -> np.ndarray:
    """Distinct hashed features of a whole text, ascending; ``memo`` keeps those of some words."""
    memo = {} if memo is None else memo
    found: set[int] = set()
    for w in text_words(text):
        own = memo.get(w)
        if own is None:
            if len(memo) >= FIT_WORDS:
                memo.clear()
            own = memo[w] = word_features(w)
        found.update(own)
    return np.sort(np.fromiter(found, np.int64, len(found)))


@lru_cache(8)
def _kinds(terms: Sequence[Sequence[str]]) -> dict[str, tuple[Sequence[str], int]]:
    return {w: (kind, i) for kind in terms for i, w in enumerate(kind)}


def swapped(sentence: str, terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> list[str]:
    """The sentence in lower case with its identity terms replaced, once for every other term of the largest kind in it: the
    k-th has each term replaced by the k-th after it in its kind. Empty without any term."""
    kinds, lower = _kinds(terms), sentence.lower()
    there = [kinds[w][0] for w in _WORD.findall(lower) if w in kinds]

    def after(k: int) -> str:
        return _WORD.sub(lambda m: (lambda kind, i: kind[(i + k) % len(kind)])(*kinds[m[0]]) if m[0] in kinds else m[0], lower)

    return [after(k) for k in range(1, max(map(len, there)))] if there else []


def score_changes(text: str, terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> list[list[int]]:
    """Distinct changes of the features when identity terms of a sentence are swapped: f + 1 for a new feature f, -f - 1 for one
    that is gone."""
    out: set[tuple[int, ...]] = set()
    for sentence in _SENTENCE.findall(text):
        a = None
        for other in swapped(sentence, terms):
            a, b = a or text_words(sentence), text_words(other)
            gone, new = ({f for w in x for f in word_features(w)} for x in (a - b, b - a))
            out.add((*sorted(f + 1 for f in new - gone), *sorted(-f - 1 for f in gone - new)))
    return [list(x) for x in sorted(out) if x]


@dataclass
class ToxicModel:
    """Nonzero weights by hashed feature, and the offset."""

    weights: dict[int, float]
    offset: float
    _memo: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "offset": self.offset, "_memo": {}}

    def score(self, text: str) -> float:
        """Probability of label 1 for a whole text; an empty text gets the offset's."""
        memo, hits = self._memo, set()
        for w in text_words(text):
            own = memo.get(w)
            if own is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                own = tuple(f for f in word_features(w) if f in self.weights)
                if len(w) <= 40:
                    memo[w] = own
            if own:
                hits.update(own)
        return float(sigmoid(self.offset + sum(map(self.weights.__getitem__, hits))))


def _p_values(counts: np.ndarray, totals: Sequence[float]) -> np.ndarray:
    """Of each feature (documents of label 0, of label 1), that a difference as large comes by chance: likelihood-ratio test."""
    found, all_docs = counts.sum(1).astype(float), max(1.0, float(sum(totals)))
    g = np.zeros(len(counts))
    for k, n in enumerate(totals):
        for seen, expected in ((counts[:, k], found * n / all_docs), (n - counts[:, k], (all_docs - found) * n / all_docs)):
            g += np.where((seen > 0) & (expected > 0), seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-9)), 0.0)
    return np.array([math.erfc(math.sqrt(x)) for x in np.maximum(g, 0.0)])


def chosen_features(ids: np.ndarray, counts: np.ndarray, totals: Sequence[float], named: set[int], false_share: float = 0.01, floor: int = 64) -> np.ndarray:
    """Features that the model may use: those that differ between the classes, with an expected share of at most ``false_share``
    of chance finds among them (Benjamini-Hochberg), the ``floor`` most different ones in any case, so that few labels
    give a model too, and those of identity terms that occur, so that the penalty has something to hold on to."""
    if not len(ids):
        return ids
    p = _p_values(counts, totals)
    order = np.lexsort((ids, p))
    passed = np.flatnonzero(p[order] <= false_share * np.arange(1, len(ids) + 1) / len(ids))
    keep = np.zeros(len(ids), bool)
    keep[order[: max(floor, passed[-1] + 1 if len(passed) else 0)]] = True
    keep |= np.isin(ids, list(named))
    return np.sort(ids[keep])


def _solve(rows: Sequence[tuple[int, np.ndarray, Sequence[Sequence[int]]]], keep: np.ndarray, weights: Sequence[float], evenness: float, l1: float, l2: float, rounds: int) -> ToxicModel:
    """Weights of the kept features that minimise log loss + l1 |w| + l2 / 2 w**2 + evenness / 2 * (score change)**2, the changes of
    a text sharing one weight; accelerated proximal steps on sparse rows, each coordinate with a bound on its curvature."""
    free = len(keep)
    at_of = lambda f: np.searchsorted(keep, f[np.isin(f, keep)])
    at, own, spots, signs, held = [], [], [], [], []
    for _, found, changes in rows:
        x = at_of(np.asarray(found, np.int64))
        at.append(np.append(x, free))
        own.append(len(x) + 1)
        for c in changes:
            c = np.asarray(c, np.int64)
            c = c[np.isin(np.abs(c) - 1, keep)]
            if len(c):
                spots.append(np.searchsorted(keep, np.abs(c) - 1))
                signs.append(np.sign(c).astype(float))
                held.append(1.0 / len(changes))
    size = free + 1
    flat, own = np.concatenate(at), np.array(own)
    y = np.array([r[0] for r in rows], float)
    importance = np.array([weights[r[0]] for r in rows])
    begin = np.concatenate([[0], np.cumsum(own)[:-1]])
    curve = 0.25 * np.bincount(flat, np.repeat(importance * own, own), minlength=size) + l2
    if spots:
        each = np.array([len(c) for c in spots])
        c_flat, c_sign, c_begin = np.concatenate(spots), np.concatenate(signs), np.concatenate([[0], np.cumsum(each)[:-1]])
        strength = evenness * np.array(held)
        curve += np.bincount(c_flat, np.repeat(strength * each, each), minlength=size)
    shrink = np.append(np.full(free, l1), 0.0) / curve
    w = ahead = np.zeros(size)
    t = 1.0
    for _ in range(rounds):
        miss = importance * (sigmoid(np.add.reduceat(ahead[flat], begin)) - y)
        slope = np.bincount(flat, np.repeat(miss, own), minlength=size) + l2 * ahead
        if spots:
            change = strength * np.add.reduceat(ahead[c_flat] * c_sign, c_begin)
            slope += np.bincount(c_flat, np.repeat(change, each) * c_sign, minlength=size)
        moved = ahead - slope / curve
        new = np.sign(moved) * np.maximum(np.abs(moved) - shrink, 0.0)
        if (ahead - new) @ (curve * (new - w)) > 0:  # overshot
            t = 1.0
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_next * (new - w)
        done, w, t = np.abs(new - w).max() < 1e-5, new, t_next
        if done:
            break
    return ToxicModel({int(keep[i]): float(w[i]) for i in np.flatnonzero(w[:-1])}, float(w[-1]))


def _named(terms: Sequence[Sequence[str]]) -> set[int]:
    return {f for kind in terms for w in kind for f in word_features(w)}


def _class_weights(totals: Sequence[float], true: Sequence[float] | None) -> list[float]:
    """Weights that give the sampled classes their shares among all labels, 1 on average."""
    if not true or not sum(true) or not sum(totals):
        return [1.0, 1.0]
    return [(a / sum(true)) / (n / sum(totals)) if n else 1.0 for a, n in zip(true, totals)]


def fit(examples: Iterable[tuple[str, int]], evenness: float = EVENNESS, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, l1: float = 0.1, l2: float = 0.05, rounds: int = 500) -> ToxicModel:
    """Train on (text, label) pairs here; ``train`` does the same with texts that stay on the executors. Without any example every
    text scores 0.5, with one class only, near that class."""
    rows = [(y, features(t), score_changes(t, terms)) for t, y in examples]
    if not rows:
        return ToxicModel({}, 0.0)
    ids, of = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
    label = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])
    counts = np.stack([np.bincount(of[label == k], minlength=len(ids)) for k in (0, 1)], 1)
    totals = [sum(r[0] == k for r in rows) for k in (0, 1)]
    often = counts.sum(1) > 1
    return _solve(rows, chosen_features(ids[often], counts[often], totals, _named(terms)), [1.0, 1.0], evenness, l1, l2, rounds)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = 2000) -> DataFrame:
    """text and y of at most ``sample`` texts of label 1 and twice as many of label 0, the first by a hash of doc_id.

    ``labels`` has doc_id and toxic, already without the rows that are held out. Null ids, labels and texts are left out;
    of several texts or labels of an id the hash of the text decides, so reruns agree.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("y")).distinct()
    out = []
    for y, n in ((1, sample), (0, 2 * sample)):
        chosen = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")  # at most n ids
        first = texts.select("text", "y", F.xxhash64("doc_id").alias("_h"), "doc_id", F.xxhash64("text").alias("_t")).orderBy("_h", "doc_id", "_t").limit(n)
        out.append(first.select("text", "y"))
    return out[0].unionByName(out[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = 2000, evenness: float = EVENNESS, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, l1: float = 0.1, l2: float = 0.05, rounds: int = 500) -> ToxicModel:
    """Fit on ``training_rows``, weighted by how often the labels are among all rows of ``labels``.

    Texts stay on the executors, which make their features and count them; the driver gets the counts (2**BITS at
    most) and, of each text, the features that were chosen.
    """
    spark = docs.sparkSession

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[int]] = {}
        for b in batches:
            for y, t in zip(b.column(1).to_pylist(), b.column(0).to_pylist()):
                columns = [pa.array([y], pa.int32()), pa.array([features(t, memo)], pa.list_(pa.int32())), pa.array([score_changes(t, terms)], pa.list_(pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays(columns, ["y", "features", "changes"])

    bound_batches(spark)
    spread = training_rows(docs, labels, sample).repartition(spark.sparkContext.defaultParallelism)
    made = materialise(spread.mapInArrow(make, "y int, features array<int>, changes array<array<int>>"), "examples")
    totals = [made.where(F.col("y") == k).count() for k in (0, 1)]
    if not sum(totals):
        discard(made)
        return ToxicModel({}, 0.0)
    true = [r["n"] for r in spark.range(2).join(labels.groupBy(F.col("toxic").alias("id")).agg(F.count("*").alias("n")), "id", "left").fillna(0).orderBy("id").select("n").collect()]
    by_feature = made.select("y", F.explode("features").alias("f")).groupBy("f").agg(F.sum(1 - F.col("y")).alias("c0"), F.sum("y").alias("c1")).where("c0 + c1 > 1")
    table = by_feature.toArrow().sort_by("f")
    counts = np.stack([table["c0"].to_numpy(), table["c1"].to_numpy()], 1)
    keep = chosen_features(table["f"].to_numpy().astype(np.int64), counts, totals, _named(terms))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.sort(x[np.isin(x, keep)]) for x in (np.array(x, np.int32) for x in b.column(1).to_pylist())]
            changes = [[c for c in ([v for v, k in zip(c, np.isin(np.abs(c) - 1, keep)) if k] for c in x) if c] for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32())), pa.array(changes, pa.list_(pa.list_(pa.int32())))], b.schema.names)

    few = made.mapInArrow(narrow, made.schema).toArrow()
    rows = sorted(zip(few["y"].to_pylist(), few["features"].to_pylist(), few["changes"].to_pylist()))
    discard(made)
    return _solve(rows, keep, _class_weights(totals, true), evenness, l1, l2, rounds)


def score(docs: DataFrame, model: ToxicModel, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 if at least ``threshold``) to every row, in Arrow batches.

    Null texts count as empty; whole texts are read; columns of the added names are replaced. No shuffle, and only
    scores come back from Python.
    """
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS weights

    def run(texts: pa.Array) -> pa.Array:
        m = shared.value
        scores = pa.array([m.score(t or "") for i in range(0, len(texts), 512) for t in texts.slice(i, 512).to_pylist()], pa.float64())
        release_memory()
        return scores

    scored = F.arrow_udf(run, T.DoubleType()).asNondeterministic()  # else a filter on the score would have it made twice
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], scored(F.col(f"`{text}`")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
