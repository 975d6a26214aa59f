"""Quality rules: exact counts of a text, and a calibrated model on hashed word and character n-grams.

Both are worked out in Arrow batches; the model reads the batch's bytes at once with numpy.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shellac.llm.common import bound_batches, release_memory
from shellac.llm.linear import Ftrl, platt, sigmoid

BITS = 17
#: Bytes of text worked through at a time.
GROUP_BYTES = 1_000_000
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; words are ``[^\\x20\\x09-\\x0D]+``."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    bare = raw.translate(None, b" \t\n\v\f\r")
    chars = len(bare) if bare.isascii() else len(bare.decode("utf-8", "surrogatepass"))
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(b" \t\v\f\r"):
            seen.add(line)
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    distinct = set(windows)
    if len(distinct) != len(windows):
        once, more = set(), set()
        for x in windows:
            (more if x in once else once).add(x)
        upto = 0
        for i, x in enumerate(windows):
            if x in more:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    symbols = len(_SYMBOLS.findall(text)) if any(c in text for c in "#*$%&|<>") else 0
    return n, chars, symbols, dup, repeated


def fails_base(n_words: int, n_repeat_words: int) -> bool:
    """Fewer than 50 words, or more than half of them in repeated 3-word windows."""
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def _mix(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int32)


def hashed_features(texts: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (text index, feature) arrays, one entry for each place: characters 3-grams (bytes), words, word pairs.

    Grams and pairs don't reach across texts; texts are joined by a space, which is white space to all of them.
    """
    if not texts:
        return
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    b = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    u = b.astype(np.uint64)
    space = _SPACE[b]
    if len(b) >= 3:
        gram = u[:-2] | u[1:-1] << np.uint64(8) | u[2:] << np.uint64(16)
        inside = owner[:-2] == owner[2:]
        yield owner[:-2][inside], _mix(gram[inside] + np.uint64(1))
    with np.errstate(over="ignore"):
        powers = np.full(len(b), _ODD)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((u + np.uint64(1)) * powers)])
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        stops = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
        back = np.full(len(b), _INVERSE)
        back[0] = 1
        back = np.multiply.accumulate(back)
        word = (total[stops] - total[starts]) * back[starts]
        of = owner[starts]
        yield of, _mix(word ^ np.uint64(0x5555555555555555))
        same = of[1:] == of[:-1]
        pair = (word[:-1] * np.uint64(31) + word[1:])[same]
        yield of[1:][same], _mix(pair ^ np.uint64(0x3333333333333333))


@dataclass(frozen=True)
class QualityModel:
    """Weights of relative frequencies, one table for each family of n-grams, the offset and the calibration."""

    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def scores(self, texts: Sequence[bytes]) -> np.ndarray:
        """Calibrated probability of good quality for each whole text."""
        out = np.empty(len(texts))
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= GROUP_BYTES):
                size += len(texts[upto])
                upto += 1
            raw = np.full(upto - at, self.offset)
            for family, (owner, f) in enumerate(hashed_features(texts[at:upto])):
                n = np.bincount(owner, minlength=upto - at)
                raw += np.bincount(owner, self.weights[family][f], minlength=upto - at) / np.maximum(n, 1)
            out[at:upto] = raw
            at = upto
        return sigmoid(self.slope * out + self.shift)


def fit(examples: Sequence[tuple[str, int]], epochs: int = 6, scale: float = 20.0, seed: int = 3, true: Sequence[int] | None = None) -> QualityModel:
    """Train on (text, label) pairs: three quarters fit the weights, one quarter the calibration.

    A text's features are relative frequencies, so long and short texts weigh alike. ``true`` has the numbers of labels 0 and 1 that
    the examples were taken from: the calibration is moved from the examples' shares to theirs, so that a score doesn't depend
    on how many of each were taken. Without examples every text gets 0.5.
    """
    size = 1 << BITS
    if not examples:
        return QualityModel(np.zeros((3, size), np.float32), 0.0, 1.0, 0.0)
    rng = np.random.default_rng(seed)
    rows = []
    for t, y in examples:
        at, x = [], []
        for family, (_, f) in enumerate(hashed_features([t.encode("utf-8", "surrogatepass")])):
            ids, n = np.unique(f, return_counts=True)
            at.append(ids.astype(np.int64) + family * size)
            x.append(n / max(1, n.sum()) * scale)
        rows.append((np.concatenate([*at, [3 * size]]).astype(np.int64), np.concatenate([*x, [1.0]]), float(y)))
    order = rng.permutation(len(rows))
    held, used = order[: len(rows) // 4], order[len(rows) // 4 :]
    model = Ftrl(3 * size + 1, alpha=0.5, l1=0.0, l2=0.1)
    for _ in range(epochs):
        for k in rng.permutation(used):
            model.learn(*rows[k])
    w = model.weights()
    slope, shift = platt([float(w[rows[k][0]] @ rows[k][1]) for k in held], [int(rows[k][2]) for k in held])
    n = [sum(y == k for _, y in examples) for k in (0, 1)]
    if true and all(true) and all(n):
        shift += math.log(true[1] / true[0] * n[0] / n[1])
    return QualityModel((w[:-1] * scale).reshape(3, size).astype(np.float32), float(w[-1]), slope, shift)


def class_counts(labels: DataFrame) -> list[int]:
    """Numbers of ids with quality 0 and 1 among all labels; nulls are left out."""
    known = _known(labels).groupBy("_y").agg(F.count("*").alias("n")).collect()  # two rows
    return [sum(r["n"] for r in known if r["_y"] == k) for k in (0, 1)]


def _known(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("_y")).distinct()


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = 1500) -> list[tuple[str, int]]:
    """At most ``sample`` labelled texts of each class, the first by a hash of doc_id; nulls are left out."""
    known = _known(labels)
    out: list[tuple[str, int]] = []
    for y in (0, 1):
        chosen = known.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
        found = texts.select("doc_id", "text", F.xxhash64("doc_id").alias("_h"), F.xxhash64("text").alias("_t")).orderBy("_h", "doc_id", "_t").limit(sample)
        out += [(r["text"], y) for r in found.collect()]
    return out


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality_score", "kept")


def judge(docs: DataFrame, model: QualityModel, threshold: float = 0.2, text: str = "text") -> DataFrame:
    """Add the counts, base_failed, quality_score and kept to every row, in Arrow batches and without a shuffle.

    ``kept`` is false where the base rules fail, else whether the score reaches the fixed threshold. Null texts count as
    empty and fail; lines are compared whole; columns of the added names are replaced. Only the results come back from
    Python.
    """
    bound_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ADDED]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 3 * 2**BITS weights
    kinds = [T.LongType()] * 5 + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    result = T.StructType([T.StructField(c, k) for c, k in zip(ADDED, kinds)])

    def run(texts: pa.Array) -> pa.Array:
        m, columns = shared.value, [[] for _ in ADDED]
        for i in range(0, len(texts), 512):
            own = [t or "" for t in texts.slice(i, 512).to_pylist()]
            found = [counts(t) for t in own]
            failed = [fails_base(x[0], x[4]) for x in found]
            score = m.scores([t.encode("utf-8", "surrogatepass") for t in own]).tolist()
            for k in range(5):
                columns[k] += [x[k] for x in found]
            columns[5] += failed
            columns[6] += score
            columns[7] += [not f and s >= threshold for f, s in zip(failed, score)]
        release_memory()
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(ADDED))

    judged = F.arrow_udf(run, result).asNondeterministic()  # else a filter on the verdict would have it made twice
    rows = docs.select(*[F.col(f"`{c}`") for c in names], judged(F.col(f"`{text}`")).alias("_judged"))
    return rows.select(*[F.col(f"`{c}`") for c in names], "_judged.*")
