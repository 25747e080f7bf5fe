"""Quality scores learned from preferences: Bradley-Terry on text features.

A labelled good document is preferred to a labelled bad one. The score is linear in features of the
text, and the chance that one document is preferred to another is the logistic function of the
difference of their scores; Newton's method finds the weights from pairs of a bounded sample. The
threshold is a quantile of the sample's scores: where the bad share of all labelled documents ends.
A document's score between 0 and 1 is its chance against a document at the threshold, shifted so that the
threshold itself scores CUT.

A null text counts as empty and is scored as that. Null labels are no labels; a document labelled both
ways is in both classes. Where a class is missing there are no pairs and every document scores CUT, so
none is rejected. Repeated rows are scored alike, and empty tables give no rows. Other columns are
carried along by `accepted` and ignored by `score_documents`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import early, held_out

#: The score from which on a document is good.
CUT = 0.3
#: Labelled documents of each class that the weights are fitted on: the first by hash of the id.
SAMPLE = 4000
#: Preference pairs drawn for each document of the sample.
PAIRS = 20
RIDGE = 1e-3
SEED = 1

_SYMBOLS = b"#$%&*<>@\\^_{}~=+"
_CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": b"0123456789",
    "space": b" \t\n\x0b\x0c\r",
    "shout": b"!?",
    "bar": b"|",
    "symbol": _SYMBOLS,
    "stop": b".,;:",
    "beyond": bytes(range(128, 256)),
}
_OF_CLASS = np.zeros((256, len(_CLASSES)))
for _column, _bytes in enumerate(_CLASSES.values()):
    _OF_CLASS[list(_bytes), _column] = 1.0
#: Shares enter as they are and as how far they are along to these, beyond which they say no more.
_STEPS = (0.02, 0.1, 0.4)
_SHARES = (*list(_CLASSES), "repeated", "commonest", "again", "same_lines")


def features(text: bytes) -> np.ndarray:
    """What the score sees of a text: shares of kinds of characters, repetition, lengths."""
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    shares = counts @ _OF_CLASS / max(len(text), 1)
    words = text.split()
    n = len(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    distinct: dict[bytes, int] = {}
    for word in words:
        distinct[word] = distinct.get(word, 0) + 1
    repetition = [
        sum(map(eq, words, words[1:])) / max(n - 1, 1),
        max(distinct.values(), default=0) / max(n, 1),
        1 - len(distinct) / n if n else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
    ]
    x = np.concatenate([shares, repetition])
    steps = [np.minimum(x / step, 1.0) for step in _STEPS]
    sizes = [math.log1p(n), math.log1p(len(lines)), min(len(text) / max(n, 1), 30.0) / 10]
    return np.concatenate([x, *steps, sizes])


N_FEATURES = len(features(b""))


@dataclass(frozen=True)
class QualityModel:
    """score = logistic(weights . features + bias); the bias puts the threshold at CUT."""

    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int, ridge: float, seed: int) -> np.ndarray:
    """Weights that make the logistic loss of the differences good - bad least."""
    if not len(good) or not len(bad):
        return np.zeros(N_FEATURES)
    spread = np.concatenate([good, bad]).std(axis=0)
    spread[spread < 1e-9] = 1.0
    generator = np.random.default_rng(seed)
    n = pairs * max(len(good), len(bad))
    # Every document of either class is in as many pairs as any other of its class, give or take one.
    first = generator.permutation(np.arange(n) % len(good))
    second = generator.permutation(np.arange(n) % len(bad))
    difference = (good[first] - bad[second]) / spread
    weights = np.zeros(difference.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(difference @ weights, -30, 30)))  # chance of the wrong order
        gradient = difference.T @ p / n - ridge * weights
        curve = (difference * (p * (1 - p))[:, None]).T @ difference / n
        step = np.linalg.solve(curve + ridge * np.eye(len(weights)), gradient)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return weights / spread


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pairs: int = PAIRS,
        ridge: float = RIDGE, seed: int = SEED) -> QualityModel:
    """Learn from labels.quality of documents outside the evaluation fold.

    At most `sample` documents of each class are read; the share of bad ones is counted over all.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).filter(
        ~held_out(labels["doc_id"])
    )
    usable = usable.select(F.col("doc_id").alias("label_id"), "quality")
    share = {row["quality"]: row["count"] for row in usable.groupBy("quality").count().collect()}
    if len(share) < 2:
        return QualityModel(np.zeros(N_FEATURES), _logit(CUT))
    by_hash = F.xxhash64("label_id", F.lit(seed))
    chosen = [
        usable.filter((F.col("quality") == quality) & early(by_hash, sample, F.lit(share[quality])))
        .orderBy(by_hash, "label_id")
        .limit(sample)
        for quality in (0, 1)
    ]
    side = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample rows
    joined = docs.select("doc_id", "text").join(side, F.col("doc_id") == F.col("label_id"))
    found = joined.select("text", F.col("quality").cast("int"), "doc_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            x = [features(text or b"").tolist() for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("quality"),
                 pa.array(x, pa.list_(pa.float64()))],
                ["doc_id", "quality", "x"],
            )

    rows = found.mapInArrow(read, "doc_id bigint, quality int, x array<double>").collect()
    rows.sort(key=lambda row: (row["doc_id"], row["quality"], row["x"]))
    by_class = [
        np.array([row["x"] for row in rows if row["quality"] == quality]).reshape(-1, N_FEATURES)
        for quality in (0, 1)
    ]
    if not len(by_class[0]) or not len(by_class[1]):
        return QualityModel(np.zeros(N_FEATURES), _logit(CUT))
    weights = bradley_terry(by_class[1], by_class[0], pairs, ridge, seed)
    # The classes weigh as they do among all labelled documents.
    scores = [x @ weights for x in by_class]
    values = np.concatenate(scores)
    weight = np.concatenate([np.full(len(s), share[q] / len(s)) for q, s in enumerate(scores)])
    order = np.argsort(values, kind="stable")
    at = int(np.searchsorted(np.cumsum(weight[order]), share[0]))
    low, high = values[order][max(at, 0)], values[order][min(at + 1, len(values) - 1)]
    return QualityModel(weights, _logit(CUT) - float((low + high) / 2))


def score_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc (all columns of a document) and score, for every row."""
    packed = docs.select(F.struct(*docs.columns).alias("doc"))
    schema = T.StructType([*packed.schema.fields, T.StructField("score", T.DoubleType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("doc")
            texts = whole.field("text").cast(pa.binary()).to_pylist()
            x = np.array([features(text or b"") for text in texts]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([whole, pa.array(model.score(x))], ["doc", "score"])

    return packed.mapInArrow(read, schema)


def accepted(docs: DataFrame, model: QualityModel, cut: float = CUT) -> DataFrame:
    """The documents that score at least `cut`, as they came."""
    good = score_documents(docs, model).filter(F.col("score") >= cut)
    return good.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
