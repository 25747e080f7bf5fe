"""Language identification in two steps: the family first, then the languages within it.

Texts are lower-cased, reduced to letters and single spaces, and described by the hashed counts of their
runs of one to three characters. One-versus-one linear support vector machines tell the families apart,
and others the languages of a family; the most votes win, ties by the sum of the margins. Every machine
is trained in a task of its own, on at most SAMPLE documents of each of its languages.

A text that is null or has no letter is `und` with score 0. Null languages are not learned; if no
language is learned, everything is `und`; if only one is, it is all that is predicted, with score 1.
Repeated rows get the same prediction, empty tables give no rows, other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import early, held_out

#: Documents of a language that are learned from: the first by hash of the id.
SAMPLE = 1000
#: The machines' number and the broadcast of their weights grow with the languages; more are refused.
MAX_LANGUAGES = 500
SIZE = 4096
COST = 10.0
EPOCHS = 25
SEED = 2
UNKNOWN = "und"

#: Languages of a family by their codes; a language in none of them is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fo", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tt", "tk"),
    "uralic": ("fi", "et", "hu"),
    "indo_aryan": ("hi", "ur", "bn", "mr", "gu", "pa", "ne"),
    "semitic": ("ar", "he", "am", "mt"),
}

_NO_LETTER = re.compile(r"[\W\d_]+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
#: Characters described at a time, which bounds the memory that a long text takes.
_PIECE = 1 << 18


def family_of(lang: str) -> str:
    """A name that no language has."""
    code = re.split("[-_]", lang.lower())[0]
    return next((name for name, codes in FAMILIES.items() if code in codes), code) + " family"


def describe(text: str) -> np.ndarray | None:
    """Unit vector of the square roots of the hashed counts; None without a letter."""
    if not any(map(str.isalpha, text)):
        return None
    counts = np.zeros(SIZE)
    for first in range(0, len(text), _PIECE):
        piece = " " + _NO_LETTER.sub(" ", text[first : first + _PIECE].lower()) + " "
        codes = np.frombuffer(piece.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
        hashed = codes * _FACTORS[0]
        for width in (1, 2, 3):
            if width > 1:
                hashed = (hashed[:-1] ^ (hashed[:-1] >> np.uint64(29))) * _FACTORS[
                    width - 1
                ] + codes[width - 1 :] * _FACTORS[0]
            counts += np.bincount((hashed >> np.uint64(52)).astype(np.int64), minlength=SIZE)
    vector = np.sqrt(counts)
    return (vector / np.linalg.norm(vector)).astype(np.float32)


def train_machine(x: np.ndarray, sign: np.ndarray, cost: float, epochs: int, seed: int) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss, by dual coordinate descent.

    The last weight is the bias.
    """
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    weights = np.zeros(x.shape[1])
    alpha = np.zeros(len(x))
    diagonal = np.einsum("ij,ij->i", x, x) + 0.5 / cost
    generator = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in generator.permutation(len(x)):
            slope = sign[i] * (x[i] @ weights) - 1 + alpha[i] * 0.5 / cost
            new = max(0.0, alpha[i] - slope / diagonal[i])
            if new != alpha[i]:
                weights += (new - alpha[i]) * sign[i] * x[i]
                largest = max(largest, abs(new - alpha[i]))
                alpha[i] = new
        if largest < 1e-3:
            break
    return weights


@dataclass(frozen=True)
class LanguageModel:
    """languages, the family of each, and the machines: which of two names a positive margin favours."""

    languages: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray

    def _vote(self, names: list[str], margin: dict[tuple[str, str], float]) -> tuple[str, float]:
        """The name with the most votes, and its least margin against another."""
        votes = {name: [0, 0.0, np.inf] for name in names}
        for a, b in combinations(names, 2):
            value = margin[a, b]
            for name, mine in ((a, value), (b, -value)):
                votes[name][0] += mine > 0
                votes[name][1] += mine
                votes[name][2] = min(votes[name][2], mine)
        best = max(names, key=lambda name: (votes[name][0], votes[name][1]))
        return best, votes[best][2]

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """Language and score of each row of descriptions."""
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1] if self.pairs else np.zeros((len(x), 0))
        names = sorted(set(self.families))
        out = []
        for row in margins:
            margin = dict(zip(self.pairs, row.tolist(), strict=True))
            family, sure = self._vote(names, margin)
            members = [
                lang for lang, of in zip(self.languages, self.families, strict=True) if of == family
            ]
            language, surer = self._vote(members, margin)
            least = min(sure, surer)
            out.append((language, 1.0 if np.isinf(least) else float(1 / (1 + np.exp(-2 * least)))))
        return out


def fit(
    docs: DataFrame, sample: int = SAMPLE, cost: float = COST, epochs: int = EPOCHS, seed: int = SEED
) -> LanguageModel:
    """Learn the languages of documents outside the evaluation fold."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).filter(
        ~held_out(docs["doc_id"])
    )
    counts = usable.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(row["lang"] for row in counts)
    families = [family_of(lang) for lang in languages]
    pairs = list(combinations(sorted(set(families)), 2))
    for family in sorted(set(families)):
        members = [lang for lang, of in zip(languages, families, strict=True) if of == family]
        pairs += list(combinations(members, 2))
    if not pairs:
        return LanguageModel(languages, families, [], np.zeros((0, SIZE + 1)))

    # Ids alone are ranked, and of a large language only those whose hash comes early.
    totals = docs.sparkSession.createDataFrame(
        [(row["lang"], row["count"]) for row in counts], "of_lang string, total bigint"
    )
    by_hash = F.xxhash64("doc_id", F.lit(seed))
    first = Window.partitionBy("lang").orderBy(by_hash, "doc_id")
    ids = (
        usable.select("doc_id", "lang")
        .join(F.broadcast(totals), F.col("lang") == F.col("of_lang"))
        .filter(early(by_hash, sample, F.col("total")))
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= sample)
        .select(F.col("doc_id").alias("chosen_id"), F.col("lang").alias("chosen_lang"))
    )
    chosen = docs.select("doc_id", "text", "lang").join(
        F.broadcast(ids),  # at most sample * MAX_LANGUAGES rows
        (F.col("doc_id") == F.col("chosen_id")) & (F.col("lang") == F.col("chosen_lang")),
    )
    numbers = {pair: i for i, pair in enumerate(pairs)}
    roles: dict[str, list[tuple[int, float]]] = {}
    for lang, family in zip(languages, families, strict=True):
        roles[lang] = [
            (number, 1.0 if name == pair[0] else -1.0)
            for pair, number in numbers.items()
            for name in (lang, family)
            if name in pair
        ]

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"machine": [], "sign": [], "doc_id": [], "x": []}
            for name, lang, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "lang", "text")]):
                vector = describe(text or "")
                if vector is not None:
                    for machine, sign in roles[lang]:
                        rows["machine"].append(machine)
                        rows["sign"].append(sign)
                        rows["doc_id"].append(name)
                        rows["x"].append(vector.tobytes())
            yield pa.RecordBatch.from_pydict(rows, schema=_EXAMPLES)

    def trained(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "x"])
        x = np.frombuffer(b"".join(rows["x"]), dtype=np.float32).reshape(len(rows), SIZE)
        weights = train_machine(x, rows["sign"].to_numpy(), cost, epochs, seed)
        return pd.DataFrame({"machine": [key[0]], "weights": [weights.tobytes()]})

    examples = chosen.select("doc_id", "lang", "text").mapInArrow(
        described, "machine int, sign double, doc_id bigint, x binary"
    )
    machines = examples.groupBy("machine").applyInPandas(trained, "machine int, weights binary").collect()
    weights = np.zeros((len(pairs), SIZE + 1))
    for row in machines:
        weights[row["machine"]] = np.frombuffer(row["weights"])
    return LanguageModel(languages, families, pairs, weights)


_EXAMPLES = pa.schema(
    [("machine", pa.int32()), ("sign", pa.float64()), ("doc_id", pa.int64()), ("x", pa.binary())]
)
#: Documents described at a time when predicting.
_ROWS = 256


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                part = batch.slice(first, _ROWS)
                vectors = [describe(text or "") for text in part.column("text").to_pylist()]
                known = [i for i, vector in enumerate(vectors) if vector is not None]
                found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(vectors)
                if known and model.languages:
                    predicted = model.predict(np.array([vectors[i] for i in known]))
                    for i, said in zip(known, predicted, strict=True):
                        found[i] = said
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([lang for lang, _ in found], pa.string()),
                        pa.array([score for _, score in found], pa.float64()),
                    ],
                    ["doc_id", "lang_pred", "score"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        read, "doc_id bigint, lang_pred string, score double"
    )
