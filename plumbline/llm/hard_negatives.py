"""Hard negatives: for anchor vectors, rows of other labels that score just below their positives.

A component x counts as floor(256 * x), x as double, and a score is the integer inner product of two
vectors. The positives of an anchor are the best `positives` other rows of its label; the negatives of
an anchor and a positive are the best `negatives` rows of other labels whose score is between `low` and
`high` percent of the positive's. Better is the higher score, then the smaller vec_id.

The anchors are a stated query set and meet all rows in blocks: a bounded block of anchors is broadcast
and every task scores its rows against it. What a task keeps for an anchor is what can still be wanted of
its own rows, the best few of the label and the best few of each window, so nothing is lost by it. Keys
of anchor, descending score, kind and id, packed into bytes, are dealt by anchor and sorted within
partitions (the secondary sort); an iterator over the sorted keys opens a window when a positive
passes and hands negatives to the windows that are open and not full. It holds those windows alone, never
the rows of an anchor, so it doesn't matter how many rows that are, or how many are equal.

Defined results:
* Rows with a null label, a null vector, or a null or non-finite component take no part.
* A null vec_id is no anchor unless the condition says so, and comes after all others in a tie.
* Rows that repeat an id are rows of their own; an anchor leaves out one row: itself. An anchor that
  repeats is answered as often.
* Vectors of different lengths are multiplied as far as both go; an empty vector scores 0.
* A product beyond the range of a long is the nearest long, 256 * x beyond that of a double the
  nearest double.
* Of a negative positive score there are no negatives, as the upper bound is below the lower one.
* Empty tables, anchors without positives and positives without negatives give no rows. Other columns are
  ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import numbered, saved
from plumbline.plans.storage import scratch_path

POSITIVES = 5
NEGATIVES = 10
#: Percent of the positive's score between which negatives lie, both included.
LOW, HIGH = 30, 90
SCALE = 256

#: Components of the anchors that are broadcast at a time, 16 MB.
BLOCK_VALUES = 1 << 21
#: A task scores at least so many rows, if there are, so that what tasks keep stays few beside the rows.
TASK_ROWS = 8192
#: Rows and anchors of one matrix of scores.
_ROWS, _ANCHORS = 4096, 1024
_ROW_BITS = 12
#: Integers of doubles are exact below; half of it leaves room for the place beside the score.
_EXACT = 2.0**50
_LONG = np.iinfo(np.int64)

#: The key as bytes sorts by anchor, falling score, positives first, rising id, null ids last.
_KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("null", "u1"), ("id", ">u8")])
_SIGN = np.uint64(1 << 63)
#: Kinds of keys; at equal scores the smaller one comes first.
OWN, POSITIVE, NEGATIVE = 0, 1, 2
KEYS = "anchor bigint, key binary"
MINED = (
    "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
    "positive_score bigint, negative_score bigint"
)
_MINED = pa.schema(
    [("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()),
     ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())]
)


def _flipped(x: np.ndarray) -> np.ndarray:
    """Longs as unsigned ones in the same order, and back."""
    return x.astype(np.int64).view(np.uint64) ^ _SIGN


def pack_keys(
    anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray, null: np.ndarray
) -> pa.Array:
    keys = np.zeros(len(anchor), dtype=_KEY)
    keys["anchor"], keys["score"], keys["kind"] = anchor, ~_flipped(score), kind
    keys["null"], keys["id"] = null, _flipped(ids)
    raw = pa.py_buffer(keys.tobytes())
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_KEY.itemsize), len(keys), [None, raw])
    return fixed.cast(pa.binary())


def unpack_keys(keys: pa.Array) -> Iterator[tuple[int, int, int, int | None]]:
    """anchor, score, kind and id of each key."""
    found = np.frombuffer(b"".join(keys.to_pylist()), dtype=_KEY)
    score = (~found["score"].astype(np.uint64) ^ _SIGN).view(np.int64)
    ids = (found["id"].astype(np.uint64) ^ _SIGN).view(np.int64)
    for anchor, s, kind, null, i in zip(
        found["anchor"].tolist(), score.tolist(), found["kind"].tolist(), found["null"].tolist(), ids.tolist()
    ):
        yield anchor, s, kind, None if null else i


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows that take part."""
    values = vectors["embedding"].cast("array<double>")
    fine = F.forall(values, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return vectors.filter(vectors["label"].isNotNull() & values.isNotNull() & fine).select(
        vectors["vec_id"].cast("long").alias("vec_id"),
        vectors["label"].cast("long").alias("label"),
        values.alias("embedding"),
    )


def _matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """A row of whole-numbered doubles for each vector, cut or filled with zeros to `width`."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        values = np.nan_to_num(np.floor(SCALE * values))  # an overflow becomes the largest double
    lengths = np.diff(lists.offsets.to_numpy())
    own = int(lengths.max(initial=0))
    width = own if width is None else width
    if len(lengths) and (lengths == own).all():
        full = values.reshape(len(lengths), own)
    else:
        full = np.zeros((len(lengths), own))
        full[np.arange(own) < lengths[:, None]] = values
    if own < width:
        full = np.hstack([full, np.zeros((len(full), width - own))])
    return full[:, :width]


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as longs."""
    width = anchors.shape[1]
    if float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * width < _EXACT:
        return (anchors @ rows.T).astype(np.int64)
    left, right = (np.vectorize(int, otypes=[object])(m) for m in (anchors, rows))
    return np.clip(left @ right.T, _LONG.min, _LONG.max).astype(np.int64)


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Line and column of the k highest allowed scores of each line, ties by column."""
    many = allowed.sum(axis=1) > k
    if not many.any():
        return np.nonzero(allowed)
    line, column = np.nonzero(allowed & ~many[:, None])
    which = np.flatnonzero(many)
    if -_EXACT < scores.min() and scores.max() < _EXACT and scores.shape[1] <= 1 << _ROW_BITS:
        places = np.arange(scores.shape[1] - 1, -1, -1)
        keys = np.where(allowed[which], scores[which] << _ROW_BITS | places, _LONG.min)
        chosen = np.argpartition(keys, -k, axis=1)[:, -k:]
    else:
        chosen = np.array(
            [np.lexsort((~scores[i], ~allowed[i]))[:k] for i in which]  # stable, so ties stay by column
        )
    return np.concatenate([line, np.repeat(which, k)]), np.concatenate([column, chosen.ravel()])


@dataclass
class _Kept:
    """The best k rows seen for each slot."""

    k: int
    slots: int

    def __post_init__(self) -> None:
        empty = np.zeros(0, dtype=np.int64)
        self.slot, self.score, self.id, self.null, self.row = empty, empty, empty, empty, empty
        #: A row that scores less is not wanted.
        self.least = np.full(self.slots, _LONG.min)

    def add(self, *columns: np.ndarray) -> None:
        slot, score, ids, null, row = (
            np.concatenate([old, new])
            for old, new in zip((self.slot, self.score, self.id, self.null, self.row), columns)
        )
        order = np.lexsort((ids, null, ~score, slot))
        in_order = slot[order]
        starts = np.flatnonzero(np.r_[True, in_order[1:] != in_order[:-1]]) if len(order) else order
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.slot, self.score, self.id, self.null, self.row = (
            x[order] for x in (slot, score, ids, null, row)
        )
        last = rank == self.k - 1
        self.least[self.slot[last]] = self.score[last]


@dataclass
class Anchors:
    """A block of anchors: their numbers, labels and components; for each, the scores of its positives."""

    number: np.ndarray
    label: np.ndarray
    values: np.ndarray
    positives: list[list[int]]


def _windows(positives: list[list[int]], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score wanted, by anchor and positive; nothing where there is no positive."""
    most = max(map(len, positives), default=0)
    lows = np.full((len(positives), most), _LONG.max)
    highs = np.full((len(positives), most), _LONG.min)
    for i, scores in enumerate(positives):
        for j, score in enumerate(scores):
            lows[i, j], highs[i, j] = window(score, low, high)
    return lows, highs


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The whole scores s with low * score <= 100 * s <= high * score, first and last."""
    first, last = -(-low * score // 100), high * score // 100
    return max(first, _LONG.min), min(last, _LONG.max)


def _scored(batches: Iterator[pa.RecordBatch], anchors: Anchors) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of scores: first anchor, scores, whether labels agree, ids, null ids, row numbers."""
    seen = 0
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            ids = part.column("vec_id")
            null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = ids.fill_null(0).to_numpy()
            order = np.lexsort((ids, null))
            ids, null = ids[order], null[order]
            labels = part.column("label").to_numpy()[order]
            values = _matrix(part.column("embedding"), anchors.values.shape[1])[order]
            rows = seen + np.arange(len(ids))
            seen += len(ids)
            for first in range(0, len(anchors.number), _ANCHORS):
                some = slice(first, first + _ANCHORS)
                yield (
                    first,
                    _scores(anchors.values[some], values),
                    anchors.label[some, None] == labels,
                    ids,
                    null,
                    rows,
                )


def best_of_label(batches: Iterator[pa.RecordBatch], anchors: Anchors, k: int) -> Iterator[pa.RecordBatch]:
    """Packed keys of the best k rows of each anchor's label among a task's rows."""
    kept = _Kept(k, len(anchors.number))
    for first, scores, same, ids, null, rows in _scored(batches, anchors):
        wanted = same & (scores >= kept.least[first : first + len(scores), None])
        line, column = _best(scores, wanted, k)
        kept.add(first + line, scores[line, column], ids[column], null[column], rows[column])
    yield _keyed(anchors.number[kept.slot], kept.score, POSITIVE, kept.id, kept.null)


def best_of_windows(
    batches: Iterator[pa.RecordBatch], anchors: Anchors, k: int, low: int, high: int
) -> Iterator[pa.RecordBatch]:
    """Packed keys of the best k rows of other labels in each window among a task's rows, a row once."""
    lows, highs = _windows(anchors.positives, low, high)
    kept = [_Kept(k, len(anchors.number)) for _ in range(lows.shape[1])]
    for first, scores, same, ids, null, rows in _scored(batches, anchors):
        some = slice(first, first + len(scores))
        other = ~same
        for j, mine in enumerate(kept):
            least = np.maximum(lows[some, j], mine.least[some])[:, None]
            wanted = other & (scores >= least) & (scores <= highs[some, j, None])
            line, column = _best(scores, wanted, k)
            if len(line):
                mine.add(first + line, scores[line, column], ids[column], null[column], rows[column])
    if kept:
        slot, score, ids, null, row = (
            np.concatenate([getattr(x, name) for x in kept]) for name in ("slot", "score", "id", "null", "row")
        )
        _, once = np.unique(np.stack([slot, row]), axis=1, return_index=True)
        yield _keyed(anchors.number[slot[once]], score[once], NEGATIVE, ids[once], null[once])


def _keyed(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray, null: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor, pa.int64()), pack_keys(anchor, score, kind, ids, null)], ["anchor", "key"]
    )


def _blocks(anchors: DataFrame, blocks: int) -> Iterator[Anchors]:
    for block in range(blocks):
        found = anchors.filter(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == block).toArrow()
        if found.num_rows:
            found = found.combine_chunks().to_batches()[0]
            scores = found.column("positives").to_pylist() if "positives" in found.schema.names else []
            yield Anchors(
                found.column("anchor").to_numpy(),
                found.column("label").to_numpy(),
                _matrix(found.column("embedding")),
                [[p["score"] for p in of_one] for of_one in scores],
            )


def _sorted_keys(keys: DataFrame) -> DataFrame:
    """The secondary sort: all keys of an anchor in one partition, in order."""
    return keys.repartition("anchor").sortWithinPartitions("key")


def _swept(
    anchors: DataFrame, rows: DataFrame, blocks: int, name: str, task: Callable[..., Iterator[pa.RecordBatch]]
) -> DataFrame:
    """anchor and key from `task` over all rows, for one broadcast block of anchors after the other."""
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    spark.createDataFrame([], KEYS).write.parquet(f"{path}/block=-1")  # so that there is a table
    for number, block in enumerate(_blocks(anchors, blocks)):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            return task(batches, shared.value)

        rows.mapInArrow(scan, KEYS).write.mode("overwrite").parquet(f"{path}/block={number}")
        shared.unpersist()
    return spark.read.schema(KEYS).parquet(path).select("anchor", "key")


def find_positives(
    anchors: DataFrame, rows: DataFrame, blocks: int = 1, positives: int = POSITIVES
) -> DataFrame:
    """anchor and its positives, best first: array of (id, score).

    `anchors` has the number `anchor`, and vec_id, label and embedding as `rows` has.
    """

    def task(batches: Iterator[pa.RecordBatch], block: Anchors) -> Iterator[pa.RecordBatch]:
        return best_of_label(batches, block, positives + 1)  # an anchor meets itself

    @F.pandas_udf("bigint")
    def norm(vectors: pd.Series) -> pd.Series:
        values = (_matrix(pa.array([v], pa.list_(pa.float64()))) for v in vectors)
        return pd.Series([int(_scores(v, v)[0, 0]) for v in values], dtype="int64")

    @F.pandas_udf("binary")
    def own_key(number: pd.Series, name: pd.Series) -> pd.Series:
        return _key_column(number, np.full(len(number), _LONG.max), OWN, name)

    found = _swept(anchors, rows, blocks, "of_label", task).withColumn("own", F.lit(None).cast("long"))
    own = anchors.select("anchor", own_key("anchor", "vec_id").alias("key"), norm("embedding").alias("own"))

    def first_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, itself, found = None, None, []
        for batch in batches:
            numbers, lists = [], []
            for (number, score, kind, name), own in zip(
                unpack_keys(batch.column("key")), batch.column("own").to_pylist()
            ):
                if kind == OWN:
                    if found:
                        numbers.append(anchor)
                        lists.append(found)
                    anchor, itself, found = number, (name, own), []
                elif (name, score) == itself:
                    itself = None  # once
                elif len(found) < positives:
                    found.append({"id": name, "score": score})
            yield _listed(numbers, lists)
        if found:
            yield _listed([anchor], [found])

    return _sorted_keys(found.unionByName(own)).mapInArrow(
        first_ones, "anchor bigint, positives array<struct<id:bigint,score:bigint>>"
    )


def _key_column(number: pd.Series, score: np.ndarray, kind: int, name: pd.Series) -> pd.Series:
    ids = name.astype("Int64")
    keys = pack_keys(
        number.to_numpy(), score, kind, ids.fillna(0).to_numpy(np.int64), ids.isna().to_numpy()
    )
    return pd.Series(keys.to_pylist(), dtype=object)


def _listed(numbers: list[int], lists: list[list[dict]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [pa.array(numbers, pa.int64()), pa.array(lists, kind)], ["anchor", "positives"]
    )


class OpenWindows:
    """The windows of the anchor whose keys are passing."""

    def __init__(self, negatives: int, low: int, high: int) -> None:
        self.negatives, self.low, self.high = negatives, low, high
        self.anchor: int | None = None
        self.open: list[list] = []

    def negatives_at(
        self, anchor: int, score: int, kind: int, name: int | None
    ) -> Iterator[tuple[int | None, int, int]]:
        """Takes the next key; yields positive id, positive score and rank for each window it falls in."""
        if anchor != self.anchor:
            self.anchor, self.open = anchor, []
        if kind == POSITIVE:
            self.open.append([name, score, *window(score, self.low, self.high), 0])
            return
        full = False
        for one in self.open:
            positive, positive_score, first, last, taken = one
            if first <= score <= last:
                one[4] = taken + 1
                full |= taken + 1 == self.negatives
                yield positive, positive_score, taken + 1
        if full:  # a full window closes
            self.open = [one for one in self.open if one[4] < self.negatives]


def mine(
    vectors: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block_values: int = BLOCK_VALUES,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchor` says which rows of `vectors` (vec_id, embedding, label) are anchors. The rows are read twice
    for each block of anchors, so they should come from a table.
    """
    if positives < 1 or negatives < 1 or not 0 <= low <= high <= 100:
        raise ValueError("positives and negatives start at 1, percentages are 0 <= low <= high <= 100")
    spark = vectors.sparkSession
    rows = usable(vectors)
    chosen = F.coalesce(anchor, F.lit(False))
    size = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(chosen).alias("anchors"),
        F.coalesce(F.max(F.when(chosen, F.size("embedding"))), F.lit(0)).alias("width"),
    ).first()
    if not size["anchors"]:
        return spark.createDataFrame([], MINED)
    blocks = -(-size["anchors"] * max(1, size["width"]) // block_values)
    dealt = rows.coalesce(max(1, size["rows"] // task_rows))
    anchors = saved(
        numbered(rows.filter(chosen), "vec_id", "label", "embedding").withColumnRenamed("row", "anchor"),
        "anchors",
    )
    found = saved(find_positives(anchors, dealt, blocks, positives), "positives")
    windows = saved(anchors.join(found, "anchor"), "windows")

    def task(batches: Iterator[pa.RecordBatch], block: Anchors) -> Iterator[pa.RecordBatch]:
        return best_of_windows(batches, block, negatives, low, high)

    @F.pandas_udf("binary")
    def positive_key(number: pd.Series, score: pd.Series, name: pd.Series) -> pd.Series:
        return _key_column(number, score.to_numpy(), POSITIVE, name)

    opening = windows.select("anchor", "vec_id", F.explode("positives").alias("p")).select(
        "anchor",
        positive_key("anchor", F.col("p.score"), F.col("p.id")).alias("key"),
        F.col("vec_id").alias("anchor_id"),
    )
    others = _swept(windows, dealt, blocks, "of_windows", task).withColumn(
        "anchor_id", F.lit(None).cast("long")
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = OpenWindows(negatives, low, high)
        anchor_id = None
        for batch in batches:
            out = []
            for key, opener in zip(unpack_keys(batch.column("key")), batch.column("anchor_id").to_pylist()):
                _, score, kind, name = key
                anchor_id = opener if kind == POSITIVE else anchor_id
                for positive, positive_score, rank in state.negatives_at(*key):
                    out.append((anchor_id, positive, rank, name, positive_score, score))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, field.type) for x, field in zip(zip(*out) if out else [()] * 6, _MINED)],
                schema=_MINED,
            )

    return _sorted_keys(opening.unionByName(others)).mapInArrow(emit, MINED)
