"""Removal of repeated passages: a count-min sketch first, exact groups for what it lets through.

Words are what white space separates. A window is WINDOW consecutive words of one document; every word
that is covered by a window whose words also start earlier (smaller doc_id, or earlier in the same
document) goes. Windows are judged on the texts as they come.

First pass. Of each window, the run of ANCHOR words with the least hash is its anchor; equal windows have
equal anchors, and an anchor's places are at least as many as any of its windows'. Anchors are counted in
a count-min sketch of two rows. Tasks send the cells they hit, cut into blocks; blocks are merged by
addition, and the cells that reached two, a bit each, come back to all tasks. The sketch has a fixed
size (two rows of 2 ** SKETCH_BITS bits, 32 MB), whatever the corpus. It never counts too few, so no
repeated window is lost; a fuller sketch only lets more windows through.

Second pass. Of the windows that are estimated repeated, a task sorts those it has at a time: all but
the first of a kind are repeats already. The first of each kind meets those of other tasks, grouped by a
128-bit hash of its words, and all but the least (doc_id, start) go. So a passage in a third of all
documents adds one row for each task's portion.

A null or empty text has no words and keeps the empty text; fewer than WINDOW words never lose any. Null
ids count as the largest. Rows that repeat id and text are one document's: they lose the same words, and
none to each other. Texts are read whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import mixed, run_hashes
from plumbline.llm.sketches import hit_twice, sketch_portions

WINDOW = 20
ANCHOR = 10
SKETCH_BITS = 27
#: Words handled at a time, but for a text that is longer.
WORDS = 1_000_000

_LAST = (1 << 63) - 1
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def _sliding(x: np.ndarray, width: int, smaller: bool) -> np.ndarray:
    """The least or largest of `width` values from each place on."""
    least = np.minimum if smaller else np.maximum
    n, size, run = len(x) - width + 1, 1, x
    if n <= 0:
        return x[:0]
    while 2 * size <= width:
        run = least(run[: len(run) - size], run[size:])
        size *= 2
    return least(run[:n], run[width - size : width - size + n])


class Portion:
    """The words of some documents: their hashes, and what windows they have."""

    def __init__(self, texts: list[bytes], window: int, anchor: int) -> None:
        split = [text.split() for text in texts]
        sizes = np.array([len(words) for words in split], dtype=np.int64)
        self.hashes = np.fromiter(
            (h for words in split for h in map(xxhash.xxh3_64_intdigest, words)), np.uint64, int(sizes.sum())
        )
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        self.begin = np.cumsum(sizes) - sizes
        n = max(0, len(self.hashes) - window + 1)
        self.inside = self.doc[:n] == self.doc[window - 1 :] if n else np.zeros(0, dtype=bool)
        self.runs = run_hashes(self.hashes, anchor)
        #: The anchor of each window.
        self.anchors = _sliding(self.runs, window - anchor + 1, True)

    def anchor_places(self, window: int, anchor: int) -> np.ndarray:
        """Hash of each place that is an anchor of a window."""
        if not len(self.anchors):
            return self.runs[:0]
        wide = window - anchor
        # A place is an anchor if the largest of the minima over it is its own hash.
        minima = np.where(self.inside, self.anchors, np.uint64(0))
        pad = np.zeros(wide, dtype=np.uint64)
        over = _sliding(np.concatenate([pad, minima, pad]), wide + 1, False)
        return self.runs[over == self.runs]


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    at: list[int] = []
    tag: list[int] = []
    held: list[bytes] = []
    size = 0
    for batch in batches:
        columns = [batch.column("at"), batch.column("tag"), batch.column("text").cast(pa.binary())]
        for a, t, text in zip(*[c.to_pylist() for c in columns]):
            at.append(a)
            tag.append(t)
            held.append(text)
            size += len(text) // 6 + 1
            if size >= WORDS:
                yield at, tag, held
                at, tag, held, size = [], [], [], 0
    if held:
        yield at, tag, held


def _rows_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    return docs.select(at.alias("at"), F.xxhash64(text).alias("tag"), text.alias("text"))


def repeats(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, bits: int = SKETCH_BITS
) -> DataFrame:
    """at, tag and starts: where the windows start that also start earlier; documents with some.

    `at` is the doc_id, `tag` a hash of the text. A range of starts is two numbers, first and last.
    """

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, _, texts in _portions(batches):
            yield Portion(texts, window, anchor).anchor_places(window, anchor)

    rows = _rows_of(docs)
    shared = docs.sparkSession.sparkContext.broadcast(sketch_portions(rows, anchors, bits))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, tag, texts in _portions(batches):
            portion = Portion(texts, window, anchor)
            n = len(portion.anchors)
            chosen = np.flatnonzero(portion.inside[:n] & hit_twice(shared.value, portion.anchors))
            if not len(chosen):
                continue
            high = run_hashes(portion.hashes, window)[chosen]
            low = run_hashes(mixed(portion.hashes ^ _OTHER), window)[chosen]
            doc = portion.doc[chosen]
            start = chosen - portion.begin[doc]
            ids, tags = np.array(at, dtype=np.int64), np.array(tag, dtype=np.int64)
            order = np.lexsort((tags[doc], start, ids[doc], low, high))
            high, low, doc, start = high[order], low[order], doc[order], start[order]
            new = np.ones(len(high), dtype=bool)
            new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)[group]
            least = (ids[doc] == ids[doc[first]]) & (start == start[first])
            yield _batch(high[least], low[least], ids[doc[least]], tags[doc[least]], start[least], start[least])
            # What is a repeat already goes out as ranges.
            late = np.flatnonzero(~least)
            late = late[np.lexsort((start[late], doc[late]))]
            doc, start = doc[late], start[late]
            if len(late):
                begin = np.ones(len(late), dtype=bool)
                begin[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
                a = np.flatnonzero(begin)
                b = np.append(a[1:], len(late)) - 1
                yield _batch(None, None, ids[doc[a]], tags[doc[a]], start[a], start[b])

    found = rows.mapInArrow(
        look, "high bigint, low bigint, at bigint, tag bigint, first int, last int"
    )
    # A window's first of each portion; ranks are given as the rows stream by.
    turn = Window.partitionBy("high", "low").orderBy("at", "first")
    apart = F.when(F.col("high").isNull(), F.xxhash64("at", "first")).otherwise(F.col("high"))
    ranked = found.withColumn("known", F.col("high").isNull()).withColumn("high", apart)
    ranked = ranked.withColumn("turn", F.rank().over(turn))
    gone = ranked.filter(F.col("known") | (F.col("turn") > 1))
    return gone.groupBy("at", "tag").agg(F.collect_list(F.struct("first", "last")).alias("starts"))


def _batch(high, low, at, tag, first, last) -> pa.RecordBatch:
    empty = pa.nulls(len(at), pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            empty if high is None else pa.array(high.view(np.int64)),
            empty if low is None else pa.array(low.view(np.int64)),
            pa.array(at),
            pa.array(tag),
            pa.array(first.astype(np.int32)),
            pa.array(last.astype(np.int32)),
        ],
        ["high", "low", "at", "tag", "first", "last"],
    )


def without_repeats(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, bits: int = SKETCH_BITS
) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space)."""
    gone = repeats(docs, window, anchor, bits).select(
        F.col("at").alias("gone_at"), F.col("tag").alias("gone_tag"), "starts"
    )
    rows = _rows_of(docs)
    joined = rows.join(gone, (rows["at"] == F.col("gone_at")) & (rows["tag"] == F.col("gone_tag")), "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            starts = batch.column("starts").to_pylist()
            for text, ranges in zip(batch.column("text").cast(pa.binary()).to_pylist(), starts):
                words = text.split()
                counts.append(len(words))
                if ranges:
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(change, [x["first"] for x in ranges], 1)
                    np.add.at(change, [x["last"] + window for x in ranges], -1)
                    covered = np.cumsum(change)[:-1] > 0
                    words = [words[i] for i in np.flatnonzero(~covered).tolist()]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    doc_id = F.when(F.col("at") != F.lit(_LAST), F.col("at")).alias("doc_id")
    return joined.select(doc_id, "text", "starts").mapInArrow(
        read, "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    )
