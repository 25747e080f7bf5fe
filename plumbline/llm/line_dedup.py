"""Line deduplication by probing minimal perfect hash tables.

A line's key is the line without white space at its ends (space, tab to carriage return) and with A-Z
lower-cased. Keys of at least MIN_CHARS code points that occur in two documents or more lose all their
lines except in the smallest doc_id that has them; there, all of them stay.

Keys are 128-bit hashes. All distinct keys are dealt to shards, and each shard becomes one row: a
minimal perfect hash (levels of bit sets; a key is at the first level where its bit is its own) that maps
the shard's n keys to 0 .. n-1, and arrays in that order: a 32-bit fingerprint, the number of documents
and the smallest doc_id. Documents send their keys, not their lines, to the shards; a task reads one
shard's arrays and streams the keys past them. A key in more than a thousandth of all places (there are
at most a thousand such) is not sent but looked up where it is.

A null or empty text is one empty line; short keys stay always. Null ids count as one document, the
largest. Rows that repeat an id count as documents for the number but lose no line to each other. Texts
of any length are read whole. Other columns are ignored by `repeated_lines` and `without_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import HOT_SHARE, mixed, saved, shuffle_partitions

MIN_CHARS = 10
#: Bits of a level for each key that reaches it.
GAMMA = 2
MOST_LEVELS = 64

_ENDS = b" \t\n\x0b\x0c\r"
#: Stands for a null id.
_LAST = (1 << 63) - 1
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ONES = np.array([bin(byte).count("1") for byte in range(256)], dtype=np.int64)


def key_of(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The line's key in UTF-8; None if it is too short to be compared."""
    key = line.strip(_ENDS)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return key.lower()


def hash_of(key: bytes) -> tuple[int, int]:
    """128 bits of a key as two signed integers."""
    digest = xxhash.xxh3_128_digest(key)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


class PerfectHash:
    """A minimal perfect hash of 128-bit keys, given as two arrays of 64 bits."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        ones = _ONES[bits]
        self.before = np.cumsum(ones) - ones

    @staticmethod
    def _place(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level + 1) * int(_STEP) & (1 << 64) - 1)
        return (mixed(mixed(high ^ seed) + low) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        sizes: list[int] = []
        parts: list[np.ndarray] = []
        while len(high):
            if len(sizes) == MOST_LEVELS:
                raise ValueError("the keys are not distinct")
            size = 8 * -(-GAMMA * len(high) // 8)
            place = cls._place(high, low, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            left = ~alone[place]
            high, low = high[left], low[left]
        bits = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint8)
        return cls(np.array(sizes, dtype=np.int64), bits)

    def index(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """A place below the number of keys for each key of the set; -1 or any place for others."""
        out = np.full(len(high), -1, dtype=np.int64)
        open_ = np.arange(len(high))
        start = 0
        for level, size in enumerate(self.sizes.tolist()):
            at = start + self._place(high[open_], low[open_], level, size)
            byte, bit = self.bits[at >> 3], at & 7
            hit = (byte >> bit.astype(np.uint8)) & 1 == 1
            below = byte[hit] & ((1 << bit[hit]) - 1).astype(np.uint8)
            out[open_[hit]] = self.before[at[hit] >> 3] + _ONES[below]
            open_ = open_[~hit]
            start += size
            if not len(open_):
                break
        return out


def keys_of_documents(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """at (doc_id, the largest number for null), and the document's distinct keys as two arrays."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            highs, lows = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                keys = {key_of(line, min_chars) for line in (text or b"").split(b"\n")}
                hashes = [hash_of(key) for key in keys if key is not None]
                highs.append([high for high, _ in hashes])
                lows.append([low for _, low in hashes])
            yield pa.RecordBatch.from_arrays(
                [batch.column("at"), pa.array(highs, pa.list_(pa.int64())), pa.array(lows, pa.list_(pa.int64()))],
                ["at", "high", "low"],
            )

    return docs.select(_at(), "text").mapInArrow(read, "at bigint, high array<bigint>, low array<bigint>")


def _at():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("at")


_TABLE = "shard int, sizes binary, bits binary, prints binary, counts binary, firsts binary"


def build_tables(lines: DataFrame, shards: int) -> DataFrame:
    """One row per shard from distinct lines (high, low, n, first): the perfect hash and the arrays."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            for number in np.unique(shard).tolist():
                held.setdefault(number, []).append(batch.filter(pa.array(shard == number)))
        for number, parts in held.items():
            table = pa.Table.from_batches(parts)
            column = {c: table.column(c).to_numpy() for c in ("high", "low", "n", "first")}
            high, low = column["high"].view(np.uint64), column["low"].view(np.uint64)
            found = PerfectHash.build(high, low)
            order = np.argsort(found.index(high, low))
            row = {
                "shard": number,
                "sizes": found.sizes.tobytes(),
                "bits": found.bits.tobytes(),
                "prints": low[order].astype(np.uint32).tobytes(),
                "counts": np.minimum(column["n"][order], 0xFFFFFFFF).astype(np.uint32).tobytes(),
                "firsts": column["first"][order].tobytes(),
            }
            yield pa.RecordBatch.from_pylist([row], schema=_ARROW_TABLE)

    dealt = lines.withColumn("shard", _shard(shards)).repartition(shards, "shard")
    return dealt.mapInArrow(build, _TABLE)


_ARROW_TABLE = pa.schema(
    [("shard", pa.int32())] + [(c, pa.binary()) for c in ("sizes", "bits", "prints", "counts", "firsts")]
)


def _shard(shards: int):
    return F.pmod(F.col("high"), F.lit(shards)).cast("int")


def probe(keys: DataFrame, tables: DataFrame, shards: int) -> DataFrame:
    """(at, high, low) of the keys that repeat and are first in another document.

    keys: at, high, low, in any number for a shard; they stream past the arrays of their shard.
    """
    empty = [F.lit(None).cast("binary").alias(c) for c in ("sizes", "bits", "prints", "counts", "firsts")]
    none = [F.lit(None).cast("long").alias(c) for c in ("at", "high", "low")]
    both = tables.select("shard", *none, "sizes", "bits", "prints", "counts", "firsts").unionByName(
        keys.select(_shard(shards).alias("shard"), "at", "high", "low", *empty)
    )
    dealt = both.repartition(shards, "shard").sortWithinPartitions("shard", F.col("at").isNotNull())

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, table, arrays = None, None, ()
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = np.flatnonzero(np.diff(shard)) + 1
            for part in (
                batch.slice(a, b - a)
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(shard)])
            ):
                if not part.num_rows:
                    continue
                if part.column("sizes")[0].is_valid:
                    row = part.slice(0, 1).to_pylist()[0]
                    number = row["shard"]
                    table = PerfectHash(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["bits"], np.uint8))
                    arrays = (np.frombuffer(row["prints"], np.uint32), np.frombuffer(row["counts"], np.uint32),
                              np.frombuffer(row["firsts"], np.int64))
                    part = part.slice(1)
                if not part.num_rows or part.column("shard")[0].as_py() != number:
                    continue
                at, high, low = (part.column(c).to_numpy() for c in ("at", "high", "low"))
                place = table.index(high.view(np.uint64), low.view(np.uint64))
                prints, counts, firsts = arrays
                known = (place >= 0) & (prints[place] == low.view(np.uint64).astype(np.uint32))
                lost = known & (counts[place] > 1) & (firsts[place] != at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[lost]), pa.array(high[lost]), pa.array(low[lost])], ["at", "high", "low"]
                )

    return dealt.mapInArrow(look, "at bigint, high bigint, low bigint")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, shards: int | None = None) -> DataFrame:
    """at and lost: the keys (high, low) whose lines a document loses; only documents that lose some."""
    shards = shards or shuffle_partitions(docs.sparkSession)
    documents = saved(keys_of_documents(docs, min_chars), "line-keys")
    pair = F.explode(F.arrays_zip("high", "low")).alias("key")
    keys = documents.select("at", pair).select("at", "key.high", "key.low")
    lines = keys.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    tables = saved(build_tables(lines, shards), "line-tables")

    total = documents.agg(F.sum(F.size("high"))).first()[0] or 0
    common = lines.filter(F.col("n") > F.lit(max(1.0, HOT_SHARE * total))).select("high", "low", "first")
    common = F.broadcast(saved(common, "common-lines"))
    apart = keys.join(common.select("high", "low"), ["high", "low"], "left_anti")
    here = keys.join(common, ["high", "low"]).filter("at != first").select("at", "high", "low")
    lost = probe(apart, tables, shards).unionByName(here)
    return lost.groupBy("at").agg(F.collect_list(F.struct("high", "low")).alias("lost"))


def without_repeats(docs: DataFrame, min_chars: int = MIN_CHARS, shards: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the text that is left) of every document."""
    lost = repeated_lines(docs, min_chars, shards).withColumnRenamed("at", "lost_at")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = chosen.join(lost, _at() == F.col("lost_at"), "left").select("doc_id", "text", "lost")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, dropped, kept = [], [], []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, lost in zip(texts, batch.column("lost").to_pylist()):
                lines = (text or b"").split(b"\n")
                counts.append(len(lines))
                if lost:
                    gone = {(x["high"], x["low"]) for x in lost}
                    keys = [key_of(line, min_chars) for line in lines]
                    lines = [
                        line
                        for line, key in zip(lines, keys, strict=True)
                        if key is None or hash_of(key) not in gone
                    ]
                dropped.append(counts[-1] - len(lines))
                kept.append(b"\n".join(lines))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(dropped, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_lines", "n_dropped", "kept"],
            )

    return joined.mapInArrow(read, "doc_id bigint, n_lines bigint, n_dropped bigint, kept string")
