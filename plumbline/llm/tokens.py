"""Token ids of all documents in word-aligned binary files.

Ids are packed into 64-bit words (Simple-8b): the low four bits of a word are a selector that says how
many fields the other 60 bits have and how wide they are; the packing is greedy, as many ids as fit.
Selector 15 is the escape: the next word is one id as it is, for ids of more than 60 bits.

The files are Parquet, so that any store Spark can write to holds them and a lost executor's
part is written again by another. A row is a segment: whole documents in ascending doc_id order,
with at least `segment_ids` ids but for the last of a part. Its columns:

    part, segment   place in the corpus: parts follow each other by doc_id, segments within a part
    doc_ids         ids of the segment's documents
    doc_lengths     number of token ids of each document, end id included
    n_ids           number of token ids of the segment
    words           little-endian 64-bit words, back to back
    block_starts    for each block of BLOCK words, the number of ids before it in the segment

A reader finds any id through block_starts and decodes a block, or all blocks at once, selector by
selector with array operations. No block starts with the raw word of an escape.

A null text counts as empty; a document without tokens has its end id alone. Null ids come first.
Documents that repeat an id follow each other by hash of their texts. Empty input gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import shuffle_partitions, text_of
from plumbline.plans.storage import scratch_path

END_ID = 1
SEGMENT_IDS = 1 << 18
#: Words of 64 bits in a block.
BLOCK = 1024

#: Fixed values of the format: number of fields and their bits, by selector; 14 is not used.
FIELDS = (
    (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7),
    (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
ESCAPE = 15
SCHEMA = (
    "part int, segment int, doc_ids array<bigint>, doc_lengths array<bigint>, n_ids bigint, "
    "words binary, block_starts binary"
)
_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("segment", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_lengths", pa.list_(pa.int64())),
        ("n_ids", pa.int64()),
        ("words", pa.binary()),
        ("block_starts", pa.binary()),
    ]
)


_COUNTS = np.array([*[count for count, _ in FIELDS], 0, 1], dtype=np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit words, and the number of ids before each block of BLOCK words."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # The bits that an id takes; one too many near powers beyond 2 ** 53, which is harmless.
    bits = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    # The widest of the next 1, 2, 4, ... ids, from which any run's widest is the larger of two.
    spans = [bits]
    while 2 << (len(spans) - 1) <= min(n, FIELDS[0][0]):
        step, last = 1 << (len(spans) - 1), spans[-1]
        spans.append(np.maximum(last[: len(last) - step], last[step:]))
    selector = np.full(n, ESCAPE, dtype=np.uint8)
    for number in range(len(FIELDS) - 1, -1, -1):  # a denser selector overrules
        count, width = FIELDS[number]
        if count > n:
            break
        level = count.bit_length() - 1
        span, offset = spans[level], count - (1 << level)
        widest = np.maximum(span[: n - count + 1], span[offset : offset + n - count + 1])
        np.copyto(selector[: n - count + 1], number, where=widest <= width)
    taken = _COUNTS[selector].tobytes()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += taken[at]
    start = np.array(starts, dtype=np.int64)
    chosen = selector[start]
    # An escape takes two words and may not be cut by the end of a block.
    place = _places(chosen == ESCAPE)
    size = int(place[-1]) + (2 if chosen[-1] == ESCAPE else 1)
    words = np.full(size, len(FIELDS), dtype=np.uint64)  # selector 14: no ids
    for number in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == number)
        if number == ESCAPE:
            words[place[mine]] = ESCAPE
            words[place[mine] + 1] = ids[start[mine]]
            continue
        count, width = FIELDS[number]
        packed = np.full(len(mine), number, dtype=np.uint64)
        for field in range(count):
            packed |= ids[start[mine] + field] << np.uint64(4 + field * width)
        words[place[mine]] = packed
    first = np.searchsorted(place, np.arange(0, size, BLOCK))
    return words, start[np.minimum(first, len(start) - 1)]


def _places(escaped: np.ndarray) -> np.ndarray:
    """The word in which each code stands; a code of two words at a block's end moves on."""
    if not escaped.any():
        return np.arange(len(escaped))
    out, at = np.zeros(len(escaped), dtype=np.int64), 0
    for i, two in enumerate(escaped.tolist()):
        if two and at % BLOCK == BLOCK - 1:
            at += 1
        out[i] = at
        at += 2 if two else 1
    return out


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of whole blocks, from their first word on."""
    words = np.ascontiguousarray(words, dtype=np.uint64)
    kind = (words & np.uint64(15)).astype(np.uint8)
    raw = np.zeros(len(words), dtype=bool)
    # A raw word follows an escape; what looks like an escape within a raw word is none.
    for at in np.flatnonzero(kind == ESCAPE).tolist():
        if not raw[at]:
            raw[at + 1] = True
    counts = _COUNTS[kind].astype(np.int64)
    counts[raw] = 0
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    for number in np.unique(kind[~raw]):
        mine = np.flatnonzero((kind == number) & ~raw)
        if number == ESCAPE:
            out[starts[mine]] = words[mine + 1]
        elif number < len(FIELDS):
            count, bits = FIELDS[number]
            mask = np.uint64((1 << bits) - 1)
            for field in range(count):
                out[starts[mine] + field] = (words[mine] >> np.uint64(4 + field * bits)) & mask
    return out


def read_ids(words: bytes, block_starts: bytes, first: int, end: int) -> np.ndarray:
    """Ids [first, end) of a segment; only the blocks that hold them are decoded."""
    starts = np.frombuffer(block_starts, dtype="<i8")
    low = int(np.searchsorted(starts, first, side="right")) - 1
    high = int(np.searchsorted(starts, end, side="left"))
    held = np.frombuffer(words, dtype="<u8")[low * BLOCK : high * BLOCK]
    return decode(held)[first - int(starts[low]) : end - int(starts[low])]


#: By vocabulary file, for all tasks of a Python worker.
_KNOWN: dict[str, dict[bytes, bytes]] = {}
_TOKENIZERS: dict[str, object] = {}
#: Words that a Python worker remembers (some 200 bytes each); then it starts over.
REMEMBERED = 1_000_000
#: Texts tokenized at a time.
TEXTS = 256

#: A lower-cased letter may join what follows in a composed character that its capital doesn't have;
#: such texts, and those with special tokens, aren't lower-cased beforehand.
_DELICATE = re.compile(rb"[A-Z][\x80-\xff]|<\|")
_STOPS = (b".", b",")


class WordTokenizer:
    """Tokenizes texts word by word for a lower-case vocabulary that drops white space.

    Words repeat, and a word's ids don't depend on its neighbours: the normalizer and the splitter of
    such a vocabulary see no further than the white space. Each distinct word is encoded by the
    library when it first comes, and remembered.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = Tokenizer.from_file(path)
        self.tokenizer = _TOKENIZERS[path]
        self.known = _KNOWN.setdefault(path, {})
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[number for name, number in names.items() if name.endswith("</w>")]] = True

    def encode_batch(self, texts: Iterable[bytes]) -> list[bytes]:
        """The ids of each text in UTF-8 as little-endian 32-bit integers."""
        split = [self._words(text) for text in texts]
        found = [list(map(self.known.get, words)) for words in split]
        self._learn({w for words, ids in zip(split, found) if None in ids
                     for w, i in zip(words, ids) if i is None})
        known = self.known
        out = [
            b"".join([known[w] if i is None else i for w, i in zip(words, ids)] if None in ids else ids)
            for words, ids in zip(split, found)
        ]
        if len(known) > REMEMBERED:
            known.clear()
        return out

    @staticmethod
    def _words(text: bytes) -> list[bytes]:
        if (not text.isascii() or b"<|" in text) and _DELICATE.search(text):
            return text.split()
        return text.lower().split()

    def _encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _learn(self, words: set[bytes]) -> None:
        ended = [w for w in words if w[-1:] in _STOPS and w[-2:-1].isalpha()]
        # After a letter a comma or full stop, alone, is a token run of its own.
        stems = words.difference(ended).union(w[:-1] for w in ended).union(_STOPS)
        new = [w for w in stems if w not in self.known]
        texts = b"\n".join(new).decode().split("\n") if new else []  # words have no white space
        alphabetic = [text.isalpha() for text in texts]
        plain = list(compress(zip(new, texts), alphabetic))
        other = [both for both, is_plain in zip(zip(new, texts), alphabetic) if not is_plain]
        # A word of letters is one piece, whose last id ends a word: many words take one call.
        if plain:
            line = " ".join(text for _, text in plain)
            ids = np.array(self._encode([line])[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(plain):
                raw, first = ids.tobytes(), 0
                for (word, _), end in zip(plain, (4 * ends).tolist()):
                    self.known[word] = raw[first:end]
                    first = end
            else:  # another kind of vocabulary
                other += plain
        for (word, _), code in zip(other, self._encode([text for _, text in other])):
            self.known[word] = np.array(code.ids, dtype="<u4").tobytes()
        for word in ended:
            self.known[word] = self.known[word[:-1]] + self.known[word[-1:]]


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    path: str,
    end_id: int = END_ID,
    segment_ids: int = SEGMENT_IDS,
    parts: int | None = None,
) -> None:
    """Encode every text, append `end_id`, and write the files in ascending doc_id order.

    `tokenizer_path` names a file of a vocabulary that drops white space, present on every executor.
    """
    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    ordered = chosen.withColumn("tie", F.xxhash64("text")).repartitionByRange(
        parts or shuffle_partitions(docs.sparkSession), "doc_id", "tie"
    )

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)
        part, segment = TaskContext.get().partitionId(), 0
        ending = np.array([end_id], dtype="<u4").tobytes()
        names: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            words, starts = encode(ids)
            row = {
                "part": part,
                "segment": segment,
                "doc_ids": names,
                "doc_lengths": [len(x) // 4 for x in held],
                "n_ids": len(ids),
                "words": words.astype("<u8").tobytes(),
                "block_starts": starts.astype("<i8").tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            for some in (batch.slice(i, TEXTS) for i in range(0, batch.num_rows, TEXTS)):
                texts = some.column("text").cast(pa.binary()).to_pylist()
                for name, ids in zip(some.column("doc_id").to_pylist(), tokenizer.encode_batch(texts)):
                    names.append(name)
                    held.append(ids + ending)
                    size += len(ids) // 4 + 1
                    if size >= segment_ids:
                        yield flush()
                        segment, size = segment + 1, 0
                        names, held = [], []
        if held:
            yield flush()

    in_order = ordered.sortWithinPartitions("doc_id", "tie").drop("tie")
    in_order.mapInArrow(segments, SCHEMA).write.parquet(path)


def open_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def documents_of(files: DataFrame, ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32, from the files.

    With `ids`, the decoded ids too.
    """
    # One row per segment, which is all that the running sum sees; a part's segments first.
    sizes = files.groupBy("part", "segment").agg(F.sum("n_ids").alias("n"))
    of_part = sizes.groupBy("part").agg(F.sum("n").alias("part_n"))
    part_start = of_part.select(
        "part",
        (F.sum("part_n").over(Window.orderBy("part")) - F.col("part_n")).alias("part_start"),
    )
    within = Window.partitionBy("part").orderBy("segment")
    starts = sizes.join(part_start, "part").select(
        F.col("part").alias("part_"),
        F.col("segment").alias("segment_"),
        (F.col("part_start") + F.sum("n").over(within) - F.col("n")).alias("segment_start"),
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in batch.to_pylist()):
            decoded = decode(np.frombuffer(row["words"], dtype="<u8")).astype("<u4")
            lengths = np.array(row["doc_lengths"], dtype=np.int64)
            ends = np.cumsum(lengths)
            raw = memoryview(decoded).cast("B")
            crcs = [
                zlib.crc32(raw[4 * first : 4 * end])
                for first, end in zip((ends - lengths).tolist(), ends.tolist())
            ]
            n = len(lengths)
            out = {
                "part": pa.array([row["part"]] * n, pa.int32()),
                "segment": pa.array([row["segment"]] * n, pa.int32()),
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "before": pa.array(ends - lengths),
                "n_tokens": pa.array(lengths),
                "ids_crc32": pa.array(crcs, pa.int64()),
            }
            if ids:
                edges = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                out["ids"] = pa.ListArray.from_arrays(edges, pa.array(decoded.astype(np.int64)))
            yield pa.RecordBatch.from_pydict(out)

    schema = "part int, segment int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"
    decoded = files.select("part", "segment", "doc_ids", "doc_lengths", "words").mapInArrow(
        digests, schema + (", ids array<bigint>" if ids else "")
    )
    joined = decoded.join(
        starts, (F.col("part") == F.col("part_")) & (F.col("segment") == F.col("segment_"))
    )
    return joined.select(
        "doc_id",
        (F.col("segment_start") + F.col("before")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *(["ids"] if ids else []),
    )


def encode_documents(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write the documents' token files (in the shared folder if no path is given), read them back."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, path)
    return documents_of(open_tokens(docs.sparkSession, path))
