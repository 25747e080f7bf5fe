"""Alignment of two tokenizers over the same bytes.

A tokenizes a space and the text by a byte-level vocabulary, B the text by a vocabulary of pieces that puts
the space itself. Both cut the same bytes, so an A token and a B token are linked if their byte ranges
overlap, and where tokens of both end at the same offset the bytes are cut into groups.

All documents of a batch are merged in lockstep: state vectors have, for each document that isn't finished,
its next A token, its next B token and its end; one step links the two tokens of every document at once,
notes a cut where both end, and advances the one that ends first, or both. Finished documents are taken out
of the vectors, so a step costs what is left. There are as many steps as the longest document has links.

How often an id pair is linked is a matter of the whole corpus. Documents are handled in units of bounded
size, within which pairs are counted; counts are added up over all units, and each unit gets those of its own
pairs back. A unit keeps, compressed, which pairs each of its documents links how often, so that texts
are tokenized once. Broadcast are the highest counts of B ids, one row for each id of the vocabulary.

Defined results:
* A text that is null, empty, or whose tokens of A or B don't join to the space and the text (a
  normaliser changed it, or it holds U+2581) has no tokens: zeros, and no groups.
* Special tokens that stand in a text are plain text.
* Each row is a document of its own, whatever its doc_id: null ids and rows that repeat are kept and counted.
* A very long text is a unit of its own and comes whole.
* Ties for the highest count all count as highest. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import saved, text_of

#: Bytes of text merged in lockstep at a time, and bytes of text of a unit.
MERGED_BYTES = 6_000_000
UNIT_BYTES = 12_000_000
#: Texts tokenized in one call.
TEXTS = 128

UNIT = (
    "unit bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
    "n_links array<bigint>, groups_sha256 array<string>, distinct array<bigint>, packed binary, "
    "pairs array<bigint>, counts array<bigint>"
)
_LONGS = pa.list_(pa.int64())
_UNIT = pa.schema(
    [("unit", pa.int64()), ("doc_id", _LONGS), ("n_a", _LONGS), ("n_b", _LONGS), ("n_groups", _LONGS),
     ("n_links", _LONGS), ("groups_sha256", pa.list_(pa.string())), ("distinct", _LONGS), ("packed", pa.binary()),
     ("pairs", _LONGS), ("counts", _LONGS)]
)
_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
     ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("n_best", pa.int64()), ("count_sum", pa.int64())]
)
RESULT = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "n_best bigint, count_sum bigint"
)


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies.

    Bytes that print stand for themselves, the others for the characters from 256 on, in order.
    """
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printing)]
    return {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabularies:
    """Both tokenizers, and the bytes of their tokens by id."""

    _loaded: dict[tuple[str, str], Vocabularies] = {}

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * a.get_vocab_size()
        for name, number in a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[number] = bytes(alphabet[c] for c in name)
        special = {token.content.encode() for token in a.get_added_tokens_decoder().values()}
        ranks = {raw: i for i, raw in enumerate(self.a_bytes) if raw and raw not in special}
        # Merges by rank of the vocabulary's own ids are its merges in order, at a third of the time; a test
        # holds both libraries against each other.
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))
        ]
        self.a_sizes, self.b_sizes = (
            np.array(list(map(len, x)), dtype=np.int64) for x in (self.a_bytes, self.b_bytes)
        )
        # A token's id in decimal with what follows it, within a group and at its end.
        self.a_shown = [f"{i}{c}".encode() for c in ",|" for i in range(len(self.a_bytes))]
        self.b_shown = [f"{i}{c}".encode() for c in ",;" for i in range(len(self.b_bytes))]
        self.shown = self.a_shown + self.b_shown

    @classmethod
    def load(cls, a_path: str, b_path: str) -> Vocabularies:
        """Once in a Python worker."""
        if (a_path, b_path) not in cls._loaded:
            cls._loaded[a_path, b_path] = cls(a_path, b_path)
        return cls._loaded[a_path, b_path]

    def tokens(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B for each text; none where they don't join to the space and the text."""
        none = np.zeros(0, dtype=np.int64)
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            spaced = " " + text
            raw = spaced.encode()
            a = self.a.encode_ordinary(spaced)
            if text and _join(self.b_bytes, b) == raw and _join(self.a_bytes, a) == raw:
                yield np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
            else:
                yield none, none


def _join(table: list[bytes], ids: Iterable[int]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


@dataclass
class Merged:
    """Links and cuts of documents laid end to end."""

    link_a: np.ndarray  # of each link its A token and its B token, by place
    link_b: np.ndarray
    cut_a: np.ndarray  # whether a token ends a group
    cut_b: np.ndarray


def lockstep(
    ends_a: np.ndarray, counts_a: np.ndarray, ends_b: np.ndarray, counts_b: np.ndarray
) -> Merged:
    """Merge all documents at once.

    `ends` are the byte offsets in its document at which each token ends, `counts` the tokens of each
    document; a document has tokens of both or of none, and the last of both end alike.
    """
    last_a, last_b = np.cumsum(counts_a), np.cumsum(counts_b)
    some = counts_a > 0
    at_a, at_b = ((last - counts)[some].astype(np.int32) for last, counts in ((last_a, counts_a), (last_b, counts_b)))
    last = last_a[some].astype(np.int32)
    room = len(ends_a) + len(ends_b)
    links = np.empty((2, room), dtype=np.int32)
    cuts = np.empty(room, dtype=bool)
    done = 0
    while len(at_a):
        here = slice(done, done + len(at_a))
        links[0, here], links[1, here] = at_a, at_b
        end_a, end_b = ends_a.take(at_a), ends_b.take(at_b)
        on_a, on_b = end_a <= end_b, end_b <= end_a
        np.logical_and(on_a, on_b, out=cuts[here])
        at_a += on_a
        at_b += on_b
        done = here.stop
        going = at_a < last
        if not going.all():
            at_a, at_b, last = at_a[going], at_b[going], last[going]
    links, cuts = links[:, :done], cuts[:done]
    cut_a, cut_b = np.zeros(len(ends_a), dtype=bool), np.zeros(len(ends_b), dtype=bool)
    cut_a[links[0, cuts]] = True
    cut_b[links[1, cuts]] = True
    return Merged(links[0], links[1], cut_a, cut_b)


def _within(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Running sums that begin anew with each document."""
    sums = np.cumsum(sizes)
    before = np.concatenate([[0], sums])[np.cumsum(counts) - counts]
    return (sums - np.repeat(before, counts)).astype(np.int32)


def group_digests(
    vocabularies: Vocabularies, a: np.ndarray, b: np.ndarray, counts: tuple[np.ndarray, np.ndarray], merged: Merged
) -> list[str]:
    """The digest of each document's groups written out, and no text where there are none."""
    names_a, names_b = len(vocabularies.a_bytes), len(vocabularies.b_bytes)
    # A group's A tokens come before its B tokens: a token's place is its own among its kind, and
    # those of the other kind in the groups before (or, for B, up to) its own.
    ends_a, ends_b = np.flatnonzero(merged.cut_a) + 1, np.flatnonzero(merged.cut_b) + 1
    group_a = np.cumsum(merged.cut_a) - merged.cut_a
    group_b = np.cumsum(merged.cut_b) - merged.cut_b
    shown = np.zeros(len(a) + len(b), dtype=np.int64)
    starts_b = np.concatenate([[0], ends_b])
    shown[np.arange(len(a)) + starts_b[group_a]] = a + names_a * merged.cut_a
    shown[np.arange(len(b)) + ends_a[group_b]] = 2 * names_a + b + names_b * merged.cut_b
    out, at, table = [], 0, vocabularies.shown.__getitem__
    for n in (counts[0] + counts[1]).tolist():
        text = b"".join(map(table, shown[at : at + n].tolist()))
        out.append(sha256(text[:-1]).hexdigest() if n else "")
        at += n
    return out


@dataclass
class Unit:
    """What documents handled together have added up to so far."""

    vocabularies: Vocabularies
    columns: dict[str, list] = field(default_factory=lambda: {name: [] for name in _UNIT.names[1:8]})
    pairs: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)
    size: int = 0

    def add(self, names: list[int | None], texts: list[str], size: int) -> None:
        """Tokenize and merge some documents."""
        found = [
            both for at in range(0, len(texts), TEXTS) for both in self.vocabularies.tokens(texts[at : at + TEXTS])
        ]
        a, b = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        counts_a, counts_b = (np.array([len(x[i]) for x in found], dtype=np.int64) for i in (0, 1))
        merged = lockstep(
            _within(self.vocabularies.a_sizes[a], counts_a), counts_a,
            _within(self.vocabularies.b_sizes[b], counts_b), counts_b,
        )
        doc_of = np.repeat(np.arange(len(found)), counts_a)
        doc = doc_of[merged.link_a]
        wide = np.int64(len(self.vocabularies.b_bytes))
        space = np.int64(len(self.vocabularies.a_bytes)) * wide
        linked, times = np.unique(
            doc * space + a[merged.link_a] * wide + b[merged.link_b], return_counts=True
        )
        self.pairs.append(linked % space)
        self.times.append(times)
        n_groups = np.bincount(doc_of, weights=merged.cut_a, minlength=len(found)).astype(np.int64)
        for name, values in {
            "doc_id": names,
            "n_a": counts_a.tolist(),
            "n_b": counts_b.tolist(),
            "n_groups": n_groups.tolist(),
            "n_links": np.bincount(doc, minlength=len(found)).tolist(),
            "groups_sha256": group_digests(self.vocabularies, a, b, (counts_a, counts_b), merged),
            "distinct": np.bincount(linked // space, minlength=len(found)).tolist(),
        }.items():
            self.columns[name] += values
        self.size += size

    def row(self, number: int) -> pa.RecordBatch:
        linked, times = np.concatenate(self.pairs), np.concatenate(self.times)
        pairs, which = np.unique(linked, return_inverse=True)
        counts = np.bincount(which, weights=times, minlength=len(pairs)).astype(np.int64)
        # Frequent pairs get small numbers, which take little room.
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        packed = pack(place[which], times, np.array(self.columns["distinct"], dtype=np.int64))
        values = [number, *self.columns.values(), packed, pairs[order], counts[order]]
        return pa.RecordBatch.from_arrays(
            [pa.array([value], kind.type) for value, kind in zip(values, _UNIT)], schema=_UNIT
        )


def pack(places: np.ndarray, times: np.ndarray, lengths: np.ndarray) -> bytes:
    """Which pairs documents link and how often: differences of places, by bytes, compressed."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((places, doc))
    places, times = places[order], times[order]
    steps = np.diff(places, prepend=0)
    first = (np.cumsum(lengths) - lengths)[lengths > 0]
    steps[first] = places[first]
    planes = np.stack([steps, times]).astype("<u4").view(np.uint8).reshape(2, -1, 4)
    return zstandard.ZstdCompressor(level=3).compress(planes.transpose(0, 2, 1).tobytes())


def unpack(packed: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and times, by document."""
    total = int(lengths.sum())
    raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=8 * total or 1)
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(2, 4, total).transpose(0, 2, 1)
    steps, times = np.ascontiguousarray(planes).view("<u4")[..., 0].astype(np.int64)
    return _within(steps, lengths).astype(np.int64), times


def align(
    docs: DataFrame, a_path: str, b_path: str, merged_bytes: int = MERGED_BYTES, unit_bytes: int = UNIT_BYTES
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum of each document.

    The paths name vocabulary files that are present on every executor.
    """

    def to_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = Vocabularies.load(a_path, b_path)
        number = TaskContext.get().partitionId() << 33
        unit = Unit(vocabularies)
        names: list[int | None] = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for name, text in zip(batch.column("doc_id"), batch.column("text")):
                more = len(text.as_buffer())
                if texts and size + more > merged_bytes:
                    unit.add(names, texts, size)
                    names, texts, size = [], [], 0
                    if unit.size + more > unit_bytes:
                        yield unit.row(number)
                        unit, number = Unit(vocabularies), number + 1
                names.append(name.as_py())
                texts.append(text.as_py())
                size += more
        if texts:
            unit.add(names, texts, size)
        if unit.pairs:
            yield unit.row(number)

    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    units = saved(chosen.mapInArrow(to_units, UNIT), "units")
    listed = units.select("unit", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "of")).select(
        "unit", "place", F.col("of.pairs").alias("pair"), F.col("of.counts").alias("n")
    )
    corpus = saved(listed.groupBy("pair").agg(F.sum("n").alias("total")), "pairs")
    second = F.col("pair") % len(Vocabularies.load(a_path, b_path).b_bytes)
    best = corpus.groupBy(second.alias("b")).agg(F.max("total").alias("most"))
    judged = corpus.join(F.broadcast(best), second == best["b"]).select(
        "pair", "total", (F.col("total") == F.col("most")).alias("is_best")
    )
    given_back = listed.join(judged, "pair").select("unit", "place", "total", "is_best")

    def sums(unit: pa.Table, pairs: pa.Table) -> pa.Table:
        row = {name: unit.column(name)[0] for name in unit.column_names}
        lengths = np.array(row["distinct"].as_py(), dtype=np.int64)
        places, times = unpack(row["packed"].as_py(), lengths)
        total = np.zeros(pairs.num_rows, dtype=np.int64)
        is_best = np.zeros(pairs.num_rows, dtype=np.int64)
        at = pairs.column("place").to_numpy()
        total[at] = pairs.column("total").to_numpy()
        is_best[at] = pairs.column("is_best").to_numpy()
        ends = np.concatenate([[0], np.cumsum(lengths)])
        out = [
            np.diff(np.concatenate([[0], np.cumsum(times * values[places])])[ends])
            for values in (is_best, total)
        ]
        names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        return pa.Table.from_arrays([*(row[name].values for name in names), *map(pa.array, out)], schema=_RESULT)

    kept = units.drop("pairs", "counts").withColumnRenamed("unit", "of_unit")
    return kept.groupBy("of_unit").cogroup(given_back.groupBy("unit")).applyInArrow(sums, RESULT)
