"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton of all items holds every run of words that occurs in one of them. A document's words are
streamed through it; after each word the automaton's state and matched length are the longest run that
ends here and occurs in an item. Where that length reaches `window` words, the last `window` words are a
window of some item; where the run ends in a whole item that is shorter than a window, that item
occurs. Both are hit spans.

Texts are lower-cased in A-Z only, and words are runs of digits, letters a-z and all characters from
U+0080 on. A null or empty text has no words, is never contaminated and is returned as it is; an item
without words occurs nowhere; repeated items each count. Columns other than those named are carried
along. With no items or no documents nothing is hit.

The test set goes to the driver item by item and to the tasks as automata of at most `block_words`
item words (a single longer item has one of its own). Each automaton is a pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import saved

WINDOW = 13
#: A document with hit words is contaminated if they are at least one in so many.
ONE_IN = 20
BLOCK_WORDS = 250_000

#: Bytes of words stay, A-Z become a-z, all others separate words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """All runs of words of some items, and which items have a given window or are short and whole."""

    def __init__(self, items: Iterable[tuple[object, Sequence[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
                 for name, words in items if words]
        for _, ids in items:
            last = 0
            for word in ids:
                last = self._extend(last, word)
        #: Items by the state of a window, and short items by the state of the whole item.
        self.windows: dict[int, set] = {}
        self.short: dict[int, set] = {}
        for name, ids in items:
            state, length = 0, 0
            for word in ids:
                state, length = self.step(state, length, word)
                if length >= window:
                    self.windows.setdefault(self.cut(state), set()).add(name)
            if length < window:
                self.short.setdefault(state, set()).add(name)
        #: The nearest state on the way of suffix links, itself included, that is a whole short item.
        self.nearest = [-1] * len(self.link)
        if self.short:
            for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                self.nearest[state] = state if state in self.short else self.nearest[self.link[state]]

    def _extend(self, last: int, word: int) -> int:
        """The state of the run of `last` and one more word."""
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, word, known)
        new = self._state(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            known = self.next[state][word]
            longest = self.length[known] == self.length[state] + 1
            self.link[new] = known if longest else self._clone(state, word, known)
        return new

    def _clone(self, state: int, word: int, known: int) -> int:
        clone = self._state(self.length[state] + 1, dict(self.next[known]), self.link[known])
        self.link[known] = clone
        while state >= 0 and self.next[state].get(word) == known:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The longest run that ends with this word, as state and number of words."""
        while word not in self.next[state]:
            if state == 0:
                return 0, 0
            state = self.link[state]
            length = self.length[state]
        return self.next[state][word], length + 1

    def cut(self, state: int) -> int:
        """The state of the last `window` words of a run at least that long."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def spans(self, words: Sequence[bytes]) -> tuple[list[list[int]], set]:
        """Hit spans of a document, joined where they touch, as [first, end); items that occur."""
        found: list[list[int]] = []
        names: set = set()
        following, link, lengths, window = self.next, self.link, self.length, self.window
        short = bool(self.short)
        state = length = 0
        seen: set[int] = set()
        for at, word in enumerate(map(self.vocabulary.get, words)):
            if word is None:
                state = length = 0
                continue
            while word not in following[state]:
                if state == 0:
                    length = -1
                    break
                state = link[state]
                length = lengths[state]
            length += 1
            if length:
                state = following[state][word]
            first = at + 1
            if length >= window:
                first = at + 1 - window
                seen.add(state)
            if short and length:
                first = self._short_ends(state, length, at + 1, first, names)
            if first <= at:
                while found and found[-1][0] >= first:
                    found.pop()
                if found and found[-1][1] >= first:
                    found[-1][1] = at + 1
                else:
                    found.append([first, at + 1])
        for state in seen:
            names |= self.windows[self.cut(state)]
        return found, names

    def _short_ends(self, state: int, length: int, end: int, first: int, names: set) -> int:
        """Short items that end here: their names are added, the earliest start is returned."""
        if self.length[state] > length:
            state = self.link[state]  # the run is shorter than what its state stands for
        state = self.nearest[state]
        while state > 0:
            names |= self.short[state]
            first = min(first, end - self.length[state])
            state = self.nearest[self.link[state]]
        return first


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    chosen = items.select(F.col("item_id").cast("string"), "text")
    for name, text in chosen.toLocalIterator():
        words = words_of(text)
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((name, words))
        size += len(words)
    yield block


def _joined(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def find_hits(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """doc (all columns of a document), n_words, hit_spans (in words, joined, end exclusive), hit_items.

    hit_items are the ids as text, sorted by code point. A null item id counts as the text `null`.
    """
    spark = docs.sparkSession
    found = docs.select(F.struct(*docs.columns).alias("doc"))
    columns = "n_words bigint, hit_spans array<array<bigint>>, hit_items array<string>"
    schema = T.StructType([*found.schema.fields, *T.StructType.fromDDL(columns).fields])
    for number, block in enumerate(_blocks(items, block_words)):
        if number:
            found = saved(found, "hits")  # one automaton at a time in a task's memory
        shared = spark.sparkContext.broadcast(
            SuffixAutomaton([("null" if n is None else n, w) for n, w in block], window)
        )

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                docs_here = batch.column("doc")
                earlier = (
                    zip(batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist())
                    if "hit_spans" in batch.schema.names
                    else repeat(([], []))
                )
                counts, spans, names = [], [], []
                for text, (old_spans, old_items) in zip(docs_here.field("text").to_pylist(), earlier):
                    words = words_of(text)
                    hits, items_here = shared.value.spans(words)
                    counts.append(len(words))
                    spans.append(_joined(old_spans + hits) if old_spans else hits)
                    names.append(sorted(items_here.union(old_items)))
                yield pa.RecordBatch.from_arrays(
                    [
                        docs_here,
                        pa.array(counts, pa.int64()),
                        pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                        pa.array(names, pa.list_(pa.string())),
                    ],
                    ["doc", "n_words", "hit_spans", "hit_items"],
                )

        found = found.mapInArrow(scan, schema)
    return found


def judged(hits: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """Adds n_hit, and contaminated: some words are hit, and at least one in `one_in`."""
    n_hit = F.aggregate(
        "hit_spans", F.lit(0).cast("long"), lambda sum_, span: sum_ + span[1] - span[0]
    )
    return hits.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))
    )


def without_spans(hits: DataFrame) -> DataFrame:
    """Adds cleaned: the text without the hit words; what separates the others stays."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    return hits.withColumn("cleaned", cleaned("doc.text", "hit_spans"))


def cut_words(text: str | None, spans: Sequence[Sequence[int]]) -> str | None:
    if text is None or not len(spans):
        return text
    raw = text.encode()
    folded = raw.translate(_FOLD)
    ends, at = [], 0
    for word in folded.split():
        first = folded.index(word, at)
        at = first + len(word)
        ends.append((first, at))
    out, at = [], 0
    for first, end in spans:
        out.append(raw[at : ends[int(first)][0]])
        at = ends[int(end) - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def drop_contaminated(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, one_in: int = ONE_IN
) -> DataFrame:
    """The documents that are not contaminated, unchanged, with the columns they came with."""
    clean = judged(find_hits(docs, items, window), one_in).filter(~F.col("contaminated"))
    return clean.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
