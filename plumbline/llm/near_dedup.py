"""Near-duplicate groups: ProbMinHash signatures of shingle sets, banding, verification.

Texts are lower-cased in A-Z and cut into words (digits, letters a-z, all characters from U+0080 on). A
document is the set of its runs of five words. Two documents are linked if these sets have a Jaccard
similarity of at least 0.8. A class is what links connect, and of each class the document with the smallest
id stays.

* Documents with the same words are one node, whatever their number.
* A node's signature has 128 registers. Every run of words emits arrivals of a Poisson process whose
  rate is its weight, each at a random register; a register keeps the run that arrives first, and a run
  stops when its next arrival is later than all registers'. Two signatures agree in a register with the
  probability Jaccard similarity of the weights. Every distinct run weighs 1, however often it occurs, so
  this is the Jaccard similarity of the sets that links are defined by.
* 32 bands of four registers make buckets. At a similarity of 0.8 the chance that two nodes share no
  bucket is below 1e-7.
* In the first round every node is compared with one pivot only, the least node of the bucket that it
  shares most bands with. Most links are then known. In the second round a node is compared with the
  pivots of its other buckets, as far as they are in other classes.
* What is left are buckets that hold several classes still. All their pairs across classes are candidates,
  those with the nodes of the largest class included. Small buckets are joined with themselves. A large one
  is cut into blocks, and each pair of blocks is compared by a task, which verifies the most alike pairs
  first and returns those links alone that join two classes: pairs within a class by then say nothing
  new. A node of which more than a fifth of the runs occur in no other candidate has no link, and is left
  out; a count-min sketch, which never counts too few, finds those. A pair is left out likewise if its
  nodes share too few runs with all other candidates together to be so similar.
* Pairs whose signatures agree in less than 0.62 of the registers are no links: at a similarity of 0.8
  that has a chance below 2e-6. All others are verified on the whole sets of runs, as 64-bit hashes.

No group is gathered in a task: pivots are minima, classes are found by passing on least labels, and of a
large bucket a task sees two blocks. The last round grows with the nodes outside a bucket's largest class
times all its nodes; nodes that are in one class with all others cost nothing there.

A null or empty text has no words. Documents without words are alike only if their texts are the same;
fewer than five words are one run of their own. Null ids count as the largest, repeated rows as copies;
no rows give no rows. Other columns are ignored, or carried along by `first_of_classes`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import join_groups, mixed, numbered, run_hashes, saved
from plumbline.llm.decontaminate import words_of
from plumbline.llm.sketches import hit_twice, sketch

WIDTH = 5
SIMILARITY = 0.8
REGISTERS = 128
ROWS = 4
#: Buckets of at most so many nodes give their pairs by a join; larger ones are compared by blocks.
SMALL = 16
#: Nodes of a block of a large bucket, and of a block's rows that are compared with another's at a time.
BLOCK = 512
PORTION = 32
#: A node of more runs than this does not take them to every block; its pairs are verified by a join.
LONG = 20_000
#: Pairs of a block that are looked at together.
PAIRS = 4096
#: While more pairs than this are left, one of each node is verified first, so many rounds at most.
MANY = 50_000
FIRST_ROUNDS = 3
#: Share of the registers that have to agree for a pair to be verified.
LIKELY = 0.62
#: Bits of the filter that keeps texts without candidates out of the verification's shuffle.
FILTER_BITS = 27
FILTER_SLICES = 64

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words and registers described at a time, which bounds the memory beyond that of one text.
_WORDS = 200_000


def node_key(text: str | None, words: list[bytes]) -> bytes:
    """128 bits that documents with the same words share, or without words those of the same text."""
    return xxhash.xxh3_128_digest(b" ".join(words) if words else b"\0" + (text or "").encode())


def signatures(
    run: np.ndarray, weight: np.ndarray, doc: np.ndarray, n: int, registers: int = REGISTERS
) -> np.ndarray:
    """ProbMinHash of n documents: run hashes with weights, and the document of each.

    The arrivals of a run are exponential waiting times at its weight's rate. They are drawn for all
    runs at once, 1, 2, 4, ... at a time, and a run drops out once it is later than its document's
    latest register.
    """
    earliest = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, dtype=np.uint64)
    time = np.zeros(len(run))
    drawn, width = 0, 1
    while len(run):
        turn = np.arange(drawn, drawn + width, dtype=np.uint64)
        z = mixed(run[:, None] + (turn + np.uint64(1)) * _STEP)
        wait = -np.log(((z >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53)
        at = time[:, None] + np.cumsum(wait, axis=1) / weight[:, None]
        place = (mixed(z ^ _STEP) % np.uint64(registers)).astype(np.int64) + (doc * registers)[:, None]
        sooner = at < earliest[place]
        where, when = place[sooner], at[sooner]
        who = np.broadcast_to(run[:, None], at.shape)[sooner]
        late_first = np.lexsort((who, -when))  # of several in one register, the last one written stays
        earliest[where[late_first]] = when[late_first]
        winner[where[late_first]] = who[late_first]
        time = at[:, -1]
        latest = earliest.reshape(n, registers).max(axis=1)
        going = time < latest[doc]
        run, weight, doc, time = run[going], weight[going], doc[going], time[going]
        drawn, width = drawn + width, min(2 * width, 256)
    return winner.reshape(n, registers)


def weighted_runs(words: list[list[bytes]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of `width` words of several documents: hash, weight, number of the document."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    hashed = np.fromiter(
        (h for w in words for h in map(xxhash.xxh3_64_intdigest, w)), np.uint64, int(sizes.sum())
    )
    run = run_hashes(hashed, width)
    doc = np.repeat(np.arange(len(words)), sizes)
    inside = doc[: len(run)] == doc[width - 1 :] if len(run) else np.zeros(0, dtype=bool)
    run, doc = run[inside], doc[: len(run)][inside]
    order = np.lexsort((run, doc))
    run, doc = run[order], doc[order]
    first = np.flatnonzero(
        np.concatenate([[True], (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])])[: len(run)]
    )
    return run[first], np.diff(np.append(first, len(run))).astype(np.float64), doc[first]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of consecutive texts, some at a time, with the place of the first."""
    held: list[list[bytes]] = []
    size = first = 0
    for at, text in enumerate(texts):
        words = words_of(text)
        held.append(words)
        size += len(words) + REGISTERS
        if size >= _WORDS or at == len(texts) - 1:
            yield first, held
            held, size, first = [], 0, at + 1


def describe(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, row, node, n (distinct runs), bands and registers (a byte each) of every document.

    Documents of fewer words than a run have neither bands nor registers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rows = batch.column("doc_id"), batch.column("row")
            texts = batch.column("text").to_pylist()
            for first, words in _chunks(texts):
                run, _, doc = weighted_runs(words, width)
                n = np.bincount(doc, minlength=len(words))
                having = np.flatnonzero(n)
                number = np.cumsum(n > 0) - 1
                found = signatures(run, np.ones(len(run)), number[doc], len(having))
                sketched = (mixed(found) & np.uint64(255)).astype(np.uint8)
                bands = np.zeros((len(having), REGISTERS // ROWS), dtype=np.uint64)
                bands += np.arange(REGISTERS // ROWS, dtype=np.uint64) * _STEP
                for row in range(ROWS):
                    bands = mixed(bands + found[:, row::ROWS])
                lists: list[list[int] | None] = [None] * len(words)
                short: list[bytes | None] = [None] * len(words)
                for i, at in enumerate(having.tolist()):
                    lists[at] = bands[i].view(np.int64).tolist()
                    short[at] = sketched[i].tobytes()
                keys = [
                    node_key(text, w)
                    for text, w in zip(texts[first : first + len(words)], words, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        names.slice(first, len(words)),
                        rows.slice(first, len(words)),
                        pa.array(keys, pa.binary()),
                        pa.array(n, pa.int64()),
                        pa.array(lists, pa.list_(pa.int64())),
                        pa.array(short, pa.binary()),
                    ],
                    ["doc_id", "row", "node", "n", "bands", "registers"],
                )

    return docs.mapInArrow(
        read,
        "doc_id bigint, row bigint, node binary, n bigint, bands array<bigint>, registers binary",
    )


def _runs_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node and its distinct runs, for the given nodes."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(nodes))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            wanted: list[list[bytes]] = []
            keys: list[bytes] = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                key = node_key(text, words)
                if key not in seen and _held(shared.value, key):
                    seen.add(key)
                    keys.append(key)
                    wanted.append(words)
            run, _, doc = weighted_runs(wanted, width)
            edges = np.searchsorted(doc, np.arange(len(wanted) + 1)).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(edges), pa.array(run.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), runs], ["node", "runs"])

    found = docs.select("text").mapInArrow(read, "node binary, runs array<bigint>")
    return found.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("runs").alias("runs"))


def _bit(key: bytes) -> int:
    return int.from_bytes(key[:8], "little") >> (64 - FILTER_BITS)


def _held(bits: np.ndarray, key: bytes) -> bool:
    at = _bit(key)
    return bool(bits[at >> 3] >> (at & 7) & 1)


def _filter(nodes: DataFrame) -> np.ndarray:
    """A bit for each of 2 ** FILTER_BITS prefixes of keys: of fixed size, and without false misses."""
    part = (1 << FILTER_BITS) // FILTER_SLICES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: dict[int, np.ndarray] = {}
        for batch in batches:
            for key in batch.column("node").to_pylist():
                number, at = divmod(_bit(key), part)
                marks.setdefault(number, np.zeros(part, dtype=bool))[at] = True
        for number, bits in marks.items():
            packed = np.packbits(bits, bitorder="little").tobytes()
            yield pa.RecordBatch.from_pydict({"slice": [number], "bits": [packed]})

    # The key's first 64 bits, of which the highest decide, come little-endian.
    slice_of = F.floor(F.conv(F.hex(F.substring("node", 8, 1)), 16, 10).cast("int") * FILTER_SLICES / 256)
    dealt = nodes.select("node", slice_of.alias("slice")).repartition(FILTER_SLICES, "slice")
    bits = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for row in dealt.select("node").mapInArrow(mark, "slice bigint, bits binary").toLocalIterator():
        first = row["slice"] * part // 8
        bits[first : first + part // 8] |= np.frombuffer(row["bits"], dtype=np.uint8)
    return bits


def _verified(pairs: DataFrame, nodes: DataFrame, runs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of runs are as similar as asked."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS)
                for c in ("registers_a", "registers_b")
            )
            likely = (a == b).mean(axis=1) >= LIKELY
            yield batch.select(["a", "b"]).filter(pa.array(likely))

    a = nodes.select(F.col("node").alias("a"), F.col("registers").alias("registers_a"))
    b = nodes.select(F.col("node").alias("b"), F.col("registers").alias("registers_b"))
    likely = pairs.join(a, "a").join(b, "b").mapInArrow(agree, "a binary, b binary")
    a = runs.select(F.col("node").alias("a"), F.col("runs").alias("runs_a"))
    b = runs.select(F.col("node").alias("b"), F.col("runs").alias("runs_b"))
    both = saved(likely, "likely").join(a, "a").join(b, "b")
    shared = F.size(F.array_intersect("runs_a", "runs_b"))
    return both.filter(
        shared >= F.lit(similarity) * (F.size("runs_a") + F.size("runs_b") - shared) - 1e-9
    ).select("a", "b")


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """node and label, the least node that it is connected with, for all nodes of links.

    `labels` says what is connected already. Every round, each label takes the least of its own and its
    neighbours' labels, and then the label of that; the number of rounds is that of a shortest way's bits.
    """
    if labels is not None:
        links = _relabelled(links, labels)
    links = saved(
        links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "links",
    )
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = saved(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
            "node", F.least("node", "m").alias("label")
        ),
        "labels",
    )
    while True:
        of_b = found.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
        near = both.join(of_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("label_b").alias("near"))
        least = found.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("next")
        )
        of_next = found.select(F.col("node").alias("next"), F.col("label").alias("then"))
        stepped = saved(
            least.join(of_next, "next").select("node", "old", F.least("next", "then").alias("label")), "labels"
        )
        changed = stepped.filter("old != label").limit(1).count()
        found = stepped.select("node", "label")
        if not changed:
            break
    if labels is None:
        return found
    higher = found.select(F.col("node").alias("label"), F.col("label").alias("higher"))
    # A label that its own rows lack is a node that is first linked now.
    moved = labels.join(higher, "label", "left").select(
        "node", F.coalesce("higher", "label").alias("label")
    )
    return saved(
        moved.unionByName(found.join(labels.select("node"), "node", "left_anti")), "labels"
    )


def _relabelled(links: DataFrame, labels: DataFrame) -> DataFrame:
    of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
    of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    return links.join(of_a, "a", "left").join(of_b, "b", "left").select(
        F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")
    )


def _alike_in_size(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-9


def _with_labels(rows: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    side = labels.select(F.col("node").alias("of"), F.col("label").alias(label))
    return rows.join(side, F.col(node) == F.col("of"), "left").drop("of").withColumn(
        label, F.coalesce(label, node)
    )


def _across(pairs: DataFrame, labels: DataFrame, *further: str) -> DataFrame:
    """The pairs (a, b) that are in different classes, with further columns."""
    known = _with_labels(_with_labels(pairs, labels, "a", "la"), labels, "b", "lb")
    return known.filter("la != lb").select("a", "b", *further)


def _held_by_several(buckets: DataFrame) -> DataFrame:
    """size, pivot and members for the buckets that hold several classes, with their rows.

    The pivot is a random node of the class that has most nodes in the bucket, `members`. buckets: bucket, node, n,
    label, and whatever else.
    """
    of_class = buckets.groupBy("bucket", "label").agg(
        F.count(F.lit(1)).alias("members"),
        F.min(F.struct(F.xxhash64("bucket", "node").alias("turn"), "node", "n", "label")).alias("pivot"),
    )
    groups = of_class.groupBy("bucket").agg(
        F.sum("members").alias("size"),
        F.count(F.lit(1)).alias("classes"),
        F.max(F.struct("members", "pivot")).alias("most"),
    )
    several = groups.filter("classes > 1").select(
        "bucket", "size", F.col("most.pivot").alias("pivot"), F.col("most.members").alias("members")
    )
    several = saved(several, "groups")
    total = several.agg(F.sum("size")).first()[0] or 0
    return join_groups(buckets, several, "bucket", "size", total)


def _hashes(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy().view(np.uint64)


def _without_strangers(nodes: DataFrame, runs: DataFrame, similarity: float) -> DataFrame:
    """The nodes of whose runs enough occur in other nodes of `runs` for a link, and how many at most."""
    shared = nodes.sparkSession.sparkContext.broadcast(
        sketch(runs.select("runs"), lambda batch: _hashes(batch.column("runs")))
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("runs")).to_numpy())])
            hit = hit_twice(shared.value, _hashes(batch.column("runs")))
            twice = np.concatenate([[0], np.cumsum(hit)])
            common = twice[ends[1:]] - twice[ends[:-1]]
            enough = pa.array(common >= similarity * np.diff(ends) - 1e-9)
            found = [batch.column("node"), pa.array(common, pa.int64())]
            yield pa.RecordBatch.from_arrays(found, ["node", "common"]).filter(enough)

    return runs.join(nodes, "node", "left_semi").mapInArrow(judge, "node binary, common bigint")


def _dealt_blocks(held: DataFrame) -> DataFrame:
    """The rows of large buckets, once for each pair of blocks that they are compared in.

    The largest class is cut into blocks, and so are all others together. Blocks of others meet one
    another and those of the largest class, which don't meet. held: bucket, node, label, size, pivot,
    members, and whatever else.
    """
    rows = held.withColumn("largest", F.col("label") == F.col("pivot.label"))
    rows = rows.withColumn("others", F.ceil((F.col("size") - F.col("members")) / BLOCK))
    rows = rows.withColumn("blocks", F.col("others") + F.ceil(F.col("members") / BLOCK))
    turn = F.xxhash64("node", "bucket")
    block = F.when(
        F.col("largest"), F.col("others") + F.pmod(turn, F.col("blocks") - F.col("others"))
    ).otherwise(F.pmod(turn, F.col("others")))
    rows = rows.withColumn("block", block)
    meets = F.when(F.col("largest"), F.col("others")).otherwise(F.col("blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), meets - 1)))
    return rows.select(
        "bucket",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        (F.col("block") <= F.col("other")).alias("left"),
        "node", "label", "n", "common", "registers", "runs",
    )


class _Classes:
    """Classes of the nodes of two blocks, as they grow together."""

    def __init__(self, labels: list[np.ndarray]) -> None:
        rows = np.ascontiguousarray(np.concatenate(labels))
        _, self.number = np.unique(rows.view(f"V{rows.shape[1]}").ravel(), return_inverse=True)
        self.root = np.arange(len(rows) and int(self.number.max()) + 1)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.root[self.number[x]] != self.root[self.number[y]]

    def join(self, x: int, y: int) -> None:
        a, b = self.root[self.number[[x, y]]]
        self.root[self.root == b] = a


def _spanning(
    x: np.ndarray, y: np.ndarray, agree: np.ndarray, classes: _Classes, runs: list[np.ndarray | None], similarity: float
) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Of pairs in different classes: verified ones that join all classes the pairs join, and unsure ones.

    The most alike come first, so most others have ended up within a class when their turn comes.
    """
    sure, unsure = [], []
    order = np.argsort(-agree, kind="stable")
    for at in range(0, len(order), PAIRS):
        some = order[at : at + PAIRS]
        for i, j in zip(*(v[some[classes.apart(x[some], y[some])]].tolist() for v in (x, y))):
            a, b = runs[i], runs[j]
            if a is None or b is None:
                unsure.append((i, j))
            elif classes.apart(np.array(i), np.array(j)) and _similar(a, b, similarity):
                classes.join(i, j)
                sure.append((i, j))
    return sure, unsure


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets, in order, are as similar as asked."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(b, a)
    shared = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)) if len(a) else 0
    return shared >= similarity * (len(a) + len(b) - shared) - 1e-9


def _possible(n: np.ndarray, common: np.ndarray, m: np.ndarray, others: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m runs, of which so many at most occur elsewhere, can be as similar as asked."""
    shared = np.minimum(common, others)
    return shared >= similarity * (n + m - shared) - 1e-9


def _rest_pairs(
    open_nodes: DataFrame, labels: DataFrame, runs: DataFrame, similarity: float
) -> tuple[DataFrame, DataFrame]:
    """Links that hold, and pairs (a, b) still to be verified; together they join all that is to be joined.

    open_nodes: node, n, common, bands, registers. A pair of a shared bucket is left out if it is in one
    class, if the number of runs that its nodes share with any other is too small for a link, or in large
    buckets if fewer than LIKELY of the registers agree. Pairs of small buckets come as they are. The
    tasks that compare blocks of large ones have the runs there, verify, and return the links that join
    classes, so no more than there are classes. Only nodes of very many runs are left to be verified.
    """
    known = saved(_with_labels(open_nodes, labels, "node", "label"), "open")
    rows = known.select("node", "n", "label", "common", F.explode("bands").alias("bucket"))
    held = saved(_held_by_several(rows), "held")
    small = held.filter(F.col("size") <= SMALL)
    left, right = (
        small.select("bucket", *[F.col(c).alias(c + end) for c in ("node", "n", "label", "common")])
        for end in ("_a", "_b")
    )
    shared = F.least("common_a", "common_b")
    every = left.join(right, "bucket").filter(
        (F.col("node_a") < F.col("node_b"))
        & (F.col("label_a") != F.col("label_b"))
        & (shared >= F.lit(similarity) * (F.col("n_a") + F.col("n_b") - shared) - 1e-9)
    )
    every = every.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    large = held.filter(F.col("size") > SMALL)
    wanted = large.select("node").distinct()
    described = known.select("node", "registers").join(wanted, "node").join(
        runs.filter(F.size("runs") <= LONG), "node", "left"
    )
    with_runs = large.join(described, "node")

    def compare(group: pa.Table) -> pa.Table:
        def part(left: bool) -> tuple[np.ndarray, ...]:
            mine = group.filter(pa.array(left_side if left else ~left_side))
            fixed = [
                np.frombuffer(b"".join(mine.column(c).to_pylist()), np.uint8).reshape(mine.num_rows, -1)
                for c in ("node", "label", "registers")
            ]
            held = [
                one.values.to_numpy().view(np.uint64) if one.is_valid else None for one in mine.column("runs")
            ]
            return (*fixed, mine.column("n").to_numpy(), mine.column("common").to_numpy(), held)

        left_side = group.column("left").to_numpy()
        a = part(True)
        # A block that meets itself has no right side.
        b = a if group.column("i")[0].as_py() == group.column("j")[0].as_py() else part(False)
        offset = 0 if a is b else len(a[0])
        names, own_runs = (a[0], a[5]) if a is b else (np.concatenate([a[0], b[0]]), a[5] + b[5])
        classes = _Classes([a[1]] if a is b else [a[1], b[1]])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for first in range(0, len(a[0]) if len(b[0]) else 0, PORTION):
            mine = slice(first, first + PORTION)
            possible = _possible(a[3][mine, None], a[4][mine, None], b[3][None], b[4][None], similarity)
            x, y = np.nonzero(possible)
            x += first
            if a is b:
                x, y = x[x < y], y[x < y]
            across = classes.apart(x, y + offset)
            x, y = x[across], y[across]
            agree = np.count_nonzero(a[2][x] == b[2][y], axis=1)
            likely = agree >= LIKELY * REGISTERS
            found.append((x[likely], y[likely] + offset, agree[likely]))
        x, y, agree = (np.concatenate([f[k] for f in found] or [np.zeros(0, int)]) for k in range(3))
        sure, unsure = _spanning(x, y, agree, classes, own_runs, similarity)
        pairs = [sorted((names[i].tobytes(), names[j].tobytes())) for i, j in sure + unsure]
        return pa.Table.from_arrays(
            [
                pa.array([p for p, _ in pairs], pa.binary()),
                pa.array([q for _, q in pairs], pa.binary()),
                pa.array([True] * len(sure) + [False] * len(unsure), pa.bool_()),
            ],
            ["a", "b", "sure"],
        )

    met = _dealt_blocks(with_runs).groupBy("bucket", "i", "j")
    by_blocks = saved(met.applyInArrow(compare, "a binary, b binary, sure boolean"), "by_blocks")
    unsure = by_blocks.filter(~F.col("sure")).select("a", "b")
    return by_blocks.filter("sure").select("a", "b"), every.unionByName(unsure).distinct()


def _linked_by_rest(
    links: DataFrame, pairs: DataFrame, labels: DataFrame, nodes: DataFrame, runs: DataFrame, similarity: float
) -> DataFrame:
    """The labels after the links, and after the pairs that turn out to be links.

    While many pairs are across classes, one of each node is verified first; then all that are left.
    """
    labels = components(links, labels)
    left = saved(_across(pairs, labels), "pairs")
    for _ in range(FIRST_ROUNDS):
        if left.count() <= MANY:
            break
        ends = left.select(F.explode(F.array("a", "b")).alias("end"), "a", "b")
        first = ends.groupBy("end").agg(F.min(F.struct("a", "b")).alias("one"))
        first = saved(first.select("one.a", "one.b").distinct(), "first")
        labels = components(_verified(first, nodes, runs, similarity), labels)
        left = saved(_across(left.join(first, ["a", "b"], "left_anti"), labels), "pairs")
    return components(_verified(left, nodes, runs, similarity), labels)


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, row: str | None = None
) -> DataFrame:
    """doc_id, class_id, class_size, kept, node and row of every document.

    class_id is the least doc_id of the class. `row` names a column that tells rows apart, if there is
    one; else rows are numbered. `node` is shared by documents with the same words.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("row"), "text")
    described = saved(describe(plain, width), "described")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("best")
    copies = described.groupBy("node").agg(first, F.count(F.lit(1)).alias("copies"))
    copies = saved(copies, "nodes")
    nodes = described.join(
        copies.select("node", F.col("best.row").alias("best_row")), "node"
    ).filter(F.col("row") == F.col("best_row"))
    nodes = saved(nodes.filter("bands IS NOT NULL").select("node", "n", "bands", "registers"), "bands")

    buckets = nodes.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    groups = saved(
        buckets.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("node", "n")).alias("pivot"))
        .filter("size > 1"),
        "groups",
    )
    shared = saved(join_groups(buckets, groups, "bucket", "size", nodes.count()), "shared")

    # First round: each node's most promising pivot.
    to_pivot = shared.filter(
        (F.col("node") != F.col("pivot.node")) & _alike_in_size("n", "pivot.n", similarity)
    )
    bands_shared = to_pivot.groupBy("node", F.col("pivot.node").alias("p")).agg(F.count(F.lit(1)).alias("c"))
    best = bands_shared.groupBy("node").agg(F.min(F.struct(-F.col("c"), F.col("p"))).alias("best"))
    runs = saved(_runs_of(docs, saved(shared.select("node").distinct(), "candidates"), width), "runs")
    first = best.select(F.col("node").alias("a"), F.col("best.p").alias("b"))
    labels = components(_verified(first, nodes, runs, similarity))

    # Second round: its other pivots.
    others = bands_shared.select(F.col("node").alias("a"), F.col("p").alias("b"))
    labels = components(_verified(_across(others, labels), nodes, runs, similarity), labels)

    # Third round: what shares a bucket with another class still.
    in_buckets = _with_labels(shared.select("bucket", "node"), labels, "node", "label")
    mixed_buckets = in_buckets.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    mixed_buckets = saved(mixed_buckets.filter("low != high").select("bucket", "size"), "groups")
    in_mixed = join_groups(shared.select("bucket", "node"), mixed_buckets, "bucket", "size", nodes.count())
    open_nodes = _without_strangers(in_mixed.select("node").distinct(), runs, similarity)
    open_nodes = saved(nodes.join(open_nodes, "node"), "open")
    links, pairs = _rest_pairs(open_nodes, labels, runs, similarity)
    labels = _linked_by_rest(links, pairs, labels, nodes, runs, similarity)

    of_node = copies.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_node = saved(of_node, "classes")
    classes = saved(
        of_node.groupBy("label").agg(
            F.min("best").alias("first"),
            F.sum("copies").alias("class_size"),
            F.count(F.lit(1)).alias("class_nodes"),
        ),
        "classes",
    )
    total = of_node.count()
    by_node = saved(
        join_groups(of_node, classes, "label", "class_nodes", total).select(
            "node", "copies", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("first_row"),
            "class_size",
        ),
        "classes",
    )
    joined = join_groups(
        described.select("doc_id", "node", "row"), by_node, "node", "copies", described.count()
    )
    return joined.select(
        "doc_id", "class_id", "class_size", (F.col("row") == F.col("first_row")).alias("kept"), "node", "row"
    )


def first_of_classes(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, with the columns it came with."""
    kept = saved(numbered(docs, F.struct(*docs.columns).alias("doc")), "documents")
    found = near_duplicates(kept.select("row", "doc.doc_id", "doc.text"), width, similarity, "row")
    chosen = found.filter("kept").select("row")
    return kept.join(chosen, "row", "left_semi").select(*[F.col("doc")[c].alias(c) for c in docs.columns])
