"""Mixing sources to target weights by a splitting tree of exact quotas.

Every document is cut into blocks of at most `block_words` words. A source whose target is several
times its size is read in whole passes and one partial pass; each pass has an order of its own, by
the hash of seed, document, block and pass. So a source offers one sequence of draws, and the mix takes
a prefix of it that holds exactly its target, rounded; only the last block of the prefix is cut short.

The draws are dealt to output shards by a tree: at every node the left half of the shards gets a
multivariate-hypergeometric sample of the sources' block counts, the right half the rest. A leaf's
counts are its exact quotas, and it owns that many consecutive draws of each source's permuted
sequence, so shards are disjoint. Within a shard the blocks are ordered by another hash.

Only sizes go through the shuffles of the draw, no texts; `mix_documents` deals out the texts it returns.
Ranks within a source come from sums over about sqrt(blocks) hash ranges, so no task holds a source. The
driver sees one row per source and one count per source and shard.

A null or empty text has size 0 and takes nothing; a null source is a source of its own, the last; rows
that repeat an id are separate documents; without words all targets are 0. Columns other than doc_id,
text and source are ignored by `draw`, and carried along by `mix_documents`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import SPACED_WORD, numbered, saved, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 1024
#: Blocks that an output shard holds.
SHARD_BLOCKS = 100_000
#: The mixing plan has a row per source; more sources than this are refused.
MAX_SOURCES = 100_000
SEED = 8


def targets(
    sizes: Sequence[int],
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> list[float]:
    """What each source gives: `share` of all sizes by weight, at most `most` times its size.

    What is above the limit is shared again by weight among the others until none is above.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    rest = min(share, most) * sum(sizes)
    fixed: dict[int, float] = {}
    while True:
        open_weight = sum(w for i, w in enumerate(weight) if i not in fixed)
        above = {
            i: float(most * n)
            for i, n in enumerate(sizes)
            if i not in fixed and rest * weight[i] / open_weight > most * n
        }
        if not above:
            break
        fixed |= above
        rest -= sum(above.values())
    return [fixed[i] if i in fixed else rest * weight[i] / open_weight for i in range(len(sizes))]


def split_quotas(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) in each shard (rows); the rows are as equal as can be."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(first: int, last: int, counts: np.ndarray) -> None:
        if last - first == 1:
            out[first] = counts
            return
        middle = (first + last) // 2
        generator = np.random.default_rng([seed, first, last])
        share = int(counts.sum()) * (middle - first) // (last - first)
        left = generator.multivariate_hypergeometric(counts, share, method="marginals")
        split(first, middle, left)
        split(middle, last, counts - left)

    split(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


def measure(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row, doc_id, source and size of every document; no texts."""
    size = F.regexp_count(text_of(docs), F.lit(SPACED_WORD)).cast("long").alias("size")
    chosen = [docs["doc_id"].cast("long").alias("doc_id"), docs["source"], size]
    found = docs.select(docs[row].alias("row"), *chosen) if row else numbered(docs, *chosen)
    return saved(found, "sizes")


def plan_sources(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> list[dict]:
    """One entry per source, by code point, null last: source, size, blocks, target, passes, rest."""
    blocks = F.ceil(F.col("size") / block_words)
    found = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("size"), F.sum(blocks).alias("blocks"))
        .limit(MAX_SOURCES + 1)
        .collect()
    )
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    plan = []
    for row, target in zip(found, targets([r["size"] for r in found]), strict=True):
        size, take = row["size"], math.floor(target + 0.5)
        passes = take // size if size else 0
        plan.append(row.asDict() | {"target": target, "passes": passes, "rest": take - passes * size})
    return plan


def _order(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))


def _with_plan(df: DataFrame, plan: list[dict], schema: str) -> DataFrame:
    """The sources' rows of the plan; there are at most MAX_SOURCES, so they are broadcast."""
    names = [part.split()[0] for part in schema.split(", ")]
    values = [tuple(entry[name] for name in names) for entry in plan]
    side = df.sparkSession.createDataFrame(values, schema).withColumnRenamed("source", "plan_source")
    return df.join(F.broadcast(side), df["source"].eqNullSafe(side["plan_source"])).drop("plan_source")


def draw(
    sizes: DataFrame,
    plan: list[dict],
    block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    seed: int = SEED,
) -> DataFrame:
    """The blocks that the mix takes: shard, position, source, row, doc_id, pass, block, taken.

    `taken` counts the words taken from the block's start; it is less than the block only in the last
    block of a source.
    """
    blocks = sum(entry["blocks"] * (entry["passes"] + 1) for entry in plan)
    digits = max(1, math.ceil(math.log(max(blocks, 2), 16) / 2))
    offered = (
        _with_plan(sizes, plan, "source string, passes long, rest long")
        .filter("size > 0")
        .withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
        .filter((F.col("pass") < F.col("passes")) | (F.col("rest") > 0))
        .withColumn(
            "block",
            F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / block_words) - 1)),
        )
        .withColumn("words", F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words))
        .withColumn(
            "at", _order(F.lit(seed), F.col("doc_id"), F.col("block"), F.col("pass"))
        )
        .withColumn("range", F.substring("at", 1, digits))
    )
    key = ["source", "pass", "range"]
    earlier = Window.partitionBy("source", "pass").orderBy("range")
    ranges = (
        offered.groupBy(*key)
        .agg(F.sum("words").alias("range_words"), F.count(F.lit(1)).alias("range_blocks"))
        .select(
            F.col("source").alias("source_"),
            F.col("pass").alias("pass_"),
            F.col("range").alias("range_"),
            (F.sum("range_words").over(earlier) - F.col("range_words")).alias("words_before"),
            (F.sum("range_blocks").over(earlier) - F.col("range_blocks")).alias("blocks_before"),
        )
    )
    # Ties of the hash: rows that repeat an id. They take their turns by size.
    within = Window.partitionBy(*key).orderBy("at", "size", "row")
    ranked = offered.select(
        "*",
        (F.sum("words").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).alias("w"),
        (F.row_number().over(within) - 1).alias("b"),
    ).join(
        ranges,
        F.col("source").eqNullSafe(F.col("source_"))
        & (F.col("pass") == F.col("pass_"))
        & (F.col("range") == F.col("range_")),
    )
    left = F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(
        F.col("rest") - F.col("words_before") - F.col("w")
    )
    taken = saved(
        ranked.withColumn("taken", F.least(F.col("words"), left))
        .filter("taken > 0")
        .select("source", "row", "doc_id", "size", "pass", "block", "taken", "at",
                (F.col("blocks_before") + F.col("b")).alias("rank")),
        "draws",
    )
    return _dealt(taken, plan, shard_blocks, seed)


def _dealt(taken: DataFrame, plan: list[dict], shard_blocks: int, seed: int) -> DataFrame:
    drawn = {row["source"]: row["count"] for row in taken.groupBy("source").count().collect()}
    quotas = [drawn.get(entry["source"], 0) for entry in plan]
    shards = max(1, -(-sum(quotas) // shard_blocks))
    ends = np.cumsum(split_quotas(quotas, shards, seed), axis=0)
    lines = [{"source": e["source"], "blocks": e["blocks"], "number": i} for i, e in enumerate(plan)]
    wide = _with_plan(taken, lines, "source string, blocks long, number long")

    @F.pandas_udf("long")
    def shard_of(number: pd.Series, turn: pd.Series) -> pd.Series:
        out = np.zeros(len(turn), dtype=np.int64)
        for n in number.unique():
            mine = (number == n).to_numpy()
            out[mine] = np.searchsorted(ends[:, n], turn.to_numpy()[mine], side="right")
        return pd.Series(out)

    turn = F.col("pass") * F.col("blocks") + F.col("rank")
    mixed = wide.withColumn("shard", shard_of("number", turn))
    local = Window.partitionBy("shard").orderBy(
        _order(F.lit(seed), F.col("shard"), F.col("at")), "row", "block", "pass"
    )
    return mixed.select(
        "shard",
        (F.row_number().over(local) - 1).alias("position"),
        "source", "row", "doc_id", "size", "pass", "block", "taken",
    )


def taken_by_document(
    sizes: DataFrame, plan: list[dict], draws: DataFrame
) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    whole = sizes.select("row", "doc_id", "source", "size", F.lit(0).cast("long").alias("taken"))
    both = whole.unionByName(draws.select("row", "doc_id", "source", "size", "taken"))
    summed = both.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("source").alias("source"),
        F.first("size").alias("size"),
        F.sum("taken").alias("taken"),
    )
    lines = [entry | {"source_size": entry["size"]} for entry in plan]
    return _with_plan(summed, lines, "source string, source_size long, target double").select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def mix_documents(
    docs: DataFrame,
    block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    seed: int = SEED,
) -> DataFrame:
    """The mix as rows with the columns of `docs`: the drawn blocks, by shard and position in it.

    A document of one block comes whole and unchanged for each pass that draws it, unless it is cut short.
    Of longer ones every drawn block is a row of its own, with its words joined by single spaces. A
    partition holds consecutive rows of that order, so no task holds a shard's texts.
    """
    kept = saved(numbered(docs, F.struct(*docs.columns).alias("doc")), "mixed")
    sizes = measure(kept.select("row", "doc.doc_id", "doc.text", "doc.source"), "row")
    plan = plan_sources(sizes, block_words)
    draws = draw(sizes, plan, block_words, shard_blocks, seed)
    # A document's blocks are few, and their numbers are all that is gathered.
    drawn = draws.groupBy(F.col("row").alias("draw_row"), F.col("pass").alias("draw_pass")).agg(
        F.max("size").alias("draw_size"),
        F.collect_list(F.struct("shard", "position", "block", "taken")).alias("draw_blocks"),
    )
    drawn = saved(drawn, "dealt")
    whole = F.col("doc.text")
    words = F.regexp_extract_all(F.coalesce(whole, F.lit("")), F.lit(SPACED_WORD), F.lit(0))
    unchanged = F.col("draw_blocks")[0]["taken"] == F.col("draw_size")
    # Words are found once for a document and pass, not for each block.
    found = kept.join(drawn, F.col("row") == F.col("draw_row")).select(
        "doc", "draw_size", "draw_blocks", F.when(~unchanged, words).alias("words")
    )
    each = found.select("doc", "draw_size", "words", F.explode("draw_blocks").alias("b"))
    piece = F.array_join(
        F.slice("words", (F.col("b.block") * block_words + 1).cast("int"), F.col("b.taken").cast("int")), " "
    )
    text = F.when(F.col("b.taken") == F.col("draw_size"), whole).otherwise(piece)
    order = ("shard", "position")
    dealt = each.select("doc", text.alias("piece"), *[F.col("b")[c].alias(c) for c in order])
    return dealt.repartitionByRange(*order).sortWithinPartitions(*order).select(
        *[F.col("piece").alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns]
    )
