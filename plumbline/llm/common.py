"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.storage import scratch_path

#: One word to people who count white space: [^\x20\x09-\x0D]+.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where a vocabulary file of the installed public tokenizers is, here and on the executors."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Lists that take down what `saved` writes, the innermost last.
_RECORDS: list[list[str]] = []


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """While it lasts, the folders of intermediate tables are added to `paths`."""
    _RECORDS.append(paths)
    try:
        yield
    finally:
        _RECORDS.pop()


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Remove intermediate tables that nothing reads any more, and forget them."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read from there.

    Cuts the lineage: a lost executor repeats at most the tasks that read the files. Row numbers given
    before are fixed from here on.
    """
    path = scratch_path(df.sparkSession, name)
    if _RECORDS:
        _RECORDS[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """The chosen columns after a row number `row`; stable only once the result is saved."""
    return docs.select(F.monotonically_increasing_id().alias("row"), *columns)


def text_of(docs: DataFrame) -> Column:
    """The whole text, null as empty."""
    return F.coalesce(docs["text"], F.lit(""))


def held_out(doc_id: Column) -> Column:
    """The evaluation fold: crc32 of the id as text, modulo 5, is 0. A null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def early(hashed: Column, sample: Column | int, total: Column) -> Column:
    """Whether a 64-bit hash is among the smallest of `total` of which `sample` are wanted, or near.

    Twice as many as wanted are let through, so that few rows meet where the smallest are picked.
    """
    place = (hashed.cast("double") + 2.0**63) / 2.0**64
    return place * total <= F.lit(2.0) * sample + 64


#: A group of more than this share of the rows is hot. There are at most 1 / HOT_SHARE such groups,
#: which bounds the broadcast of them.
HOT_SHARE = 0.001


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Join each row with its group; `groups` has one row per key, and `size` counts its `rows`.

    A group that many rows belong to meets them without a shuffle; no other group is large.
    """
    hot = F.col(size) > F.lit(HOT_SHARE * total)
    few = F.broadcast(groups.filter(hot))
    return rows.join(few, key).unionByName(
        rows.join(few.select(key), key, "left_anti").join(groups.filter(~hot), key)
    )


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit integers: the finishing step of a public-domain generator (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words from each place on; the last width - 1 places have none.

    Built from runs of 1, 2, 4, ... words, so a long width costs its number of bits.
    """
    n = len(words) - width + 1
    if n <= 0:
        return words[:0]
    out, done, run, size = None, 0, words, 1
    while True:
        if width & size:
            piece = run[done : done + n]
            out = piece if out is None else mixed(out * _M2 + piece)
            done += size
        if done == width:
            return out
        run = mixed(run[: len(run) - size] * _M1 + run[size:])
        size *= 2
