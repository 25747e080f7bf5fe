"""Exact deduplication against a persistent digest index.

The index is a Parquet table, bucketed and sorted by the SHA-256 digest of the text, so that the join
with it never shuffles it. New documents are reduced to one row per digest first, a sort-merge anti-join
finds the digests that the index lacks, and those are appended. Rows may come in batches of falling
doc_id: each asks the index that those before it left, so the row with the largest doc_id is the one in it.

Null counts as the empty text, which is a text like any other. Of equal new texts the row with the
largest doc_id stays, null ids last; of rows that agree in text and id exactly one stays. Empty input
appends nothing. Texts of any length are read whole and travel as their digests alone. Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import join_groups, numbered, saved, shuffle_partitions, text_of
from plumbline.plans.storage import scratch_path

@dataclass(frozen=True)
class DigestIndex:
    """Where an index is: a folder, and the number of buckets it was made with."""

    spark: SparkSession
    path: str
    buckets: int

    @property
    def table(self) -> str:
        return "digest_index_" + hashlib.md5(self.path.encode()).hexdigest()

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def forget(self) -> None:
        """Take the index out of the catalog; its files stay and can be opened again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


#: Name of the mark beside the data that says how many buckets there are.
_MARK = "_buckets_"


def _stored_buckets(spark: SparkSession, path: str, wanted: int | None) -> int:
    """The number of buckets of the index in a folder, noted there if it is new."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    marks = [int(name.removeprefix(_MARK)) for name in names if name.startswith(_MARK)]
    if not marks:
        if any(name.endswith(".parquet") for name in names):
            raise ValueError(f"{path} holds data but not the mark of an index")
        marks = [wanted or shuffle_partitions(spark)]
        files.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{_MARK}{marks[0]}"))
    if wanted not in (None, marks[0]):
        raise ValueError(f"the index in {path} has {marks[0]} buckets, not {wanted}")
    return marks[0]


def open_index(spark: SparkSession, path: str | None = None, buckets: int | None = None) -> DigestIndex:
    """The index in a folder, made if it isn't there; without a path, a new one in the shared folder.

    `buckets` counts for a new index only, about one for each 100 MB of digests; an index that is
    there keeps its own, and another number is an error.
    """
    path = path or scratch_path(spark, "digest-index")
    index = DigestIndex(spark, path, _stored_buckets(spark, path, buckets))
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {index.table} (digest BINARY, keep_id BIGINT) USING parquet "
        f"CLUSTERED BY (digest) SORTED BY (digest) INTO {index.buckets} BUCKETS "
        f"LOCATION '{index.path}'"
    )
    return index


def append_new(index: DigestIndex, docs: DataFrame, batches: int = 1) -> DataFrame:
    """Append texts that the index lacks; say of each row whether it stays.

    With `batches`, rows are cut by doc_id into that many parts of about one size, and the index takes
    them one after the other, the largest ids first and null ids last.

    Returns doc_id, keep_id (of the row that stays, perhaps of an earlier call), group_size (rows of
    this call with the text), kept, digest.
    """
    digests = saved(
        numbered(docs, "doc_id", F.unhex(F.sha2(text_of(docs), 256)).alias("digest")), "digests"
    )
    parts = [_resolve(index, batch) for batch in _falling(digests, batches)]
    groups = parts[0]
    if len(parts) > 1:
        # The index gave a text one keep_id in all batches, and at most one batch holds its row.
        groups = reduce(DataFrame.unionAll, parts).groupBy("digest").agg(
            F.sum("group_size").alias("group_size"),
            F.max("keep_id").alias("keep_id"),
            F.max("keep_row").alias("keep_row"),
        )
        groups = saved(groups, "groups")
    joined = join_groups(digests, groups, "digest", "group_size", digests.count())
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("row").eqNullSafe(F.col("keep_row")).alias("kept"),
        "digest",
    )


def _falling(digests: DataFrame, batches: int) -> list[DataFrame]:
    """The rows cut by doc_id, the largest first; all rows of one id are in one part."""
    if batches < 2:
        return [digests]
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted({int(c) for c in digests.approxQuantile("doc_id", shares, 0.01)}, reverse=True)
    # A null id is above no cut, so it is in the last part.
    part = F.lit(0)
    for cut in cuts:
        part = part + F.when(F.col("doc_id") > cut, 0).otherwise(1)
    return [digests.filter(part == i) for i in range(len(cuts) + 1)]


def _resolve(index: DigestIndex, digests: DataFrame) -> DataFrame:
    """Which row of each text stays, by the index as it is now; then the index holds them all."""
    groups = digests.groupBy("digest").agg(
        F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    known = index.read().withColumnRenamed("keep_id", "known_id").withColumn("known", F.lit(True))
    # What was known has to be read before the append.
    resolved = saved(
        groups.join(known.hint("merge"), "digest", "left").select(
            "digest",
            "group_size",
            F.when(F.col("known"), F.col("known_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
            F.when(F.col("known").isNull(), F.col("best.row")).alias("keep_row"),
        ),
        "groups",
    )
    fresh = resolved.join(index.read().hint("merge"), "digest", "left_anti")
    fresh.select("digest", "keep_id").write.insertInto(index.table)
    return resolved
