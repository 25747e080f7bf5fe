"""CSV input with missing-value words and strict type inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from pathlib import PurePosixPath
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, Row, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.parsing import NUMBER_PATTERN, matching
from plumbline.plans.storage import settle

# Texts that stand for a missing value.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Texts read as a boolean.
TRUE_WORDS = ("True", "TRUE", "true")
FALSE_WORDS = ("False", "FALSE", "false")

INTEGER_PATTERN = "[+-]?[0-9]+"

# Where a line ends within a quoted value, for one that begins outside and one within. A quote
# opens a value only as its first character; behind the closing one anything goes up to the next comma.
_QUOTED = '(?:[^"]++|"")*+'
_LEFT_OPEN = f'(?:(?:"{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+"{_QUOTED}'
OPENED = rf"\A{_LEFT_OPEN}\z"
STILL_OPEN = rf'\A{_QUOTED}(?:"[^,]*+,{_LEFT_OPEN})?+\z'

# Lines of a block of a file, and what of them becomes records.
_BLOCK_ROW = (
    "file bigint, start bigint, ends_open boolean, still_open boolean, closes boolean, returns int, header binary"
)
_PIECE_ROW = "file bigint, origin bigint, start bigint, piece binary"


def read_csv(
    spark: SparkSession,
    path: str,
    types: Mapping[str, str] | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Read one CSV file with a header, or a folder or pattern of such files.

    Types are inferred from all values in one extra pass; ``types`` (column to Spark type, the
    rest being text) saves that pass. A file is read by many tasks. Where a quoted value may hold a
    line break, its lines are first put together to records, which takes a copy of them in the shared
    folder. One pass over the lines finds the files where that may be, by an odd number of quotes in a
    line; ``multi_line`` saves that pass, saying so for all files or for none.
    """
    text = read_csv_text(spark, path, multi_line)
    if types is None:
        types = infer_types(text)
    unknown = sorted(set(types) - set(text.columns))
    if unknown:
        raise ValueError(f"no such columns {unknown}")
    renamed = text.toDF(*[f"c{i}" for i in range(len(text.columns))])
    return renamed.select(
        *[
            _as_type(F.col(f"c{i}"), types.get(name, "string")).alias(name)
            for i, name in enumerate(text.columns)
        ]
    )


def read_csv_text(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """The CSV as it is, all columns as text."""
    last = PurePosixPath(path).name
    try:
        if multi_line is None:
            whole, split = _files_by_quotes(spark, path)
        else:
            whole, split = ([path], []) if multi_line else ([], [path])
        parts = [_reader(spark, False).csv(split)] if split else []
        if whole:
            parts.append(_read_records(spark, whole))
        raw = parts[0] if parts else _reader(spark, False).csv(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no CSV file at {path}") from error
        raise
    suffix = PurePosixPath(last).suffix.lower()
    if suffix not in ("", ".csv"):
        raise ValueError(f"expected a .csv file, not {suffix}")
    if len(parts) == 2:
        if parts[0].columns != parts[1].columns:
            raise ValueError("the files have different headers")
        raw = raw.union(parts[1])
    return raw


def _reader(spark: SparkSession, multi_line: bool) -> DataFrameReader:
    return (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
    )


def _files_by_quotes(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Files with a line that has an odd number of quotes, and the others; one row per file comes here.

    Without such a line no quote is open at any line's end, so every line break ends a record.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        (F.length("value") - F.length(F.replace("value", F.lit('"')))).alias("quotes"),
    )
    found = lines.groupBy("file").agg(F.max(F.col("quotes") % 2).alias("odd")).collect()
    files = [(unquote(row["file"]), row["odd"]) for row in found]
    return [file for file, odd in files if odd], [file for file, odd in files if not odd]


def _read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV with line breaks within quoted values, all columns as text; a file is read by many tasks.

    Whether a line begins within a value depends on all lines before it, so each block of a file says how it
    ends in either case, and from that, one row per block, follows how each begins. Then every block's task
    puts its lines together; a record that goes on in the next block is joined from its pieces. The lines are
    kept in the shared folder, as blocks could be cut otherwise when read again.

    Some files are read by one task each, as Spark does it: those with a carriage return alone in their first
    line, a value open at their end, or a header that is not the one of the first file, blank, or longer than
    a block.
    """
    whole = _reader(spark, True).csv(paths)
    if not whole.columns:
        return whole
    path = F.col("_metadata.file_path")
    source = spark.read.option("lineSep", "\n").text(paths)
    has_quote = F.instr("value", '"') > 0
    lines = settle(
        source.select(
            F.xxhash64(path).alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            (has_quote & F.col("value").rlike(OPENED)).alias("opens"),
            (~has_quote | F.col("value").rlike(STILL_OPEN)).alias("stays"),
            F.col("value").cast("binary").alias("line"),
        )
    )
    blocks, others = _block_starts(whole, lines.mapInArrow(_block_ends(), _BLOCK_ROW).collect())
    if not blocks:
        return whole
    pieces = lines.mapInArrow(_pieces(blocks), _PIECE_ROW)
    # At most two pieces for each block.
    joined = settle(
        pieces.filter("origin IS NOT NULL").groupBy("file", "origin")
        .agg(F.array_sort(F.collect_list(F.struct("start", F.col("piece").cast("string").alias("piece")))).alias("all"))
        .select(F.array_join("all.piece", "\n").alias("record"))
    )
    records = pieces.filter("origin IS NULL").select(F.col("piece").cast("string").alias("record")).union(joined)
    names = whole.columns
    kinds = ", ".join(f"c{i} string" for i in range(len(names)))
    values = records.select(F.from_csv("record", kinds, {"quote": '"', "escape": '"'}).alias("v"))
    found = values.select(*[F.col(f"v.c{i}").alias(name) for i, name in enumerate(names)])
    if others:
        odd = source.select(path.alias("file")).distinct().filter(F.xxhash64("file").isin(others)).collect()
        files = [unquote(row["file"]) for row in odd]
        found = found.union(_reader(spark, True).schema(whole.schema).csv(files))
    return found


def _block_ends() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each block whether it ends within a value, if it begins outside (``ends_open``) or within one
    (``still_open``), and whether the latter is closed in it. Of a file's first block also the header, and
    whether its first line has a carriage return: 1 at the end only, 2 elsewhere.

    It is a closure so that it travels to the executors by value, which do not have this package.
    """
    schema = pa.schema(
        [("file", pa.int64()), ("start", pa.int64()), ("ends_open", pa.bool_()), ("still_open", pa.bool_()),
         ("closes", pa.bool_()), ("returns", pa.int32()), ("header", pa.binary())]
    )

    def follow(batches):
        found, block, header, lines = [], None, [], 0
        for batch in batches:
            for file, start, opens, stays, line in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if (file, start) != block:
                    block, header, lines = (file, start), [], 0
                    found.append(dict(zip(schema.names, (file, start, False, True, False, 0, None))))
                last = found[-1]
                lines += 1
                if start == 0 and lines == 1 and b"\r" in line:
                    last["returns"] = 1 if line.index(b"\r") == len(line) - 1 else 2
                if start == 0 and last["header"] is None:
                    if last["returns"] == 1 and line.endswith(b"\r"):
                        line = line[:-1]
                    if header or line:
                        header.append(line)
                        if not (stays if last["ends_open"] else opens):
                            last["header"] = b"\n".join(header)
                last["ends_open"] = stays if last["ends_open"] else opens
                last["still_open"] = stays if last["still_open"] else opens
                last["closes"] |= not last["still_open"]
        if found:
            yield pa.RecordBatch.from_pylist(found, schema)

    return follow


def _block_starts(
    whole: DataFrame, rows: list[Row]
) -> tuple[dict[tuple[int, int], tuple[int | None, bool]], list[int]]:
    """For each block the one in which the record began that is open at its start, if one is, and whether its
    lines lose a carriage return; and the files that have to be read whole.
    """
    files: dict[int, list[Row]] = {}
    for row in sorted(rows, key=lambda row: (row["file"], row["start"])):
        files.setdefault(row["file"], []).append(row)
    headers = {row["header"] for row in rows if row["header"] is not None}
    usual = {header for header in headers if _names_columns(whole, header)}
    blocks, others = {}, []
    for file, parts in files.items():
        origin = None
        starts = {}
        for row in parts:
            starts[file, row["start"]] = (origin, parts[0]["returns"] == 1)
            if origin is None:
                origin = row["start"] if row["ends_open"] else None
            elif row["closes"]:
                origin = row["start"] if row["still_open"] else None
        first = parts[0]
        # Two files of one hash would show as a block that is there twice.
        twice = len(starts) < len(parts)
        if twice or first["start"] or first["returns"] == 2 or first["header"] not in usual or origin is not None:
            others.append(file)
        else:
            blocks |= starts
    return blocks, others


def _names_columns(whole: DataFrame, header: bytes) -> bool:
    """Whether a header holds the names of the columns, as Spark compares them."""
    spark = whole.sparkSession
    text = spark.sparkContext.parallelize([header.decode(errors="replace")], 1)
    first = _reader(spark, False).option("header", False).csv(text).first()
    same = spark.conf.get("spark.sql.caseSensitive") == "true"
    given, names = [[n if same else (n or "").lower() for n in row] for row in (first or (), whole.columns)]
    return given == names


def _pieces(
    blocks: dict[tuple[int, int], tuple[int | None, bool]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records, without an origin, and the pieces of those in several blocks, with the block in which they began.

    It is a closure so that it travels to the executors by value, which do not have this package.
    """
    schema = pa.schema([*[(n, pa.int64()) for n in ("file", "origin", "start")], ("piece", pa.binary())])
    many, large = 4096, 1 << 24

    def assemble(batches):
        block, known, held, out, size = None, None, [], [], 0
        origin, returns, within, header = None, False, False, False

        def flushed():
            return pa.RecordBatch.from_pylist(
                [dict(zip(("file", "origin", "start", "piece"), row)) for row in out], schema
            )

        for batch in batches:
            for file, start, opens, stays, line in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if (file, start) != block:
                    if held:  # goes on in the next block
                        out.append((block[0], block[1] if origin is None else origin, block[1], b"\n".join(held)))
                    block, held = (file, start), []
                    known = blocks.get(block)
                    origin, returns = known or (None, False)
                    within, header = origin is not None, start == 0
                if known is None:
                    continue
                if returns and line.endswith(b"\r"):
                    line = line[:-1]
                if not (within or line):
                    continue
                held.append(line)
                size += len(line)
                within = stays if within else opens
                if within:
                    continue
                if header:
                    header = False
                else:
                    out.append((file, origin, start, b"\n".join(held)))
                held, origin = [], None
                if len(out) >= many or size >= large:
                    yield flushed()
                    out, size = [], 0
        if held:
            out.append((block[0], block[1] if origin is None else origin, block[1], b"\n".join(held)))
        if out:
            yield flushed()

    return assemble


def infer_types(text: DataFrame) -> dict[str, str]:
    """The narrowest of bigint, double and boolean that all values of a column fit, else string.

    Words for a missing value fit every type.
    """
    names = text.columns
    renamed = text.toDF(*[f"c{i}" for i in range(len(names))])
    totals = [F.count(F.lit(1)).alias("row_count")]
    for i in range(len(names)):
        value = F.col(f"c{i}")
        fits = {
            "bigint": _as_type(value, "bigint"),
            "double": _as_type(value, "double"),
            "boolean": _as_type(value, "boolean"),
        }
        totals.append(F.count(_as_type(value, "string")).alias(f"present_{i}"))
        totals += [F.count(fit).alias(f"{kind}_{i}") for kind, fit in fits.items()]
    found = renamed.agg(*totals).first()
    types = {}
    for i, name in enumerate(names):
        present = found[f"present_{i}"]
        if present == 0:
            # A column without any value reads as numbers that are all missing.
            types[name] = "double" if found["row_count"] else "string"
            continue
        types[name] = next(
            (k for k in ("bigint", "double", "boolean") if found[f"{k}_{i}"] == present), "string"
        )
    return types


def _as_type(text: Column, kind: str) -> Column:
    """The text as a type; null for missing-value words and for what does not fit."""
    if kind == "bigint":
        return matching(text, INTEGER_PATTERN).try_cast("bigint")
    if kind == "double":
        return matching(text, NUMBER_PATTERN).try_cast("double")
    if kind == "boolean":
        return F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False)
    present = F.when(~text.isin(*MISSING_WORDS), text)
    return present if kind == "string" else present.try_cast(kind)
