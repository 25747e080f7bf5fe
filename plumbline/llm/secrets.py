"""Secret scan: three patterns, and strings that tests of randomness don't tell from random ones.

Base spans are the leftmost, non-overlapping matches of three patterns that are long enough:

    assign   a word such as `password`, a colon or equals sign, and a value of 6 characters or more
    access   AKIA and capitals or digits, 20 characters or more
    hex      24 or more of 0-9a-f

The method adds `random` spans. Candidates are runs of 20 or more of A-Za-z0-9+/_=- with a letter and a
digit. Each is taken for the narrowest encoding its characters allow (hex, base32, base62, base64) and
read as a sequence of that alphabet's places. Three tests ask whether the places could be uniform and
independent: chi-squared of the counts, the number of runs above and below the alphabet's middle, and the
correlation of neighbours. The p-value of a candidate is three times the least of the three.

A candidate that is not random is a discovery, and Benjamini-Hochberg bounds the share of false ones,
that is of random strings taken for ordinary: within each class of length (20 to 31, 32 to 63, ...), as
longer strings are rejected far more surely than short ones. What isn't rejected is a `random` span,
unless a base span covers it.

Only functions that run inside Spark are used. Spans count code points from 0, end exclusive. A null or
empty text has no spans. Repeated rows have spans each; every row counts for the false-discovery bound.
Empty input gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import numbered, saved, text_of

KINDS = ("assign", "access", "hex", "random")
LEVEL = 0.05
#: p-values are told apart in steps of 10 ** -0.01, down to 10 ** -16.
STEPS = 100
LEAST = 16

#: Fixed patterns.
_NAMES = ("password", "passwd", "secret", "token", "api_?key")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
MIN_VALUE = 6

#: Alphabets, with what a string of each looks like; the last fits every candidate.
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+$", _UPPER + "234567"),
    ("^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    ("^[0-9A-Za-z_-]+$", "-" + _DIGITS + _UPPER + "_" + _LOWER),
    ("^[0-9A-Za-z+/]+$", "+/" + _DIGITS + _UPPER + _LOWER),
    ("", "+-/=_" + _DIGITS + _UPPER + _LOWER),
)


def _any_case(pattern: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in pattern)


ASSIGN = (
    "(" + "|".join(_any_case(name) for name in _NAMES) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def _found(text: Column, kind: int, pattern: str, valid: Column | None = None) -> Column:
    """kind, number, gap (length of the text between this match and the last), match, and whether valid."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    good = F.transform(matches, lambda _: F.lit(True)) if valid is None else valid
    rows = F.transform(
        F.arrays_zip(matches.alias("match"), gaps.alias("gap"), good.alias("good")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("number"),
            F.length(x["gap"]).alias("gap"),
            x["match"].alias("match"),
            x["good"].alias("good"),
        ),
    )
    # The text after the last match is no match.
    rows = F.filter(rows, lambda x: x["match"].isNotNull())
    return F.when(text.rlike(pattern), rows)


def _places(text: Column) -> DataFrame:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    long_enough = F.transform(values, lambda v: F.length(v) >= MIN_VALUE)
    ordinary = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    mixed = F.transform(ordinary, lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]"))
    kinds = [
        _found(text, 0, ASSIGN, long_enough),
        _found(text, 1, ACCESS),
        _found(text, 2, HEX),
        _found(text, 3, CANDIDATE, mixed),
    ]
    return F.flatten(F.array_compact(F.array(*kinds)))


def _upper_tail(z: Column) -> Column:
    """Chance that a standard normal value is above z, by a logistic approximation."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def p_value(token: Column) -> Column:
    """Three times the least p-value of the three tests that the token is random, 1 at most."""
    body = F.regexp_replace(token, "=+$", "")
    alphabet, size = F.lit(ENCODINGS[-1][1]), F.lit(float(len(ENCODINGS[-1][1])))
    for pattern, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(body.rlike(pattern), F.lit(letters)).otherwise(alphabet)
        size = F.when(body.rlike(pattern), F.lit(float(len(letters)))).otherwise(size)
    n = F.length(body).cast("double")
    places = F.transform(F.split(body, ""), lambda c: F.instr(alphabet, c).cast("double"))
    places = F.filter(places, lambda v: v > 0)

    counts = F.transform(F.split(alphabet, ""), lambda c: n - F.length(F.replace(body, c)))
    squares = F.aggregate(counts, F.lit(0.0), lambda total, c: total + c * c)
    degrees = size - 1
    chi = (squares * size / n - n) / degrees
    third = 2 / (9 * degrees)
    uneven = _upper_tail((F.pow(F.greatest(chi, F.lit(0.0)), F.lit(1 / 3)) - 1 + third) / F.sqrt(third))

    high = F.transform(places, lambda v: (v > size / 2).cast("double"))
    changes = F.aggregate(
        F.zip_with(high, F.slice(high, 2, F.size(high)), lambda a, b: (a != b).cast("double")),
        F.lit(0.0),
        lambda total, x: total + F.coalesce(x, F.lit(0.0)),
    )
    # Neighbours differ with chance 1/2 if the symbols are uniform.
    runs = 2 * _upper_tail(F.abs(changes - (n - 1) / 2) / F.sqrt((n - 1) / 4))

    centred = F.transform(places, lambda v: v - (size + 1) / 2)
    product = F.aggregate(
        F.zip_with(centred, F.slice(centred, 2, F.size(centred)), lambda a, b: a * b),
        F.lit(0.0),
        lambda total, x: total + F.coalesce(x, F.lit(0.0)),
    )
    spread = (size * size - 1) / 12  # of a uniform place
    serial = 2 * _upper_tail(F.abs(product) / (spread * F.sqrt(n - 1)))
    return F.least(F.lit(1.0), 3 * F.least(uneven, runs, serial))


def not_rejected(candidates: DataFrame, level: float = LEVEL) -> DataFrame:
    """The most significant step that is kept, for each class of length: p-values up to it are rejected.

    candidates: length_class and step. At most a few dozen rows.
    """
    counts = candidates.groupBy("length_class", "step").agg(F.count(F.lit(1)).alias("n"))
    stronger = Window.partitionBy("length_class").orderBy(F.desc("step"))
    whole = Window.partitionBy("length_class")
    ranked = counts.select(
        "length_class",
        "step",
        (F.pow(F.lit(10.0), -F.col("step") / STEPS)).alias("p"),
        F.sum("n").over(stronger).alias("rank"),
        F.sum("n").over(whole).alias("tests"),
    )
    return ranked.filter(F.col("p") <= F.lit(level) * F.col("rank") / F.col("tests")).groupBy(
        F.col("length_class").alias("class_")
    ).agg(F.min("step").alias("rejected_from"))


def scan(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """row, doc_id and spans (start, end, kind as a number of KINDS) of every document, in order."""
    rows = numbered(docs, docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    each = rows.select("row", "doc_id", F.explode_outer(_places(F.col("text"))).alias("x")).select(
        "row", "doc_id", "x.*"
    )
    in_order = Window.partitionBy("row", "kind").orderBy("number")
    width = F.length("match")
    tested = (F.col("kind") == 3) & F.col("good")
    p = F.when(tested, p_value(F.col("match")))
    step = F.floor(-F.log10(F.greatest(p, F.lit(10.0**-LEAST))) * STEPS)
    placed = saved(
        each.select(
            "row", "doc_id", "kind", "number", "gap", "good", width.alias("width"),
            step.alias("step"), F.floor(F.log2(width.cast("double"))).alias("length_class"),
        ),
        "spans",
    )
    # The sum runs over all matches, those that are too short included.
    placed = placed.withColumn("end", F.sum(F.col("gap") + F.col("width")).over(in_order))
    limits = F.broadcast(not_rejected(placed.filter("step IS NOT NULL").select("length_class", "step"), level))
    judged = placed.join(limits, F.col("length_class") == F.col("class_"), "left")
    random = F.col("rejected_from").isNull() | (F.col("step") < F.col("rejected_from"))
    span = F.struct((F.col("end") - F.col("width")).alias("start"), F.col("kind"), F.col("end"))
    kept = F.when(F.col("good") & ((F.col("kind") < 3) | random), span)
    spans = judged.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(kept)).alias("spans")
    )
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return spans.withColumn(
        "spans",
        F.filter(
            "spans",
            lambda s: (s["kind"] < 3)
            | ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])),
        ),
    )


def count_of(spans: Column | str, kind: str) -> Column:
    """How many spans are of a kind."""
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )
