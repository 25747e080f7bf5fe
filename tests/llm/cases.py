"""Small tables with everything that may go wrong in them."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()


def sentence(seed, n):
    generator = random.Random(seed)
    return " ".join(generator.choice(WORDS) + str(generator.randrange(30)) for _ in range(n))


def rows():
    """Nulls, empty and odd texts, a long one, copies, near copies, rows that repeat."""
    long = sentence(1, 4000)
    base = sentence(2, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        None, "", "   ", "\n\n", "!!!", "one", "a b c d", base, base, " ".join(near), long, long + " tail",
        "é à ü ñ\tmixed\x0bspaces\x0c", "line one is long enough\nshort\nLine One IS long enough  \n",
        "  line one is long enough", base + "\n" + sentence(3, 50), "日本語 テキスト 東京 " * 8, "a" * 30, None, "",
    ]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, i) for i, t in enumerate(texts)]
    return out + [out[7], out[10], (None, base, None, None, None), (None, None, None, None, None)]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def clashing(docs, *names):
    """The table with further columns of names that operators use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({name: F.lit("other") for name in names})


def collected(df, *columns):
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(row) for row in chosen.collect()), key=repr)
