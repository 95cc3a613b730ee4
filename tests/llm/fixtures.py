"""A small corpus with copies, near copies, shared passages, empty and null texts, and rows that share an id."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(70))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(1, 160))]
        if i % 5 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        if i % 4 == 1 and rows:
            words = (rows[-1][1] or "x").split()
            if i % 8 == 1:
                words[rng.randrange(len(words))] = "edit"
        text = " ".join(words)
        if i % 6 == 2:
            text = text.replace(" ", "\n", 3) + "\t\tend  "
        rows.append((i, text, ("en", "de")[i % 2], f"src{i % 3}", len(text)))
    rows += [(n, None, "en", "src0", None), (n + 1, "", None, None, 0), (n + 2, " \n\t", "de", "src1", 3), (n + 3, "One Two three", "en", "src0", 13), (n + 4, "one two THREE", "en", "src0", 13)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)


def with_clashes(df):
    """The same rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ("words", "lines", "kind", "bucket", "payload", "row", "k1", "component_id", "shard", "sequence_id", "ids", "content", "host", "marks")
    return df.withColumns({n: F.lit("clash") for n in names})
