"""Texts of an exact number of tokens, and pools of codes and ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.generators import uniform

#: Words that are one token behind any word in common vocabularies; which of them are, is tried before use.
PAD_WORDS = (" the", " of", " and", " in", " to", " that", " with", " for")


def id_pool(spark: SparkSession, size: int) -> DataFrame:
    """(id, name): NODE-00000 and so on."""
    return spark.range(size).select("id", F.format_string("NODE-%05d", "id").alias("name"))


def code_candidates(spark: SparkSession, tries: int, seed: str, template: str = "LLDLL") -> DataFrame:
    """(code, try): different codes of a letter for L and a digit for D, each at its first try. Equal lengths and an inner digit keep a
    code out of other codes and of prose."""

    def symbol(i: int, kind: str) -> Column:
        first, many = (65, 26) if kind == "L" else (48, 10)
        return F.chr((F.lit(first) + F.floor(uniform(seed, F.col("id"), i) * many)).cast("long"))

    made = spark.range(tries).select(F.concat(*(symbol(i, kind) for i, kind in enumerate(template))).alias("code"), F.col("id"))
    return made.groupBy("code").agg(F.min("id").alias("try"))


def token_counts(texts: DataFrame, column: str, tokenizer_path: str) -> DataFrame:
    """Add n_tokens, by a tokenizers file that executors can read."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def count(values):
        import pandas as pd

        coder = load_tokenizer(tokenizer_path)
        return pd.Series([len(x.ids) for x in coder.encode_batch(values.fillna("").tolist(), add_special_tokens=False)])

    return texts.withColumn("n_tokens", count(F.col(column)))


def code_pool(spark: SparkSession, size: int, tokens: int, tokenizer_path: str, seed: str, tries: int | None = None) -> DataFrame:
    """(code, try) of the first size codes that are exactly tokens tokens behind a space; too few among the tries are an error."""
    every = code_candidates(spark, tries or 50 * size, seed).withColumn("spaced", F.concat(F.lit(" "), F.col("code")))
    pool = token_counts(every, "spaced", tokenizer_path).where(F.col("n_tokens") == tokens).orderBy("try").limit(size).select("code", "try")
    found = pool.count()
    if found < size:
        raise ValueError(f"{found} of {size} codes have {tokens} tokens")
    return pool


_tokenizers: dict = {}


def load_tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


class FitError(ValueError):
    """No text of the wanted length was found."""


def fit_text(encode: Callable[[str], list[int]], decode: Callable[[list[int]], str], filler: list[int], needle: str, offset: int, size: int, rounds: int = 64) -> str:
    """A text of exactly size tokens that holds needle: offset tokens of filler before it, filler behind.

    Joining decoded pieces may change how they are tokenised, so the length is measured on the text. Filler behind the needle
    is given up first, then filler before it, until the text fits; single-token words then fill it up. The needle stays whole.
    """
    room = size - len(encode(needle))
    if room < 0:
        raise FitError("the needle is longer than the text may be")
    before = min(max(offset, 0), room)
    behind = room - before

    def joined() -> str:
        parts = (decode(filler[:before]), needle, decode(filler[before : before + behind]))
        return " ".join(p for p in parts if p).strip()

    text = joined()
    while (over := len(encode(text)) - size) > 0:
        if not before + behind:
            raise FitError("the needle alone is too long")
        cut = min(over, behind)
        behind, before = behind - cut, max(0, before - (over - cut))
        text = joined()
    base = len(encode("word"))
    pads = [w for w in PAD_WORDS if len(encode("word" + w)) == base + 1]
    for turn in range(rounds):
        short = size - len(encode(text))
        if not short:
            return text
        if not pads:
            break
        # all that is missing at once; one word at a time where such a run merges
        more = "".join(pads[(turn + k) % len(pads)] for k in range(short if turn < 2 else 1))
        if len(encode(text + more)) <= size:
            text += more
    raise FitError(f"{len(encode(text))} of {size} tokens")


def fit_texts(rows: DataFrame, tokenizer_path: str, size: int) -> DataFrame:
    """Add fitted: for each row (filler text, needle, offset) a text of exactly size tokens. Null filler is empty; a needle that is null or
    too long gives null. Other columns stay."""

    def fit(row: dict) -> dict:
        coder = load_tokenizer(tokenizer_path)
        encode = lambda t: coder.encode(t, add_special_tokens=False).ids
        if row["needle"] is None:
            return row | {"fitted": None}
        try:
            # size tokens are at most so many characters of any vocabulary worth the name
            filler = encode((row["filler"] or "")[: 64 * size])
            return row | {"fitted": fit_text(encode, lambda ids: coder.decode(ids, skip_special_tokens=False), filler, row["needle"], row["offset"] or 0, size)}
        except FitError:
            return row | {"fitted": None}

    from graphloom.operators.hooks import map_rows

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "fitted")
    return map_rows(rows, fit, f"{fields}, fitted string")
