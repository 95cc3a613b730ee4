"""Quality rules with cross-document line frequency, in DataFrame operations only.

Lines are normalised and hashed. For each host the documents that hold a line are counted; lines above the limit are
boilerplate and go, and a document that loses most of its text with them is rejected. The base rules of single documents
(length, repetition) come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.storage import free_name, materialize

SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def normalised(line: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def _text_measures(docs: DataFrame) -> DataFrame:
    """Per row: counts of words, their code points, symbols, repeated lines and words in repeated 3-word windows."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.withColumns({"words": words_of(F.col("text")), "lines": lines})
    docs = docs.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.regexp_replace("text", SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "grams": F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>")),
        "marks": F.transform("lines", lambda x: F.struct(F.xxhash64(normalised(x)).alias("mark"), F.length(x).alias("chars"))),
    }).drop("words", "lines")
    # equal windows meet when (hash, position) is sorted
    docs = docs.withColumn("ranked", F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))

    def same(x: Column, k: Column) -> Column:
        return F.coalesce(x["h"] == F.get("ranked", k)["h"], F.lit(False))

    twice = F.transform("ranked", lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]).otherwise(F.lit(-1)))
    docs = docs.withColumn("starts", F.sort_array(F.filter(twice, lambda x: x >= 0)))
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("covered"))
    covered = F.aggregate("starts", zero, lambda acc, x: F.struct(x.alias("last"), (acc["covered"] + F.least(F.lit(3), x - acc["last"])).alias("covered")), lambda acc: acc["covered"])
    return docs.withColumn("n_repeat_words", covered.cast("long")).drop("grams", "ranked", "starts")


def _verdicts(measured: DataFrame, min_words: int, max_repeat_percent: int, min_docs: int, max_share: float, max_depletion: float) -> DataFrame:
    """Rows of _measured() with base_failed, kept, line_chars, removed_chars and removed_marks."""
    measured = materialize(measured, "quality-measures")
    firsts = measured.groupBy("host", "content").agg(F.min("row").alias("row"))
    hosts = firsts.groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    lines = measured.select("host", "row", F.explode(F.array_distinct("marks.mark")).alias("mark"))
    counts = lines.join(firsts.select("row"), "row", "left_semi").groupBy("host", "mark").agg(F.count(F.lit(1)).alias("holders")).where(F.col("holders") > min_docs)
    frequent = counts.join(hosts, "host").where(F.col("holders") > F.greatest(F.lit(min_docs).cast("double"), F.col("texts") * max_share)).select("host", "mark")
    frequent = materialize(frequent, "quality-lines")
    marks = measured.select("host", "row", F.explode("marks").alias("m")).select("host", "row", "m.mark", "m.chars")
    gone = marks.join(frequent, ["host", "mark"]).groupBy("row").agg(F.sum("chars").alias("removed_chars"), F.collect_set("mark").alias("removed_marks"))
    out = measured.join(gone, "row", "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    line_chars = F.aggregate("marks", F.lit(0).cast("long"), lambda acc, m: acc + m["chars"])
    out = out.withColumns({"base_failed": failed, "line_chars": line_chars, "removed_chars": F.coalesce("removed_chars", F.lit(0)).cast("long"), "removed_marks": F.coalesce("removed_marks", F.array().cast("array<bigint>"))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("removed_chars") <= F.col("line_chars") * max_depletion))


def _host(host_col: str) -> Column:
    return F.coalesce(F.xxhash64(F.col(host_col).cast("string")), F.lit(0))


def _measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), _host(host_col).alias("host"))
    return _text_measures(base).withColumns({"row": F.monotonically_increasing_id(), "content": F.xxhash64("text")}).drop("text")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 50, max_repeat_percent: int = 50, min_docs: int = 20, max_share: float = 0.05, max_depletion: float = 0.5) -> DataFrame:
    """Verdict for every row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    line_chars, removed_chars and removed_marks (hashes of the lines that go).

    base_failed: fewer than min_words words, or more than max_repeat_percent % of words in 3-word windows that come twice
    or more. A line goes when more different texts of its host hold it than max(min_docs, max_share of the host's different
    texts); exact copies count once, so that copies alone never make a line boilerplate. A row is kept unless base_failed
    or more than max_depletion of the characters of its lines go.

    Null and empty texts have no words and fail the base rules. A null host is a host of its own. Null and repeated ids
    are kept as they are, one row each. Other columns are ignored. An empty table gives an empty result.
    """
    out = _verdicts(_measured(docs, id_col, text_col, host_col), min_words, max_repeat_percent, min_docs, max_share, max_depletion)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", "removed_chars", "removed_marks")


def without_lines(text: Column, removed_marks: Column) -> Column:
    """The text without the lines whose hashes are listed; unchanged where none is."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(removed_marks, F.xxhash64(normalised(x))))
    return F.when(F.size(removed_marks) > 0, F.array_join(kept, "\n")).otherwise(text)


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """docs, all columns as they are but for texts, which lose their boilerplate lines, without the rows that
    quality_rules() rejects. A verdict depends on text and host alone; rows find theirs by id, text and host. Null and repeated
    ids keep a row each; extra columns stay, whatever their names; an empty table gives an empty one."""
    limits = {"min_words": 50, "max_repeat_percent": 50, "min_docs": 20, "max_share": 0.05, "max_depletion": 0.5} | limits
    found = _verdicts(_measured(docs, id_col, text_col, host_col), **limits).where("kept")
    names = [free_name(docs, n) for n in ("key_id", "key_content", "key_host", "key_marks")]
    found = found.select(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), "content", "host", "removed_marks").toDF(*names).dropDuplicates(names[:3])
    keys = (F.coalesce(F.xxhash64(id_col), F.lit(0)), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), _host(host_col))
    out = docs.withColumns(dict(zip(names, keys, strict=False))).join(found, names[:3])
    return out.withColumn(text_col, without_lines(F.col(text_col), F.col(names[3]))).select(*docs.columns)
