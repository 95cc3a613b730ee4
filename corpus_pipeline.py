"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared folder as Parquet and
rereads as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.best_fit_packing import sum_of_squares_packing, token_pieces
from graphloom.llm.compression_language import keep_identified, learn_dictionaries
from graphloom.llm.id_bits import flag_listed
from graphloom.llm.ngram_jaccard import ngram_jaccard_join
from graphloom.llm.quality_rules import quality_filter
from graphloom.llm.substring_dedup import substring_dedup
from graphloom.storage import bound_batches, free_name, materialize, read_table, with_row_id


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression cannot tell, or that have no letter, go.

    Null and empty texts go. Each row is judged by its own text, so null and repeated ids, repeated rows and ties of any
    kind change nothing. Extra columns stay, whatever their names. An empty table gives an empty one.
    """
    bound_batches(spark)
    return keep_identified(docs, learn_dictionaries(docs))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines leave the texts; documents that fail the base rules or are depleted go.

    Null and empty texts go. A null source is a host of its own. Rows are judged by text and host, so null and repeated ids
    and repeated rows keep a row each. Extra columns stay, whatever their names; n_chars is the new length. An empty
    table gives an empty one.
    """
    return quality_filter(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, Jaccard 0.8) the document with the smallest id stays.

    Each row is a document of its own: where ids are null or repeat, null ones come last and ties go to the smallest text;
    of wholly equal rows one stays. Null and empty texts are like nothing and stay. Extra columns stay, whatever their
    names. An empty table gives an empty one.
    """
    row = free_name(docs, "row_id")
    rows = with_row_id(docs, row)
    gone = free_name(rows, "gone_row")
    found = ngram_jaccard_join(rows, id_col=row, n=5, threshold=(80, 100)).where("not is_representative")
    drop = materialize(found.select(F.col("doc_id").alias(row)), "pipeline-dropped")
    # only rows that may go are shuffled
    rows = flag_listed(rows, drop, row, gone)
    kept = rows.where(~F.col(gone)).unionByName(rows.where(gone).join(drop, row, "left_anti"))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that occur earlier in the corpus leave the texts; the documents stay.

    Earlier is by id; where ids are null or repeat, null ones come last and ties go by text, and each row has its own cut. A
    text that loses nothing stays as it is, null and empty ones included. Extra columns stay, whatever their names; n_chars
    is the new length where a text changes. An empty table gives an empty one.
    """
    row, kept_row, kept_text = (free_name(docs, n) for n in ("row_id", "kept_row", "kept_text"))
    rows = with_row_id(docs, row)
    cut = substring_dedup(rows, id_col=row, min_words=50).where("n_removed > 0")
    cut = materialize(cut.select(F.col("doc_id").alias(kept_row), F.col("kept_text").alias(kept_text)), "pipeline-cut")
    out = rows.join(cut, F.col(row) == F.col(kept_row), "left")
    changed = F.col(kept_row).isNotNull()
    new = {"text": F.col(kept_text), "n_chars": F.length(kept_text).cast("long")}
    return out.select(*(F.when(changed, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 2048 tokens.

    Null and empty texts are one end token each. Every row is packed, null and repeated ids and repeated rows included. Other
    columns are ignored. An empty table gives an empty result.
    """
    import public_tokenizers

    return sum_of_squares_packing(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither compression nor the order-dependent packing; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
