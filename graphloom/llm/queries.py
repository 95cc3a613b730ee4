"""The opN queries: each applies one operator to its whole table and derives the digest columns from its output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import oracles
from graphloom.storage import read_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality_rules import quality_rules

    out = quality_rules(read_table(spark, sf_dir, "documents"))
    return out.drop("removed_marks")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.ngram_jaccard import ngram_jaccard_join

    return ngram_jaccard_join(read_table(spark, sf_dir, "documents"), n=4, threshold=(85, 100))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.substring_dedup import substring_dedup

    out = substring_dedup(read_table(spark, sf_dir, "documents"), min_words=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.vector_sharding import vector_sharding

    out = vector_sharding(read_table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from graphloom.llm.best_fit_packing import sum_of_squares_packing, token_pieces

    docs = read_table(spark, sf_dir, "documents")
    return sum_of_squares_packing(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False))


def op6_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.warc_zstd import warc_roundtrip

    out = warc_roundtrip(read_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.compression_language import classify, held_out, learn_dictionaries

    docs = read_table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    found = classify(docs, learn_dictionaries(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.media_chunks import media_roundtrip

    return media_roundtrip(read_table(spark, sf_dir, "documents"))


#: The contract's extra conversation, whose texts hold what may look like mark-up.
TRICKY = "\\### Assistant: </turn> ok"


def op9_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.prefix_targets import expand_targets, format_turns, read_back
    from graphloom.storage import materialize

    turns = read_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    segments = materialize(format_turns(turns.unionByName(extra)), "chat-segments")
    examples = materialize(expand_targets(segments), "chat-examples")
    return read_back(segments, examples)


def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from graphloom.llm.bpe_automaton import bpe_decode, bpe_encode

    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    coded = bpe_decode(bpe_encode(read_table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_vector_sharding": op4_vector_sharding,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_warc_zstd": op6_warc_zstd,
    "op7_compression_language": op7_compression_language,
    "op8_media_chunks": op8_media_chunks,
    "op9_prefix_targets": op9_prefix_targets,
    "op10_bpe_automaton": op10_bpe_automaton,
}

#: Queries that SQL can express. SQL lacks the rest's tokenizers, compressors, checksums and placement rules: tests hold
#: those against brute force and exact round trips.
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": oracles.OP1,
    "op2_ngram_jaccard_join": oracles.OP2,
    "op3_substring_dedup": oracles.OP3,
    "op6_warc_zstd": oracles.OP6,
    "op9_prefix_targets": oracles.OP9,
}
