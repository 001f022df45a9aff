"""Queries opN_<name> over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import audio, collocations, jaccard, language, lines, mixing, packing, quality, rules, simhash, substrings, tries, warc
from skyloom.llm.common import bucket, table


def tokenizer() -> str:
    """Where the public vocabulary file is installed."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = language.identify(docs, language.train(language.learnable(docs)))
    return named.select("doc_id", (bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_id.lang_pred", "lang_id.score")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_features(table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table of all rebuilt conversations."""
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its number of shingles and its group of similar ones."""
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_language_id": op2_language_id,
    "op3_warc": op3_warc,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_telephony_audio": op5_telephony_audio,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_source_mix": op8_source_mix,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
}

ORACLES: dict[str, str] = {
    "op3_warc": warc.ORACLE_SQL,
    "op4_substring_dedup": substrings.ORACLE_SQL,
    "op7_quality_rules": rules.ORACLE_SQL,
    "op10_line_dedup": lines.ORACLE_SQL,
    "op11_conversation_trie": tries.ORACLE_SQL,
    "op12_phrase_collocations": collocations.ORACLE_SQL,
    "op13_ngram_jaccard_join": jaccard.ORACLE_SQL,
}
