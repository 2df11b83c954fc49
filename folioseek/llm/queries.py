"""The operators of this folder as registered queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioseek.llm import alignment, chat, decontamination, hosts, language, licenses, mixing, near_duplicates, prefix_trie, quality, scoring, simhash, surrogates
from folioseek.llm.common import crc_rest, table
from folioseek.sources.scratch import written

# The key of the test run; a production run passes a secret of its own.
SURROGATE_KEY = "test run"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85).drop("n_links")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judged(documents).select("doc_id", *measures)


def op3_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents")).drop("spans")


def op4_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.expanded(turns.unionByName(chat.extra_conversation(turns))))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sizes = written(mixing.sized(documents, mixing.distinct_share).drop("text"), "sizes")
    return mixing.taken(sizes, mixing.plan(sizes))


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = decontamination.parted(table(spark, sf_dir, "benchmark"))
    found = decontamination.searched(table(spark, sf_dir, "documents"), items, keep=["doc_id"])
    return found.select("doc_id", F.inline("leaks"))


def op7_trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_rest(F.col("doc_id"), 7) == 2, F.lit(False))
    documents = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text")
    return scoring.scored(documents, scoring.trained(documents.where("not held_out"), min_count=1))


def op8_host_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judged(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replaced(documents, SURROGATE_KEY)


def op10_compressed_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_rest(F.col("doc_id"), 4) == 2
    samples = language.dictionaries(documents.where(~F.coalesce(held_out, F.lit(False))))
    letters = language.letters(F.col("text")).alias(language.LETTERS)
    rows = documents.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), letters)
    return language.classify(rows, samples).withColumn("accepted", language.accepted())


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("n_links")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(prefix_trie.numbered(table(spark, sf_dir, "conversations")), "numbered")
    conversations, rebuilt = prefix_trie.rebuilt(turns)
    return prefix_trie.prefix_trie(conversations, rebuilt)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_license_automaton": op3_license_automaton,
    "op4_chat_prefix_targets": op4_chat_prefix_targets,
    "op5_mix_sources": op5_mix_sources,
    "op6_benchmark_leaks": op6_benchmark_leaks,
    "op7_trie_scores": op7_trie_scores,
    "op8_host_graph": op8_host_graph,
    "op9_surrogates": op9_surrogates,
    "op10_compressed_language": op10_compressed_language,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_token_alignment": op13_token_alignment,
}
