"""The registered queries of the text operators, and SQL where it can say the same."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from visorlake.llm import decontaminate, exact_dedup, html, packing, prefix_trie, simhash, substring, suffix, token_counts, top_k, toxicity, warc, whitening
from visorlake.llm.common import table
from visorlake.session import ship


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.remove_repeated_windows(table(spark, folder, "documents")).drop("kept")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs, files = table(spark, folder, "documents"), (vocabulary(), vocabulary("byte_bpe_50k.tiktoken"))
    edited = token_counts.apply_edits(token_counts.count_tokens(docs, *files), token_counts.sample_edits(docs), *files)
    return edited.select("doc_id", "n_tokens_before", "n_tokens", "n_edits", "chars_encoded", F.sha2("text", 256).alias("text_sha256"))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.remove_repeated_bytes(table(spark, folder, "documents")).drop("spans", "kept")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


def op7_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    return warc.revisit_table(table(spark, folder, "pages"))


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("copy_key")


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary(), vocabulary("byte_bpe_50k.tiktoken"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"))


def op13_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k.exact_top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def _shipped(fn):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return fn(spark, folder)
    return run


OPERATORS = (op1_html_extraction, op2_substring_dedup, op3_token_counts, op4_suffix_dedup, op5_toxicity, op6_exact_dedup, op7_warc_revisits,
             op8_decontaminate, op9_packing, op10_simhash, op11_whitening, op12_prefix_trie, op13_top_k)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _shipped(f) for f in OPERATORS}


def checks() -> dict[str, str]:
    return {"op2_substring_dedup": substring.WINDOW_SQL, "op6_exact_dedup": exact_dedup.EXACT_SQL, "op7_warc_revisits": warc.REVISIT_SQL,
            "op12_prefix_trie": prefix_trie.TRIE_SQL, "op13_top_k": top_k.TOP_SQL}
