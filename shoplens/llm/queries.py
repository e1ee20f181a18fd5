"""The registered queries of the text operators: each applies its operator,
with production parameters, to its whole table and derives the digest columns
of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, conversation_trie, decontam, langid, pii, quality_cotrain, quality_rules, simhash, spelling, substring_dedup, token_files, toxicity, url_filter, url_filter_sql
from .common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path()))


def bpe_digests(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    removed = F.expr("aggregate(spans, 0L, (a, s) -> a + s.stop - s.first)")
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digests(pii.find(table(spark, sf_dir, "documents")))


def pii_digests(found: DataFrame) -> DataFrame:
    def joined(spans):
        return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.stop)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts,
                        F.sha2(F.expr(joined("filter(spans, s -> s.kind <> 'term')")).cast("binary"), 256).alias("base_sha256"),
                        F.expr(joined("spans")).alias("spans"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cotrain.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    known = url_filter.labels_by_url(pages, table(spark, sf_dir, "labels"))
    return url_filter.judge(pages, known).select("page_id", "host", "path", "rule", "verdict")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), min_letters=5, min_count=3, modulus=97, ratio=2)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"), every=5, modulus=9)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write(table(spark, sf_dir, "documents"), tokenizer_path(), token_files.scratch_folder(spark))
    return token_files.read(spark, folder).select(
        "doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_near_dedup, op2_toxicity, op3_quality_rules, op4_bpe_encode_decode,
                             op5_substring_dedup, op6_pii, op7_language_id, op8_benchmark_decontamination,
                             op9_quality_classifier, op10_url_filter, op11_spelling_variants, op12_conversation_trie, op13_token_files)
}

ORACLE_SQL: dict[str, str] = {"op10_url_filter": url_filter_sql.oracle()}
