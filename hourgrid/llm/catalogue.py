"""The registered queries of the operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from hourgrid.llm import (
    bpe,
    filter_audit,
    fingerprint,
    langid,
    line_dedup,
    near_dup,
    prefix_trie,
    simhash,
    tiling,
    token_counts,
    token_files,
    toxicity,
    twins,
    url_reputation,
)
from hourgrid.llm.common import remainder, vocabulary_path
from hourgrid.llm.url_reputation import Rule
from hourgrid.sources.scratch import scratch_path

RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]
TOKEN_LIMIT = 1024
END_ID = 2


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _page_outcomes(spark: SparkSession, sf: str, pages: DataFrame) -> DataFrame:
    """A page is bad if the document that its url ends in is labelled toxic or of low quality."""
    number = F.regexp_extract("url", r"/([0-9]{1,18})(\.html|/)?([?#].*)?$", 1)
    judged = pages.select(
        url_reputation.host_of(F.col("url")).alias("host"), F.when(number != "", number).cast("long").alias("doc_id")
    )
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    labels = table(spark, sf, "labels").select("doc_id", bad.cast("int").alias("bad"))
    return judged.where("host <> ''").join(labels, "doc_id").select("host", "bad")


def op1_url_reputation(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts without labelled pages are judged by their domain, else their suffix, else all labelled pages."""
    pages = table(spark, sf, "pages")
    hosts = pages.select(url_reputation.host_of(F.col("url")).alias("host"))
    known = url_reputation.host_reputation(_page_outcomes(spark, sf, pages), hosts=hosts)
    return url_reputation.judge_urls(pages, RULES, known)


def op1_url_reputation_all_hosts(spark: SparkSession, sf: str) -> DataFrame:
    """An earlier name of the same rule."""
    return op1_url_reputation(spark, sf)


def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.add_token_counts(table(spark, sf, "documents"), vocabulary_path("byte_bpe_50k.json"), TOKEN_LIMIT)


def op3_multiset_hash(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf, "documents"))


def op4_rans_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf, "documents"), path, vocabulary_path("word_bpe_49k.json"), END_ID)
    return token_files.read_token_files(spark, path)


def op5_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    ranks = vocabulary_path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN, remembered=1_200_000).drop("ids")


def op6_string_tiling(spark: SparkSession, sf: str) -> DataFrame:
    found = tiling.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.drop("doc_key")


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, toxicity.labels_to_learn(table(spark, sf, "labels")))
    return toxicity.score_documents(docs, model).withColumn("held_out", F.coalesce(remainder() == 2, F.lit(False)))


def op8_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf, "documents")).drop("text_key")


def op9_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    filters = langid.learn(docs.where(remainder() != 2))
    return langid.identify(docs, filters).withColumn("held_out", F.coalesce(remainder() == 2, F.lit(False)))


def op10_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.duplicate_lines(table(spark, sf, "documents")).select("doc_id", "line_no", "first_doc_id", "first_line_no", "edits")


def op11_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_path(spark, "filter-audit")
    return filter_audit.audit_filters(spark, f"{sf}/documents.parquet", table(spark, sf, "labels"), folder)


def op12_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.simhash_duplicates(table(spark, sf, "documents"))


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf, "conversations"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_reputation,
        op1_url_reputation_all_hosts,
        op2_token_counts,
        op3_multiset_hash,
        op4_rans_files,
        op5_byte_bpe,
        op6_string_tiling,
        op7_toxicity,
        op8_near_duplicates,
        op9_language,
        op10_line_dedup,
        op11_filter_audit,
        op12_simhash,
        op13_prefix_trie,
        pipeline,
    )
}
ORACLES: dict[str, str] = {
    "op1_url_reputation": twins.URL_REPUTATION,
    "op1_url_reputation_all_hosts": twins.URL_REPUTATION,
    "op8_near_duplicates": twins.NEAR_DUPLICATES,
    "op10_line_dedup": twins.LINE_DEDUP,
    "op11_filter_audit": twins.FILTER_AUDIT,
    "op13_prefix_trie": twins.PREFIX_TRIE,
}
