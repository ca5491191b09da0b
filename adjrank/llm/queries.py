"""One query per operator over the whole of its table, and the pipeline."""

from __future__ import annotations

import os

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjrank.llm import (
    alignment, bpe, hmm, mixing, ngram_join, packing, quality, spotsigs, sql, suffix_dedup, toxicity, url_rules, warc, whitening,
)
from adjrank.session import scratch_path

#: Fixed by the contract.
URL_RULES = [
    url_rules.Rule("org", "/", "allow"),
    url_rules.Rule("example.org", "/es/", "block"),
    url_rules.Rule("example.org", "/en/1", "block"),
    url_rules.Rule("com", "/fr/", "allow"),
    url_rules.Rule("com", "/de/", "block"),
]
TOKEN_LIMIT = 1024
END_ID = 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_spotsigs(spark, sf_dir):
    return spotsigs.edited_fingerprints(_documents(spark, sf_dir))


def op2_url_rules(spark, sf_dir):
    return url_rules.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_warc_revisits(spark, sf_dir):
    path = scratch_path(spark, "warc")
    warc.archive(_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        F.col("type").alias("record_type"),
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def op4_ngram_join(spark, sf_dir):
    return ngram_join.components(_documents(spark, sf_dir))


def op5_source_mix(spark, sf_dir):
    return mixing.Mix(_documents(spark, sf_dir)).taken().withColumnRenamed("key", "doc_id")


def op6_best_fit_packing(spark, sf_dir):
    return packing.packed(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), END_ID)


def op7_hidden_markov(spark, sf_dir):
    return hmm.score(_documents(spark, sf_dir))


def op8_quality_rules(spark, sf_dir):
    return quality.quality(_documents(spark, sf_dir))


def op9_token_counts(spark, sf_dir):
    return bpe.token_counts(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), limit=TOKEN_LIMIT)


def op10_toxicity(spark, sf_dir):
    return toxicity.score(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op11_alignment(spark, sf_dir):
    return alignment.link_counts(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_whitening(spark, sf_dir):
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(suffix_dedup.without_repeats(_documents(spark, sf_dir)))


def queries():
    each = [
        op1_spotsigs, op2_url_rules, op3_warc_revisits, op4_ngram_join, op5_source_mix,
        op6_best_fit_packing, op7_hidden_markov, op8_quality_rules, op9_token_counts, op10_toxicity,
        op11_alignment, op12_whitening, op13_suffix_dedup,
    ]
    return {query.__name__: query for query in each}


def oracle_sql():
    return sql.statements()
