"""The corpus pipeline: documents to packed sequences in five stages.

Each stage takes the documents that the one before kept, and all but the last
return documents with all their columns. Null texts are empty; an empty table
stays empty through all stages.
"""

from __future__ import annotations

import posixpath

from adjrank.llm import mixing, ngram_join, packing, quality, toxicity
from adjrank.llm.queries import END_ID, tokenizer_path
from adjrank.session import scratch_path


def _table(spark, sf_dir, name):
    return spark.read.parquet(posixpath.join(sf_dir, f"{name}.parquet"))


def reject_toxic(spark, docs, sf_dir):
    """Documents that the network, learned from the labelled documents, does not find toxic."""
    return toxicity.clean(docs, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def reject_low_quality(spark, docs, sf_dir):
    """Documents that pass the quality rules, without their failing lines."""
    return quality.clean(docs)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near copies, that with the smallest id, and all others."""
    return ngram_join.representatives(docs, like=ngram_join.Likeness(under=80, over=100, words=5))


def mix_sources(spark, docs, sf_dir):
    """The mix of the sources at their target weights."""
    return mixing.Mix(docs).documents(docs)


def pack_sequences(spark, docs, sf_dir):
    """Pieces of at most 4096 tokens with their place in a sequence."""
    return packing.packed(docs, tokenizer_path("word_bpe_49k.json"), END_ID)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality rules", reject_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("source mix", mix_sources),
    ("best-fit packing", pack_sequences),
]
#: The stages' models and tokenizer are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents, each written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
