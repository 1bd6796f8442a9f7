"""The training-data pipeline: five stages over ``documents``, each written and read again as Parquet.

Defined cases: a null text is an empty one for every stage; it is never toxic, has no line and no item, and all empty texts
are one class, of which the smallest doc_id stays (null last). Rows that share a doc_id are judged by their own texts and
the last stage gives each its row; of equal rows one stays. Of several rows of a class the order is doc_id, text hash, then a
hash of the other columns. Extra columns, also those named like an operator's own, keep their values up to the last stage,
which returns doc_id, n_tokens, ids and decoded_sha256. An empty table gives an empty result; without labels nothing is toxic.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from patchloom.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from patchloom.storage import materialize


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark, docs, sf_dir):
    """Documents whose toxicity score reaches 0.5 go."""
    return toxicity.keep_clean(docs, _table(spark, sf_dir, "labels"))


def cut_lines(spark, docs, sf_dir):
    """Lines that an earlier line resembles (Jaccard 0.8) are cut from the text; n_chars follows."""
    return line_dedup.line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each(spark, docs, sf_dir):
    """One document of each SimHash class stays."""
    return simhash.one_per_class(docs)


def drop_leaks(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_uncontaminated(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark, docs, sf_dir):
    """Token ids of what is left, with the digest of the decoded text."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), ("ids", "decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line dedup", cut_lines), ("simhash", one_of_each), ("decontamination", drop_leaks), ("bpe", encode)]

#: SimHash classes and models are beyond SQL; tests/llm/test_pipeline.py compares with a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
