"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers

from patchloom.llm import bpe, decontaminate, exact_topk, fill_in_middle, line_dedup, merkle, quality, sharding, simhash, substring_dedup, toxicity, url_reputation, warc


def _table(name):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, pages, labels, benchmark, embeddings = map(_table, ("documents", "pages", "labels", "benchmark", "embeddings"))


def op1_bpe(spark, sf_dir):
    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), ("ids_sha256", "decoded_sha256"))


def op2_warc(spark, sf_dir):
    return warc.archive_round_trip(pages(spark, sf_dir))


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_quality(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_decontaminate(spark, sf_dir):
    return decontaminate.matches(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op6_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(documents(spark, sf_dir), digests=True)


def op7_line_dedup(spark, sf_dir):
    return line_dedup.line_digests(documents(spark, sf_dir))


def op8_toxicity(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_exact_topk(spark, sf_dir):
    return exact_topk.exact_topk(embeddings(spark, sf_dir))


def op10_url_reputation(spark, sf_dir):
    return url_reputation.url_filter(pages(spark, sf_dir))


def op11_fill_in_middle(spark, sf_dir):
    return fill_in_middle.fill_in_middle(documents(spark, sf_dir), ("output_sha256", "restored_sha256"))


def op12_sharding(spark, sf_dir):
    return sharding.shard_slots(documents(spark, sf_dir))


def op13_merkle(spark, sf_dir):
    return merkle.document_manifest(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_warc, op3_simhash, op4_quality, op5_decontaminate, op6_substring_dedup, op7_line_dedup, op8_toxicity, op9_exact_topk, op10_url_reputation, op11_fill_in_middle, op12_sharding, op13_merkle)}

ORACLE_SQL = {"op2_warc": warc.oracle(), "op5_decontaminate": decontaminate.oracle(), "op6_substring_dedup": substring_dedup.oracle(), "op7_line_dedup": line_dedup.oracle(), "op9_exact_topk": exact_topk.oracle(), "op10_url_reputation": url_reputation.oracle(), "op11_fill_in_middle": fill_in_middle.oracle(), "op12_sharding": sharding.oracle(), "op13_merkle": merkle.oracle()}
