"""The registered queries of the corpus operators, and SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers

from sigloom.llm import (
    decontaminate,
    hard_negatives,
    html_extract,
    language_id,
    license_scan,
    ngram_join,
    periodic_runs,
    quality_rules,
    sentencepiece_bpe,
    sharding,
    suffix_dedup,
    token_output,
    toxicity,
)
from sigloom.llm.common import table

QUERIES = {}
ORACLES = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(quality_rules.ORACLE)
def op3_quality_rules(spark, sf_dir):
    return quality_rules.report(table(spark, sf_dir, "documents"))


@query()
def op10_language_id(spark, sf_dir):
    return language_id.report(table(spark, sf_dir, "documents"))


@query()
def op2_sentencepiece(spark, sf_dir):
    return sentencepiece_bpe.digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


@query(decontaminate.ORACLE)
def op9_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op5_ngram_join(spark, sf_dir):
    return ngram_join.report(table(spark, sf_dir, "documents"))


@query()
def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


@query()
def op4_toxicity(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op6_html_extract(spark, sf_dir):
    return html_extract.report(table(spark, sf_dir, "pages"))


@query()
def op8_token_output(spark, sf_dir):
    return token_output.report(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )


@query()
def op7_license_scan(spark, sf_dir):
    return license_scan.report(table(spark, sf_dir, "documents"))


@query()
def op11_sharding(spark, sf_dir):
    return sharding.report(table(spark, sf_dir, "documents"))


@query()
def op12_hard_negatives(spark, sf_dir):
    return hard_negatives.report(table(spark, sf_dir, "embeddings"))


@query()
def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.report(table(spark, sf_dir, "documents"))
