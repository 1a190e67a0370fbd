"""Registered queries of the text operators and their oracles."""

from __future__ import annotations

import functools

from sitegraph.llm import (compress_classifier, conversations, decontaminate, ngram_join, packing, ppm, quality_rules,
                           secrets, sharding, suffix_dedup, topk, warc, whitening)
from sitegraph.llm.common import importable_on_workers


def _query(run):
    @functools.wraps(run)
    def query(spark, sf_dir):
        importable_on_workers(spark)
        return run(spark, sf_dir)

    return query


QUERIES = {name: _query(run) for name, run in {
    "op1_warc": warc.op1_warc,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_compression_classifier": compress_classifier.op3_compression_classifier,
    "op4_ppm": ppm.op4_ppm,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op8_ngram_jaccard": ngram_join.op8_ngram_jaccard,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_packing": packing.op10_packing,
    "op11_whitening": whitening.op11_whitening,
    "op12_exact_topk": topk.op12_exact_topk,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}.items()}

ORACLES = {
    "op1_warc": warc.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op8_ngram_jaccard": ngram_join.SQL,
    "op12_exact_topk": topk.SQL,
    "op13_conversation_repair": conversations.SQL,
}
