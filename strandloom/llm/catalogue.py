"""The queries of this folder and, where SQL can say the same, the SQL."""

from __future__ import annotations

from . import bpe, collocations, html_text, line_dedup, negatives, oddsketch, packing, pii, quality, sharding, simhash, topk, warc
from .sql import ORACLES

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_packing": packing.op3_packing,
    "op4_warc": warc.op4_warc,
    "op5_bpe_round_trip": bpe.op5_bpe_round_trip,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_exact_topk": topk.op7_exact_topk,
    "op8_sharding": sharding.op8_sharding,
    "op9_html_text": html_text.op9_html_text,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_phrase_collocations": collocations.op12_phrase_collocations,
    "op13_minhash_near_dedup": oddsketch.op13_minhash_near_dedup,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
