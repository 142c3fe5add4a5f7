"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontam, html_crf, jaccard_join, langid, line_dedup, sharding, spiece, topk, toxicity, warc

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_html_extraction": html_crf.op3_html_extraction,
    "op4_topk_search": topk.op4_topk_search,
    "op5_ngram_jaccard_join": jaccard_join.op5_ngram_jaccard_join,
    "op6_sharding": sharding.op6_sharding,
    "op7_benchmark_decontamination": decontam.op7_benchmark_decontamination,
    "op8_substring_dedup": line_dedup.op8_substring_dedup,
    "op9_warc": warc.op9_warc,
    "op10_sentencepiece": spiece.op10_sentencepiece,
}
ORACLE_SQL = {**topk.SQL, **line_dedup.SQL, **jaccard_join.SQL, **warc.SQL}
