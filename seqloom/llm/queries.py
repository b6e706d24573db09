"""The queries of this subpackage and their SQL."""

from seqloom.llm import decontaminate, language_id, lm_scoring, mixing, ngram_join, quality, sharding, token_files, url_filters, warc

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_url_filters": url_filters.op2_url_filters,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_language_id": language_id.op4_language_id,
    "op5_warc": warc.op5_warc,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_sharding": sharding.op8_sharding,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality": quality.op10_quality,
}
ORACLES = {"op2_url_filters": url_filters.ORACLE, "op3_ngram_join": ngram_join.ORACLE, "op5_warc": warc.ORACLE, "op7_decontamination": decontaminate.ORACLE, "op9_mixing": mixing.ORACLE, "op10_quality": quality.ORACLE}
