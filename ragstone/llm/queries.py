"""The opN queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from ragstone.llm import byte_bpe, decontaminate, language_id, media, minhash, quality, runs, segmentation, token_counts, token_ids, toxicity, variants, warc

QUERIES = {
    "op1_token_id_output": token_ids.query,
    "op2_decontaminate": decontaminate.query,
    "op3_warc": warc.query,
    "op4_minhash_near_dedup": minhash.query,
    "op5_quality_resampling": quality.query,
    "op6_token_counts": token_counts.query,
    "op7_toxicity": toxicity.query,
    "op8_sentencepiece_nbest": segmentation.query,
    "op9_language_id": language_id.query,
    "op10_progressive_jpeg": media.query,
    "op11_byte_bpe": byte_bpe.query,
    "op12_periodic_runs": runs.query,
    "op13_spelling_variants": variants.query,
}

ORACLE_SQL = {
    "op2_decontaminate": decontaminate.ORACLE_SQL,
    "op3_warc": warc.ORACLE_SQL,
    "op4_minhash_near_dedup": minhash.ORACLE_SQL,
}
