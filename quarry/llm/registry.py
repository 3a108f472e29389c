"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from quarry.llm import collocations, decontamination, embedding_dedup, language_id, line_dedup, minhash_dedup, pii, secret_scan, sentencepiece_codec, sharding, toxicity, url_filter, whitening

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_sharding": sharding.op4_sharding,
    "op5_sentencepiece": sentencepiece_codec.op5_sentencepiece,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_minhash_dedup": minhash_dedup.op7_minhash_dedup,
    "op8_language_id": language_id.op8_language_id,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_pii": pii.op10_pii,
    "op11_collocations": collocations.op11_collocations,
    "op12_whitening": whitening.op12_whitening,
    "op13_secret_scan": secret_scan.op13_secret_scan,
}
ORACLES: dict[str, str] = {
    "op1_decontamination": decontamination.ORACLE,
    "op3_embedding_dedup": embedding_dedup.ORACLE,
    "op7_minhash_dedup": minhash_dedup.ORACLE,
    "op11_collocations": collocations.ORACLE,
}
