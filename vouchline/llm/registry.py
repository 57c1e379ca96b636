"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from vouchline.llm import bpe, collocations, decontaminate, divergence, minhash, pitman_yor, quality, secrets, simhash, suffix_dedup, toxicity, url_filter, warc

QUERIES = {
    "op1_pitman_yor": pitman_yor.op1_pitman_yor,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_minhash": minhash.op11_minhash,
    "op12_divergence": divergence.op12_divergence,
    "op13_collocations": collocations.op13_collocations,
    "op2_warc": warc.op2_warc,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_simhash": simhash.op7_simhash,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_decontaminate": decontaminate.op9_decontaminate,
}
ORACLES = {
    "op11_minhash": minhash.ORACLE,
    "op12_divergence": divergence.ORACLE,
    "op13_collocations": collocations.ORACLE,
    "op2_warc": warc.ORACLE,
    "op8_quality_rules": quality.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
}
