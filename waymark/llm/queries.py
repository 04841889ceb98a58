"""The queries of this subpackage, and their results as SQL for another engine."""

from __future__ import annotations

from waymark.llm import ann, bpe, centroids, exact, hamming, langid, lines, mixing, neardup, packing, quality, resample, warc

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_packing": packing.op2_packing,
    "op3_hamming": hamming.op3_hamming,
    "op4_quality": quality.op4_quality,
    "op5_bpe": bpe.op5_bpe,
    "op6_language": langid.op6_language,
    "op7_lines": lines.op7_lines,
    "op8_neighbours": ann.op8_neighbours,
    "op9_near_duplicates": neardup.op9_near_duplicates,
    "op10_warc": warc.op10_warc,
    "op11_resample": resample.op11_resample,
    "op12_clusters": centroids.op12_clusters,
    "op13_exact": exact.op13_exact,
}

ORACLES = {
    "op1_mix": mixing.OP1_SQL,
    "op3_hamming": hamming.OP3_SQL,
    "op11_resample": resample.OP11_SQL,
    "op12_clusters": centroids.OP12_SQL,
    "op13_exact": exact.OP13_SQL,
}
