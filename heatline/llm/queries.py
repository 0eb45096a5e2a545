"""The registered queries of this subpackage and the SQL that some of them must agree with."""

from __future__ import annotations

import corpus_pipeline

from . import asof, binary_output, bpe, jaccard, lexical, lm, packing, pii, quality, secrets, sharding, simhash, topk

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_sharding": sharding.query,
    "op3_byte_bpe": bpe.query,
    "op4_pitman_yor": lm.query,
    "op5_pivot_topk": topk.query,
    "op6_best_fit_packing": packing.query,
    "op7_secrets": secrets.query,
    "op8_pii": pii.query,
    "op9_binary_output": binary_output.query,
    "op10_quality": quality.query,
    "op11_lexical": lexical.query,
    "op12_asof": asof.query,
    "op13_jaccard": jaccard.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op5_pivot_topk": topk.SQL, "op11_lexical": lexical.SQL, "op12_asof": asof.SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
