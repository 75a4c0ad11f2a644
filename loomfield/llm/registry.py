"""Queries of this subpackage and their SQL."""

from loomfield.llm import fingerprints, idfile, langid, lexical, mixing, neardup, packing, quality, resampling, secrets, sharding, topk, toxicity

QUERIES = {
    "op1_secret_scans": secrets.op1_secret_scans,
    "op2_top_k": topk.op2_top_k,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_near_dedup": neardup.op4_near_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_token_ids": idfile.op7_token_ids,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_sharding": sharding.op9_sharding,
    "op10_quality": quality.op10_quality,
    "op11_language_id": langid.op11_language_id,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_ranked_search": lexical.op13_ranked_search,
}
SQL: dict[str, str] = {
    "op1_secret_scans": secrets.OP1_SQL,
    "op2_top_k": topk.OP2_SQL,
    "op4_near_dedup": neardup.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op12_importance_resampling": resampling.OP12_SQL,
    "op13_ranked_search": lexical.OP13_SQL,
}
