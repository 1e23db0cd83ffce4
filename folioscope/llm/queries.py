"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, centroids, itemsets, katz, language_id, media_store, mixing, ngram_join, pii, quality_rules, token_files, top_k, warc_bundles


def queries() -> dict:
    return {
        "op1_token_files": token_files.op1,
        "op2_language_id": language_id.op2,
        "op3_katz": katz.op3,
        "op4_quality_rules": quality_rules.op4,
        "op5_media_store": media_store.op5,
        "op6_warc_bundles": warc_bundles.op6,
        "op7_pii": pii.op7,
        "op8_bpe": bpe.op8,
        "op9_ngram_join": ngram_join.op9,
        "op10_mixing": mixing.op10,
        "op11_top_k": top_k.op11,
        "op12_centroids": centroids.op12,
        "op13_itemsets": itemsets.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality_rules.oracle(), "op10_mixing": mixing.SQL, "op11_top_k": top_k.SQL, "op12_centroids": centroids.SQL}
