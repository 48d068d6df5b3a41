"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, jaccard_join, lm_score, media, pieces, pii, secret_scan, token_files, toxicity, url_filter

QUERIES = {
    "op1_secret_ownership": secret_scan.op1_secret_ownership,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_pieces": pieces.op3_pieces,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_rans_tokens": token_files.op5_rans_tokens,
    "op6_stupid_backoff": lm_score.op6_stupid_backoff,
    "op7_latent_decontamination": decontaminate.op7_latent_decontamination,
    "op8_pii": pii.op8_pii,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_media_tar": media.op10_media_tar,
}

ORACLE_SQL: dict[str, str] = {
    "op1_secret_ownership": secret_scan.ORACLE,
    "op6_stupid_backoff": lm_score.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
}
