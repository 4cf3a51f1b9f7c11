"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, exact_dedup, katz, quality, rans, secrets, simhash, toxicity, url_filter

QUERIES = {
    "op1_simhash_near_dedup": simhash.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_url_filter": url_filter.query,
    "op4_secret_scan": secrets.query,
    "op5_decontaminate": decontaminate.query,
    "op6_token_files": rans.query,
    "op7_toxicity": toxicity.query,
    "op8_quality": quality.query,
    "op9_bpe": bpe.query,
    "op10_katz": katz.query,
}
SQL = {"op2_exact_dedup": exact_dedup.SQL}
