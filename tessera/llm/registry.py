"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from functools import wraps

from tessera.llm import chat, decontaminate, jaccard, langid, licenses, mixing, negatives, pii, runs, secrets, suffix, toxicity, winnow
from tessera.llm.common import bound_batches


def _registered(query):
    @wraps(query)
    def run(spark, sf_dir):
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    name: _registered(query)
    for name, query in {
        "op1_decontaminate": decontaminate.query,
        "op2_suffix_dedup": suffix.query,
        "op3_toxicity": toxicity.query,
        "op4_winnow_fingerprints": winnow.query,
        "op5_jaccard_join": jaccard.query,
        "op6_secret_scan": secrets.query,
        "op7_pseudonyms": pii.query,
        "op8_language_id": langid.query,
        "op9_mix_sources": mixing.query,
        "op10_chat_format": chat.query,
        "op11_periodic_runs": runs.query,
        "op12_license_scan": licenses.query,
        "op13_hard_negatives": negatives.query,
    }.items()
}
ORACLES = {
    "op10_chat_format": chat.SQL,
    "op13_hard_negatives": negatives.SQL,
}
