"""The queries of this subpackage by name, and the SQL that says the same where there is one."""

from __future__ import annotations

from . import collocations, fingerprint, line_dedup, lm_score, minhash, mixing, periodic_runs, quality_rules, secrets, sentencepiece, suffix_dedup, token_counts, url_filter

MODULES = [collocations, fingerprint, line_dedup, lm_score, minhash, mixing, periodic_runs, quality_rules, secrets, sentencepiece, suffix_dedup, token_counts, url_filter]


def queries() -> dict:
    return {name: run for m in MODULES for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
