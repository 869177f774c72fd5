"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, content_store, exact_dedup, jaccard_join, license_scan, line_dedup, media, ngram_lm, packing, toxicity

_MODULES = [ngram_lm, exact_dedup, packing, bpe, license_scan, content_store, jaccard_join, line_dedup, toxicity, media]


def queries() -> dict:
    found = {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit() and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
