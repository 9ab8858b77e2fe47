"""The queries of this subpackage and the SQL that gives the same rows, by name."""

from __future__ import annotations

from . import entropy_mix, jaccard_join, katz_lm, language_id, line_edit_join, quality_rules, secret_crf, sentencepiece_codec, suffix_dedup, uniform_threshold

_MODULES = [sentencepiece_codec, language_id, katz_lm, uniform_threshold, line_edit_join, jaccard_join, entropy_mix, suffix_dedup, secret_crf, quality_rules]

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
