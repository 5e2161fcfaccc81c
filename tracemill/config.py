"""Frozen constants of scoring and comparison.  Nothing else in the package defines them again."""

from __future__ import annotations

from types import MappingProxyType

# They must equal those of the analyses that this engine reproduces.
WEIGHTS = MappingProxyType({"C": 0.5, "P": 0.25, "R": 0.15, "H": 0.10})
MIN_REPEATS = 3
TOKEN_WEIGHTS = MappingProxyType({"in": 1.0, "out": 5.0, "cacheR": 0.1, "cacheW": 1.25})
VERDICT = MappingProxyType({"min_pairs": 8, "min_pairs_skill": 5, "delta_pp": 5.0, "level": 0.95, "iters": 10_000, "seed": 0x9E3779B9, "tripwire_pct": 12.0})
DATASET = MappingProxyType({"smoke_min": 20, "smoke_max": 30, "multi_intent_share": 0.15})
DEPGRAPH = MappingProxyType({"inline": 0.60, "external": 0.20, "co_read": 0.80, "co_trigger": 0.50, "jaccard": 0.30, "min_categories": 2, "min_sessions": 5, "chars_per_token": 4})
PROBES = MappingProxyType({"min_cases": 3, "max_gram": 3, "min_runs": 5})
PROXIMITY = MappingProxyType({"window": 6, "min_pair_cases": 3})
DESCRIPTION_MAX = 1024
CONTEXT_LIMIT = 200_000
TOKEN_CHARS = 4
