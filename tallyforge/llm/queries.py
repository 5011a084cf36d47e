"""The corpus queries: opN_<name> -> callable, and DuckDB SQL where SQL expresses one on whole tables."""

from __future__ import annotations

from .ctw import op2_context_tree
from .decontaminate import op8_latent_leaks
from .licences import op10_licence_scan
from .mixing import op9_mix_sources
from .neardup import op7_superminhash
from .pii import op5_boosted_pii
from .quality import OP4_SQL, op4_adaptive_quality
from .shards import op1_hash_tree
from .substrings import op3_suffix_family
from .toxicity import op6_weak_toxicity

QUERIES = {f.__name__: f for f in (op1_hash_tree, op2_context_tree, op3_suffix_family, op4_adaptive_quality, op5_boosted_pii, op6_weak_toxicity, op7_superminhash, op8_latent_leaks, op9_mix_sources, op10_licence_scan)}
ORACLE_SQL: dict[str, str] = {"op4_adaptive_quality": OP4_SQL}
