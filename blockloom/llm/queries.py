"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query -> (module of this package, the SQL's name there or None)
NAMES = {
    "op1_quality": ("quality", None),
    "op2_decontamination": ("decontamination", None),
    "op3_sharding": ("sharding", None),
    "op4_near_dedup": ("near_dedup", None),
    "op5_language_id": ("language", None),
    "op6_mixing": ("mixing", "OP6_SQL"),
    "op7_token_counts": ("token_counts", None),
    "op8_secret_scan": ("secrets", None),
    "op9_embedding_dedup": ("embedding_dedup", "OP9_SQL"),
    "op10_suffix_dedup": ("suffix_dedup", None),
}


def queries() -> dict:
    own = {name: getattr(import_module(f"blockloom.llm.{module}"), name) for name, (module, _) in NAMES.items()}
    return own | {"pipeline": import_module("corpus_pipeline").run}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"blockloom.llm.{module}"), sql) for name, (module, sql) in NAMES.items() if sql}
