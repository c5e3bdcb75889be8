"""The corpus queries by name; ``__spark_entry__.py`` imports the modules."""

from __future__ import annotations

import importlib

#: query name -> module of this subpackage that has ``query(spark, sf_dir)`` and perhaps ``SQL``
MODULES = {
    "op7_pii": "pii",
    "op8_lm_score": "lm_score",
    "op5_toxicity": "toxicity",
    "op3_embedding_dedup": "embedding_dedup",
    "op4_jaccard_join": "jaccard_join",
    "op2_license_scan": "licenses",
    "op9_decontaminate": "decontaminate",
    "op1_suffix_dedup": "suffix_dedup",
    "op6_mix_sources": "mixing",
    "op10_chat_format": "chat_format",
    "op11_spelling_variants": "spelling",
    "op12_shard": "sharding",
    "op13_whiten": "whitening",
}


def queries() -> dict:
    return {name: importlib.import_module(f"chronoline.llm.{m}").query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    mods = {name: importlib.import_module(f"chronoline.llm.{m}") for name, m in MODULES.items()}
    return {name: m.SQL for name, m in mods.items() if getattr(m, "SQL", None)}
