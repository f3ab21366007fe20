"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: query -> module, in the order of the operators
MODULES = {
    "op1_sharding": "sharding",
    "op2_bpe": "codec",
    "op3_packing": "packing",
    "op4_lm": "lm",
    "op5_chat": "chat",
    "op6_pii": "pii",
    "op7_ann": "forest",
    "op8_quality": "pairwise",
    "op9_dedup": "dedup",
    "op10_rules": "rules",
    "op11_audit": "audit",
    "op12_mixing": "apportion",
    "op13_spelling": "spelling",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in MODULES.items():
        sql = getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
