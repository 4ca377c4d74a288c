"""The queries of this subpackage and their SQL."""

from importlib import import_module

MODULES = ("language", "quality", "chat", "urls", "toxicity", "packing", "simhash", "line_dedup", "decontaminate", "token_store", "filter_audit", "sentence_pieces", "collocations")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"loomtrace.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
