"""All registered training-data queries and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("bpe", "substrings", "neighbours", "simhash", "token_files", "language", "decontaminate", "sharding", "lm", "warc", "backtrack", "runs", "ranked")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"attrition.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(getattr(_module, "ORACLE_SQL", {}))
