"""Registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from vicinal.llm import chat, collocation, decontaminate, fingerprint, importance, language, mixing, neardup, secrets, sharding, toxicity, urlfilter, warc

MODULES = [warc, secrets, toxicity, fingerprint, chat, neardup, decontaminate, sharding, language, mixing, collocation, importance, urlfilter]
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
