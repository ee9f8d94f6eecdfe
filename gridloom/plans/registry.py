"""The queries outside the llm subpackage."""

from __future__ import annotations

from gridloom.plans import answers, boxes, detection, exchange, files, rejects, samples, scalars, tokens

MODULES = (boxes, detection, scalars, answers, samples, tokens, files, exchange, rejects)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
