"""Operators for preparing training data, with their queries. Nothing else imports this."""

from __future__ import annotations

import importlib

from tidemark.llm.common import on_workers

_MODULES = (
    "mixing", "chat", "suffix_dedup", "decontaminate", "quality", "html_text", "simhash", "toxicity", "window_dedup", "urls",
    "line_dedup", "filter_audit", "importance",
)


def registered() -> tuple[dict, dict]:
    """Queries and SQL twins by name."""
    queries: dict = {}
    twins: dict = {}
    for name in _MODULES:
        module = importlib.import_module(f"tidemark.llm.{name}")
        queries.update({k: on_workers(q) for k, q in module.QUERIES.items()})
        twins.update(getattr(module, "ORACLES", {}))
    import corpus_pipeline

    queries["pipeline"] = on_workers(corpus_pipeline.run)
    if corpus_pipeline.ORACLE_SQL is not None:
        twins["pipeline"] = corpus_pipeline.ORACLE_SQL
    return queries, twins
