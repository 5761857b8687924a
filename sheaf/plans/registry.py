"""All registered queries and their DuckDB oracles, merged across domains."""

from __future__ import annotations

from sheaf.plans import (content_oracle, content_queries, convlog_oracle, convlog_queries, documents_oracle,
                         documents_queries, memlog_oracle, memlog_queries, packages_oracle, packages_queries,
                         reports_oracle, reports_queries, samples_oracle, samples_queries)

_DOMAINS = [
    (memlog_queries.QUERIES, memlog_oracle.ORACLE),
    (convlog_queries.QUERIES, convlog_oracle.ORACLE),
    (samples_queries.QUERIES, samples_oracle.ORACLE),
    (documents_queries.QUERIES, documents_oracle.ORACLE),
    (packages_queries.QUERIES, packages_oracle.ORACLE),
    (content_queries.QUERIES, content_oracle.ORACLE),
    (reports_queries.QUERIES, reports_oracle.ORACLE),
]


def all_queries() -> dict:
    out = {}
    for q, _ in _DOMAINS:
        dup = set(out) & set(q)
        if dup:
            raise ValueError(f"duplicate query keys {dup}")
        out.update(q)
    return out


def all_oracles() -> dict:
    out = {}
    for q, o in _DOMAINS:
        extra = set(o) - set(q)
        if extra:
            raise ValueError(f"oracle without query: {extra}")
        out.update(o)
    return out
