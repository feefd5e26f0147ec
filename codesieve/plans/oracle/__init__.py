"""SQL twins of the registered queries, for comparison on another engine."""

from __future__ import annotations


def all_sql() -> dict[str, str]:
    from codesieve.plans.oracle import binaries, design, gate, metrics, naming, paths, review, scores, security, services, spans, wording

    out: dict[str, str] = {}
    for module in (security, gate, naming, metrics, wording, design, paths, review, services, scores, spans, binaries):
        out.update(module.sql())
    return out
