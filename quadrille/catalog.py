"""The registered queries over the driver's tables, and the SQL that each must agree with."""

from __future__ import annotations

from quadrille.plans import checks, corpus, evaluate, extras, invariants, labels, measures, profile, rollups, spatial, streams

REGISTRIES = (spatial.query, measures.query, rollups.query, invariants.query, corpus.query, extras.query, streams.query)
QUERIES: dict = profile.QUERIES | labels.QUERIES | evaluate.QUERIES | checks.QUERIES
ORACLE_SQL: dict[str, str] = profile.ORACLE_SQL | labels.ORACLE_SQL | evaluate.ORACLE_SQL | checks.ORACLE_SQL
for registry in REGISTRIES:
    QUERIES |= registry.queries
    ORACLE_SQL |= registry.sql
FLAGSHIP = "freq_floor_cuts"
