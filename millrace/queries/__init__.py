"""All queries over the reference's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from millrace.queries import catalogue, features, flows, preprocess

QUERIES = {**features.QUERIES, **preprocess.QUERIES, **flows.QUERIES, **catalogue.QUERIES}
ORACLES = {**features.ORACLES, **preprocess.ORACLES, **flows.ORACLES, **catalogue.ORACLES}
