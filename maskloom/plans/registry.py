"""All queries of the core, and their SQL."""

from __future__ import annotations

from maskloom.plans import aggregating, bundle, evaluating, filtering, geometry, problems, roundtrips, sampling

MODULES = [problems, geometry, filtering, aggregating, evaluating, sampling, bundle, roundtrips]
FLAGSHIP = "cgf1_image"
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
