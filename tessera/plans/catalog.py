"""All registered queries of the core library, by family."""

from __future__ import annotations

from tessera.plans import graphs, grouping, lists, multisets, positional, programs, scalars, streams, tabular, variants, vocabulary

FAMILIES = (tabular, scalars, positional, grouping, lists, variants, multisets, programs, graphs, streams, vocabulary)
QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
ORACLE = {name: sql for family in FAMILIES for name, sql in family.ORACLE.items()}
