"""The registered queries of this subpackage."""

from __future__ import annotations

from tessera.llm import decontaminate, html_text, jaccard_join, kneser_ney, packing, quality, secrets, topk, toxicity, warc

OPERATORS = (decontaminate, jaccard_join, html_text, kneser_ney, packing, quality, secrets, topk, toxicity, warc)
QUERIES = {name: query for operator in OPERATORS for name, query in operator.QUERIES.items()}
ORACLE = {name: sql for operator in OPERATORS for name, sql in operator.ORACLE.items()}
