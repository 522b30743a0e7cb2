"""All queries of this subpackage; importing the operator modules registers them."""

from blotter.llm import (  # noqa: F401
    divergence, filters, jaccard, language, lines, packing, pages, pieces, quality, secrets,
    tokencounts, topk, toxicity,
)
from blotter.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
