"""All registered queries of the engine's own operators."""

from __future__ import annotations

from lectern.plans import corpus, expressions, files, maintenance, relational, retrieval  # noqa: F401
from lectern.plans.registry import ORACLES, QUERIES  # noqa: F401

#: Keyword search over passages: scan, tokens, postings, scores and top-k.
FLAGSHIP = retrieval.bm25_or
