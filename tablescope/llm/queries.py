"""The registered queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

_OPERATORS = ("chats", "fingerprints", "jaccard", "language", "merkle", "mixing", "packing", "pieces", "quality", "repeats", "secrets", "token_counts", "toxicity")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in _OPERATORS:
    _module = importlib.import_module(f"tablescope.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
