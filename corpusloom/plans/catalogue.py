"""All queries outside the training-data subpackage."""

import importlib

from corpusloom.plans.registry import Catalogue

ENTRIES: Catalogue = Catalogue()
for _group in ("text_queries", "guard_queries", "retrieval_queries", "graph_queries", "incremental_queries", "conversation_queries", "event_queries", "eval_queries"):
    ENTRIES.update(importlib.import_module(f"corpusloom.plans.{_group}").QUERIES)
