"""All queries of this subpackage, the pipeline included."""

from __future__ import annotations

import corpus_pipeline
from barloom.llm.queries import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run

__all__ = ["ORACLES", "QUERIES"]
