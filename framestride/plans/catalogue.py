"""All queries of the frame-sequence operators and their SQL."""

from __future__ import annotations

from framestride.plans import inference_queries, media_queries, motion_queries, names_and_joins, pixel_queries, scene_queries, sequence_queries  # noqa: F401
from framestride.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
