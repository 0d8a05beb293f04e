"""Physical-plan helpers: shared scratch tables and skew-safe joins."""

from weftgraph.plans.ranks import numbered
from weftgraph.plans.scratch import Scratch
from weftgraph.plans.skew import lookup

__all__ = ["Scratch", "lookup", "numbered"]
