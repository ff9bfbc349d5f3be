"""All registered queries.  Importing the family modules fills the registry."""
from __future__ import annotations

from . import text_queries  # noqa: F401
from . import lookup_queries  # noqa: F401
from . import prep_queries  # noqa: F401
from . import similar_queries  # noqa: F401
from . import analysis_queries  # noqa: F401
from .registry import SPARK, SQL

__all__ = ["SPARK", "SQL"]
