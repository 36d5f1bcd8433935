"""Imports the modules that register queries."""

from casefile.plans import text_queries  # noqa: F401
from casefile.plans import citation_queries  # noqa: F401
from casefile.plans import matching_queries  # noqa: F401
from casefile.plans import group_queries  # noqa: F401
from casefile.plans import planning_queries  # noqa: F401
from casefile.plans import quality_queries  # noqa: F401
from casefile.plans import detail_queries  # noqa: F401
from casefile.plans import journal_queries  # noqa: F401
