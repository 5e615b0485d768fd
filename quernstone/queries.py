"""All queries of the core library: importing this module registers them."""

from __future__ import annotations

from .functions import note_queries  # noqa: F401
from .functions import queries as function_queries  # noqa: F401
from .operators import aggregates, answers, embeddings, fuzzy, hybrid, joins, keyword, maintenance, organise, postings, relational, search, vectors  # noqa: F401
from .plans import queries as plan_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
from .sources import queries as source_queries  # noqa: F401
from .streaming import autosave, sessions  # noqa: F401
