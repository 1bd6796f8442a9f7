"""Every registered query with its SQL counterpart."""

from __future__ import annotations

from patchloom.plans import changes, evaluation, relational, structure, textual, versions  # noqa: F401  (each registers its queries)
from patchloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401


def flagship(spark, sf_dir):
    """Rank the later turns of a conversation against its first by TF-IDF, then select under a budget."""
    return QUERIES["greedy_budget"](spark, sf_dir)
