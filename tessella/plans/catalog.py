"""All registered queries with their SQL."""

from . import q_joins, q_lists, q_merge, q_more, q_proofs, q_text  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401

FLAGSHIP = "search_ranked"
