"""All registered queries of this subpackage."""

from listwright.llm import alignment, conversations, decontamination, jaccard, lines, neighbours, packed, packing, pii, quality, secrets, setsketch, toxicity  # noqa: F401  (register queries)
from listwright.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
