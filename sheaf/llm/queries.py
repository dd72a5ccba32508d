"""All queries of this subpackage, and their SQL."""

from sheaf.llm import bpe, chat, counting, jaccard, leaks, lines, phrases, private, quality, spelling, substrings, suffixes, toxicity  # noqa: F401
from sheaf.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
