"""boardsieve: collect, classify, de-duplicate and track postings with Spark."""

from boardsieve.session import configure
from boardsieve.settings import RuleSet

__all__ = ["RuleSet", "configure"]
