"""All registered queries of the library and their SQL."""

from . import variants  # noqa: F401  (registers its queries)
from .regions import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
