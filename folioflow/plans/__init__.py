"""All queries of the library over the given tables."""

from . import ingestion, retrieval, texts, usage  # noqa: F401
from . import streams  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
