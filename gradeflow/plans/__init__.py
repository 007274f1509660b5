"""All queries of the library, by name, and their SQL."""

from . import assessments, documents, recordings, streams, vector_tables  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
