"""All registered queries of the library."""

from . import bank_queries, builder_queries, check_queries, corpus_queries, cut_queries, text_queries, vector_queries  # noqa: F401  (they register their queries)
from .registry import COVERS, QUERIES, SQL  # noqa: F401
