"""The registered queries: every operator with production parameters over its whole table."""

from opslens.llm import query_fingerprints, query_licenses, query_merkle, query_packing, query_pieces, query_pii, query_quality, query_secrets, query_shards, query_simhash, query_topk, query_urls, query_whitening  # noqa: F401
from opslens.llm.registry import QUERIES, SQL  # noqa: F401
