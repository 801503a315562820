"""Training-data operators: tokenisation, deduplication, search, scoring, packaging.

Every module holds one operator and its ``opN_*`` query; nothing else in the
library imports this package.
"""
