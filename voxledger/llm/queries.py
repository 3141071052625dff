"""Importing this module registers the queries of the subpackage."""

from voxledger.llm import queries_dedup, queries_models, queries_new, queries_rules, queries_text  # noqa: F401
