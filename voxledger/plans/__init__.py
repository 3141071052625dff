"""Registered queries: each operator over the given tables, with an equivalent SQL statement."""
