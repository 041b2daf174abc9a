"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage; ``queries.py`` holds the registered
queries and ``sql.py`` the DuckDB text of those that SQL can express.
"""
