"""Training-data operators: filtering, deduplication, search, sharding, mixing and tokenising of document tables.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()`` live in :mod:`spanloom.llm.queries`.
"""
