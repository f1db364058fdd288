"""Training-data operators. Nothing outside this subpackage imports it.

``queries()`` and ``oracle_sql()`` collect the ``opN_*`` queries; each operator module also keeps its own
general interface.
"""

from siltstone.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
