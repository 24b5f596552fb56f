"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it.  `queries.py` registers the thin
`opN_*` queries, `sql.py` their DuckDB counterparts.
"""
