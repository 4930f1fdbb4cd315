"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontamination, html_wrappers, jaccard_join, packing, quality_rules, quality_sql, secret_scans, sharding, suffix_tree, text_sql, token_files, tool_calls

_MODULES = (suffix_tree, decontamination, sharding, quality_rules, secret_scans, packing, jaccard_join, token_files, html_wrappers, tool_calls)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {**quality_sql.SQL, **text_sql.SQL}
