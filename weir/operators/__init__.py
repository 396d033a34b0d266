from weir.operators.aggregate import aggregate, parse_measures
from weir.operators.filter import filter_rows, parse_predicates
from weir.operators.join import join, join_cardinality, parse_keys
from weir.operators.keyed import count_by_state, latest_per_key, look_back, merge_rows
from weir.operators.project import flatten_once, project, record_path, rename_collisions
from weir.operators.sort import Page, capped, distinct_rows, keyset_page, limit_offset, order_by, top_k

__all__ = [
    "Page", "aggregate", "capped", "count_by_state", "distinct_rows", "filter_rows", "flatten_once", "join",
    "join_cardinality", "keyset_page", "latest_per_key", "limit_offset", "look_back", "merge_rows", "order_by",
    "parse_keys", "parse_measures", "parse_predicates", "project", "record_path", "rename_collisions", "top_k",
]
