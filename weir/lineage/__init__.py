from weir.lineage.columns import column_lineage, describe_select, unused_columns
from weir.lineage.edges import first_nodes, lineage_edges, lineage_nodes, merge_edges, merge_nodes, parse_definitions, producers, unresolved
from weir.lineage.reach import reachable

__all__ = [
    "column_lineage", "describe_select", "first_nodes", "lineage_edges", "lineage_nodes", "merge_edges", "merge_nodes",
    "parse_definitions", "producers", "reachable", "unresolved", "unused_columns",
]
