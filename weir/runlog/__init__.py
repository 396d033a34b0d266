from weir.runlog import analytics, definitions, evidence, incidents, search

__all__ = ["analytics", "definitions", "evidence", "incidents", "search"]
