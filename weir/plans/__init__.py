from weir.plans.backfill import backfill_dates, backfill_progress, missing_dates, missing_in_ranges, run_backfill, unique_runs
from weir.plans.flow import FlowResult, run_flow
from weir.plans.pyfunc import map_groups, map_rows

__all__ = [
    "FlowResult", "backfill_dates", "backfill_progress", "map_groups", "map_rows", "missing_dates", "missing_in_ranges", "run_backfill", "run_flow",
    "unique_runs",
]
