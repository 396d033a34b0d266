from weir.quality.checks import RESULT_SCHEMA, Check, parse_checks, run_checks, summarize
from weir.quality.expectations import check_expectations
from weir.quality.gate import GateDecision, evaluate_gate, gate_table, results_in_scope
from weir.quality.quarantine import quarantine, split_rows

__all__ = [
    "Check", "GateDecision", "RESULT_SCHEMA", "check_expectations", "evaluate_gate", "gate_table", "parse_checks",
    "quarantine", "results_in_scope", "run_checks", "split_rows", "summarize",
]
