from weir.contracts.evolve import classify_type_change, diff_schemas, worst_classification
from weir.contracts.infer import coerce, infer_columns, infer_schema, probe, unify
from weir.contracts.profile import preview, profile
from weir.contracts.registry import fingerprints, latest_changes, register, schema_history, validate

__all__ = [
    "classify_type_change", "coerce", "diff_schemas", "fingerprints", "infer_columns", "infer_schema", "latest_changes",
    "preview", "probe", "profile", "register", "schema_history", "unify", "validate", "worst_classification",
]
