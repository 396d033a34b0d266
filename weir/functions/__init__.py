from weir.functions import ordering, redact, scalar, types

__all__ = ["ordering", "redact", "scalar", "types"]
