"""Errors raised while a plan is built, before any Spark job starts, unless stated otherwise."""


class ConfigError(ValueError):
    """A spec names something that does not exist or asks for something that has no meaning."""


class ValidationError(RuntimeError):
    """Data broke a rule that was configured to stop the flow."""


class GateBlocked(RuntimeError):
    """A quality gate refused to let a write happen."""

    def __init__(self, message: str, failed_checks: list[str]):
        super().__init__(message)
        self.failed_checks = failed_checks
