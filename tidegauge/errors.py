"""Errors that callers can tell apart."""


class EngineError(Exception):
    """Any error of this engine."""


class ParseError(EngineError, ValueError):
    """Text that isn't in the grammar."""


class QueryError(EngineError):
    """A query that can't be planned: unknown measurement, or an order comparison of text with a number."""


class ValidationError(EngineError, ValueError):
    """A point, name or setting that isn't allowed."""
