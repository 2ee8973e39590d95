"""Errors of the toolkit; all raised when a plan is built unless said otherwise."""


class ToolkitError(Exception):
    """Base of all errors below."""


class ColumnNotFound(ToolkitError):
    pass


class DuplicateColumn(ToolkitError):
    pass


class TypeMismatch(ToolkitError):
    pass


class CastFailed(ToolkitError):
    """No value of the column could be cast (found by a job)."""


class PartialCastFailure(ToolkitError):
    """Some values of the column couldn't be cast (found by a job)."""


class EmptyInput(ToolkitError):
    pass


class InvalidParameter(ToolkitError):
    pass


class ContainsNaN(ToolkitError):
    pass


class NotFitted(ToolkitError):
    pass


class ParseError(ToolkitError):
    pass
