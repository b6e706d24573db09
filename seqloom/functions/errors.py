"""Exceptions of the sequence API."""


class InvalidOperationError(ValueError):
    """An operation that the data do not allow, such as a duplicate dictionary key."""


class EmptySequenceError(InvalidOperationError):
    """A terminal needs at least one element and there is none."""


class MoreThanOneElementError(InvalidOperationError):
    """A terminal needs at most one element and there are more."""


class ArgumentOutOfRangeError(ValueError):
    """An index or percentile lies outside its range."""


class AbortedError(Exception):
    """A signal was set while a terminal ran."""
