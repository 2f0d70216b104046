"""Errors that estimators, models and the profiler raise."""

from __future__ import annotations


class LoomError(Exception):
    """Base of all errors of this library."""


class NotFitted(LoomError):
    """A model was asked for before its estimator was fitted."""


class InvalidInput(LoomError):
    """Data that the operation can't take, such as non-finite numbers or an inconsistent stored model."""


class ShapeMismatch(LoomError):
    """Columns differ from those a model was fitted to."""


class EmptyInput(LoomError):
    """No rows or no columns."""


class AllMissing(LoomError):
    """A column, or what a row could be compared on, has no value at all."""


class UnknownCategory(LoomError):
    """A category that fitting didn't see, where that isn't allowed."""


class UnknownLabel(LoomError):
    """A label that fitting didn't see, or that isn't a class label."""


class InvalidConfig(LoomError):
    """Parameters that make no sense."""


class Singular(LoomError):
    """A system of equations without a unique solution."""
