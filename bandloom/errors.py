"""Typed errors and gates: what needs a confirmation raises unless it was given."""

from __future__ import annotations


class BandloomError(ValueError):
    """An error with a stable code, a message and structured details."""

    def __init__(self, code: str, message: str, **details):
        super().__init__(f"{code}: {message}")
        self.code, self.details = code, details


class NeedsConfirmation(BandloomError):
    """The caller must decide something that must not be guessed."""


class DependencyMissing(BandloomError):
    """A library that an optional method needs isn't installed."""


def confirm(given: bool, code: str, message: str, **details) -> None:
    if not given:
        raise NeedsConfirmation(code, message, **details)


def require(holds: bool, code: str, message: str, **details) -> None:
    if not holds:
        raise BandloomError(code, message, **details)


def needs(module: str, purpose: str):
    """The module, or a typed error that says what it is missing for."""
    import importlib

    try:
        return importlib.import_module(module)
    except ImportError:
        raise DependencyMissing("DEPENDENCY_MISSING", f"{purpose} needs {module}, which isn't installed", module=module) from None
