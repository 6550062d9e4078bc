"""The one error type of the library: a stable code plus the values that explain it."""

from __future__ import annotations


class ContractError(ValueError):
    """A declared rule does not hold. ``code`` is stable; ``details`` say where."""

    def __init__(self, code: str, message: str, **details: object) -> None:
        super().__init__(f"{code}: {message}" + (f" {details}" if details else ""))
        self.code = code
        self.details = details
