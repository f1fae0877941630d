"""The exception of all archive operations."""

from __future__ import annotations


class ArchiveError(ValueError):
    """A failure with a canonical code: str() is "[CODE] message"."""

    def __init__(self, code: str, message: str):
        super().__init__(f"[{code}] {message}")
        self.code = code
        self.message = message

    def __reduce__(self):
        return ArchiveError, (self.code, self.message)
