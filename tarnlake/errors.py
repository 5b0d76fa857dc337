"""Typed errors with a code, for what services answer with a failure envelope."""

from __future__ import annotations


class EngineError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message


class InvalidArgument(EngineError):
    pass


class NotFound(EngineError):
    pass


class Conflict(EngineError):
    pass
