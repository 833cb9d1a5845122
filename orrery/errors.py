"""Errors by kind, with the HTTP status a server would give them."""

from __future__ import annotations


class EngineError(Exception):
    status = 500


class InvalidArgument(EngineError):
    status = 400


class Unauthorized(EngineError):
    status = 401


class Forbidden(EngineError):
    status = 403


class NotFound(EngineError):
    status = 404


class AlreadyExists(EngineError):
    status = 409


class PayloadTooLarge(EngineError):
    status = 413


class Unprocessable(EngineError):
    status = 422


class Unimplemented(EngineError):
    status = 501


class Validation(InvalidArgument):
    def __init__(self, field: str, message: str):
        super().__init__(f"Validation error: {field}: {message}")
