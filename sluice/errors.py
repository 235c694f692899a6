"""Diagnostics with a code, a place and a hint."""

from __future__ import annotations


class QueryError(ValueError):
    """code: syntax, unsupported, unknown_name, arguments, resource_limit or invalid_option."""

    def __init__(self, code: str, reason: str, *, expression: str = "", line: int = 0, column: int = 0, suggestion: str = "") -> None:
        self.code, self.reason, self.expression, self.line, self.column, self.suggestion = code, reason, expression, line, column, suggestion
        place = f" at line {line}, column {column}" if line else ""
        super().__init__(f"[{code}] {reason}{place}" + (f": {expression}" if expression else "") + (f". {suggestion}" if suggestion else ""))
