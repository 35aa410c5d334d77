"""Coded errors, raised on the driver before or after a job, never inside one."""

from __future__ import annotations

#: The codes callers may test for.
CODES = ("E_SHORT_SAMPLE", "E_NULL_DATA", "E_BAD_RANGE", "E_INFEASIBLE", "E_Y10_REQUIRES_TR", "E_BAD_WEIGHTS", "E_EMPTY_INPUT")


class PanelError(ValueError):
    def __init__(self, code: str, message: str):
        assert code in CODES, code
        super().__init__(f"{code}: {message}")
        self.code = code
