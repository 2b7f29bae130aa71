"""A small structured logger."""

from __future__ import annotations

import sys
from datetime import UTC, datetime
from typing import TextIO


class Log:
    """Lines of a time, a level, a message and fields, on standard output unless another stream is given."""

    def __init__(self, stream: TextIO | None = None):
        self.stream = stream

    def info(self, message: str, **fields: object) -> None:
        self._line("info", message, fields)

    def error(self, message: str, error: object, **fields: object) -> None:
        self._line("error", message, {"error": error, **fields})

    def _line(self, level: str, message: str, fields: dict[str, object]) -> None:
        rest = "".join(f" {k}={v!s}" for k, v in fields.items())
        print(f"{datetime.now(UTC):%Y-%m-%d %H:%M:%S.%f} level={level} msg={message}{rest}", file=self.stream or sys.stdout, flush=True)


class Silent(Log):
    """Says nothing."""

    def _line(self, level: str, message: str, fields: dict[str, object]) -> None:
        pass
