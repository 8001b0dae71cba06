"""Progress of long phases on a terminal or in a log."""

from __future__ import annotations

import sys
import time
from collections.abc import Iterable, Iterator
from typing import TextIO


class ProgressBar:
    """A line with count, share and the time that is left: redrawn on a terminal, a new line at every tenth elsewhere."""

    every = 0.1

    def __init__(self, label: str, total: int, width: int = 30, stream: TextIO | None = None):
        self.label, self.total, self.width, self.stream = label, max(1, total), width, stream or sys.stderr
        self.done, self.extra, self.began, self.drawn, self.tenth, self.size = 0, "", time.perf_counter(), 0.0, -1, 0
        self.live = bool(getattr(self.stream, "isatty", lambda: False)())

    def line(self) -> str:
        part = min(1.0, self.done / self.total)
        left = (time.perf_counter() - self.began) * (1 / part - 1) if part else 0.0
        bar = ("█" * int(self.width * part)).ljust(self.width, "░")
        return f"{self.label:<11} [{bar}] {self.done}/{self.total}  {part:>4.0%}  ETA {left:5.1f}s  {self.extra}".rstrip()

    def _write(self, end: str) -> None:
        line = self.line()
        self.stream.write(("\r" + line.ljust(self.size) if self.live else line) + end)
        self.size = len(line)
        self.stream.flush()

    def update(self, done: int | None = None, extra: str = "") -> None:
        self.done = self.done + 1 if done is None else done
        self.extra = extra or self.extra
        now = time.perf_counter()
        if self.live:
            if self.done >= self.total or now - self.drawn >= self.every:
                self.drawn = now
                self._write("")
        elif (tenth := min(10, 10 * self.done // self.total)) > self.tenth:
            self.tenth = tenth
            self._write("\n")

    def finish(self) -> None:
        if self.live or self.tenth < 10:
            self._write("\n")


def track(items: Iterable, label: str, stream: TextIO | None = None) -> Iterator:
    """The items, with a bar of how many were taken."""
    items = items if hasattr(items, "__len__") else list(items)
    bar = ProgressBar(label, len(items), stream=stream)
    for item in items:
        yield item
        bar.update()
    bar.finish()
