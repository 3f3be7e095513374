"""Structured logging: readable lines on the console, JSON lines in a file.

A record is a message and ordered key-value pairs. Values that are dicts are groups, whose
keys join with dots; empty groups vanish. A logger derived by bind() or group() leaves
its parent as it is.
"""

from __future__ import annotations

import json
import os
import sys
import threading
from datetime import UTC, datetime

# Levels and the colours of their names.
LEVELS = {"DEBUG": 10, "INFO": 20, "WARN": 30, "ERROR": 40}
COLORS = {"DEBUG": "\x1b[1;90m", "INFO": "\x1b[1;36m", "WARN": "\x1b[1;33m", "ERROR": "\x1b[1;31m"}
RESET, DIM = "\x1b[0m", "\x1b[2m"
ESCAPES = {"\a": r"\a", "\b": r"\b", "\f": r"\f", "\n": r"\n", "\r": r"\r", "\t": r"\t", "\v": r"\v", '"': r"\"", "\\": r"\\"}


def quoted(text: str) -> str:
    """text, in quotes with escapes if it is empty or holds blanks, '=', quotes or unprintable characters."""
    if text and all(c.isprintable() and not c.isspace() and c not in '="' for c in text):
        return text

    def escaped(c: str) -> str:
        if c in ESCAPES:
            return ESCAPES[c]
        if c.isprintable():
            return c
        n = ord(c)
        return f"\\x{n:02x}" if n < 0x80 else f"\\u{n:04x}" if n < 0x10000 else f"\\U{n:08x}"

    return '"' + "".join(map(escaped, text)) + '"'


def flat(pairs, prefix: str = ""):
    """(dotted key, value) of pairs; a group without a key is written in line."""
    for key, value in pairs:
        if isinstance(value, dict):
            yield from flat(value.items(), f"{prefix}{key}." if key else prefix)
        elif key or value is not None:
            yield prefix + key, value


def shown(value) -> str:
    return {True: "true", False: "false", None: "<nil>"}[value] if value is None or isinstance(value, bool) else str(value)


def use_color(stream) -> bool:
    if os.environ.get("NO_COLOR") or os.environ.get("TERM") == "dumb":
        return False
    return bool(stream is not None and getattr(stream, "isatty", lambda: False)())


class Console:
    """One line a record: the level padded to five, the message, key=value pairs."""

    def __init__(self, stream=None, level: str = "INFO", color: bool | None = None):
        self.stream, self.level = stream, level
        self.color = use_color(stream or sys.stderr) if color is None else color
        self._lock = threading.Lock()

    def write(self, level: str, message: str, pairs: list[tuple[str, object]]) -> None:
        if LEVELS[level] < LEVELS[self.level]:
            return
        pad = " " * (5 - len(level))
        head = f"{COLORS[level]}{level}{RESET}{pad}" if self.color else level + pad
        key = (lambda k: f"{DIM}{quoted(k)}={RESET}") if self.color else (lambda k: f"{quoted(k)}=")
        line = " ".join([f"{head} {message}", *(key(k) + quoted(shown(v)) for k, v in pairs)])
        with self._lock:
            (self.stream or sys.stderr).write(line + "\n")


class JsonLines:
    """Appends every record, whatever its level, to a file; its folder is made."""

    def __init__(self, path: str):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        self._file, self._lock = open(path, "a", encoding="utf-8"), threading.Lock()  # noqa: SIM115

    def write(self, level: str, message: str, pairs: list[tuple[str, object]]) -> None:
        row: dict = {"time": datetime.now(UTC).isoformat(), "level": level, "msg": message}
        for key, value in pairs:
            *groups, last = key.split(".")
            at = row
            for g in groups:
                at = at.setdefault(g, {})
            at[last] = value
        with self._lock:
            self._file.write(json.dumps(row, ensure_ascii=False, default=str) + "\n")
            self._file.flush()

    def close(self) -> None:
        self._file.close()


class Logger:
    def __init__(self, *handlers, pairs: tuple = (), prefix: str = ""):
        self.handlers, self._pairs, self._prefix = list(handlers), pairs, prefix

    def bind(self, **values) -> Logger:
        return Logger(*self.handlers, pairs=(*self._pairs, *flat(values.items(), self._prefix)), prefix=self._prefix)

    def group(self, name: str) -> Logger:
        return Logger(*self.handlers, pairs=self._pairs, prefix=f"{self._prefix}{name}." if name else self._prefix)

    def log(self, level: str, message: str, pairs=()) -> None:
        every = [*self._pairs, *flat(pairs, self._prefix)]
        for h in self.handlers:
            h.write(level, message, every)

    def debug(self, message: str, **values) -> None:
        self.log("DEBUG", message, values.items())

    def info(self, message: str, **values) -> None:
        self.log("INFO", message, values.items())

    def warning(self, message: str, **values) -> None:
        self.log("WARN", message, values.items())

    def error(self, message: str, **values) -> None:
        self.log("ERROR", message, values.items())
