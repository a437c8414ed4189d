"""Log lines of the engine: a rotating text file on the driver, and the same messages as columns."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import LEVELS


def sync_op(op: str, path: str, source: str, target: str) -> str:
    return f"SYNC_OP op={op} path={path} src={source} dst={target}"


def conflict(path: str, drives: list[str]) -> str:
    return f"CONFLICT path={path} drives=[{','.join(drives)}]"


def quorum(path: str, winning_hash: str, voters: list[str]) -> str:
    return f"QUORUM_RESOLUTION path={path} winning_hash={winning_hash} voters=[{','.join(voters)}]"


def corruption(path: str, expected: str, actual: str) -> str:
    return f"CORRUPTION path={path} expected={expected} actual={actual}"


def error(context: str, message: str) -> str:
    return f"[{context}] {message}"


def sync_op_column(op: Column, path: Column, source: Column, target: Column) -> Column:
    return F.format_string("SYNC_OP op=%s path=%s src=%s dst=%s", op, path, source, target)


class Journal:
    """Writes lines at or above a level; a file that has reached the size is moved aside under a time stamp."""

    def __init__(self, path: str | Path, level: str = "INFO", rotation_size: int = 10 * 1024 * 1024) -> None:
        self.path, self.level, self.rotation_size = Path(path), level, rotation_size

    def write(self, level: str, message: str) -> bool:
        if LEVELS.index(level) < LEVELS.index(self.level):
            return False
        self.path.parent.mkdir(parents=True, exist_ok=True)
        if self.path.exists() and self.path.stat().st_size >= self.rotation_size:
            self.path.rename(self.path.with_name(f"{self.path.stem}.{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}.{time.time_ns() % 10**9}{self.path.suffix}"))
        with self.path.open("a") as out:
            out.write(f"[{time.strftime('%Y-%m-%dT%H:%M:%SZ', time.gmtime())}] [{level}] {message}\n")
        return True


def progress_bar(done: int, total: int, operation: str, width: int = 30) -> str:
    """Percentage rounded down; an operation over 40 characters keeps its last 37."""
    share = 100 * done // total if total else 0
    filled = width * done // total if total else 0
    shown = operation if len(operation) <= 40 else "..." + operation[-37:]
    return f"[{'#' * filled}{'-' * (width - filled)}] {share}% ({done}/{total}) {shown}"
