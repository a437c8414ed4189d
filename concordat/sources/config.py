"""Settings as a dataclass, kept in a key=value file."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

LEVELS = ["DEBUG", "INFO", "WARNING", "ERROR"]


def level_name(text: str) -> str | None:
    """DEBUG, INFO, WARNING or ERROR whatever the case, WARN for WARNING; None if it is no level."""
    name = text.strip().upper()
    name = "WARNING" if name == "WARN" else name
    return name if name in LEVELS else None


def split_csv(text: str) -> list[str]:
    return [part.strip() for part in text.split(",") if part.strip()]


@dataclass
class Config:
    manifest_db_name: str = "manifest.db"
    log_file_path: str = "concordat.log"
    exclude_patterns: list[str] = field(default_factory=list)
    quorum_threshold: float = 0.5
    hash_algorithm: str = "sha256"
    cdc_chunk_size: int = 64 * 1024
    large_file_threshold: int = 1024 * 1024
    log_level: str = "INFO"
    log_rotation_size: int = 10 * 1024 * 1024

    def set(self, key: str, value: str) -> bool:
        """Takes over one setting; a bad value or an unknown key warns, changes nothing and gives False."""
        known = {f.name for f in fields(self)}
        if key not in known:
            warnings.warn(f"unknown config key '{key}'", stacklevel=2)
            return False
        try:
            setattr(self, key, _parse(key, value))
        except ValueError as e:
            warnings.warn(f"invalid '{key}' ({e}), using default", stacklevel=2)
            return False
        return True

    def save(self, path: str | Path) -> None:
        path = Path(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        shown = lambda x: ",".join(x) if isinstance(x, list) else str(x)
        path.write_text("# settings\n\n" + "".join(f"{f.name}={shown(getattr(self, f.name))}\n" for f in fields(self)))

    def copy(self) -> Config:
        return replace(self, exclude_patterns=list(self.exclude_patterns))


def _parse(key: str, value: str) -> object:
    value = value.strip()
    if key == "exclude_patterns":
        return split_csv(value)
    if key == "quorum_threshold":
        share = float(value)
        if not 0 < share < 1:
            raise ValueError("must lie between 0 and 1")
        return share
    if key in ("cdc_chunk_size", "large_file_threshold", "log_rotation_size"):
        size = int(value)
        if size <= 0:
            raise ValueError("must be positive")
        return size
    if key == "log_level":
        if (level := level_name(value)) is None:
            raise ValueError("no such level")
        return level
    if not value:
        raise ValueError("empty")
    return value


def load(path: str | Path) -> Config:
    """Comments start with #; lines without = and bad values warn; a missing file gives the defaults."""
    config, path = Config(), Path(path)
    if not path.exists():
        warnings.warn(f"cannot open config '{path}', using defaults", stacklevel=2)
        return config
    for number, line in enumerate(path.read_text().splitlines(), 1):
        line = line.partition("#")[0].strip()
        if not line:
            continue
        key, mark, value = line.partition("=")
        if not mark:
            warnings.warn(f"malformed config line {number}: '{line}'", stacklevel=2)
            continue
        config.set(key.strip(), value.strip())
    return config
