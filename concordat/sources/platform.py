"""What only the driver's machine knows: mounted drives and file permissions."""

from __future__ import annotations

import os
import shutil
import stat
from pathlib import Path

from ..functions.paths import FLAGS

ROOTS = ("/mnt", "/media")


def is_mount_point(path: str) -> bool:
    return os.path.ismount(path)


def is_accessible(path: str) -> bool:
    return os.path.exists(path)


def detect_drives(roots: tuple[str, ...] = ROOTS) -> list[dict]:
    """Mount points below the usual folders, with total and free bytes."""
    found = []
    for root in filter(os.path.isdir, roots):
        for path in sorted({p for depth in ("*", "*/*") for p in Path(root).glob(depth)}):
            if path.is_dir() and is_mount_point(str(path)):
                usage = shutil.disk_usage(path)
                found.append({"hint": path.name, "mount": str(path), "total_bytes": usage.total, "free_bytes": usage.free})
    return found


def get_permissions(path: str) -> dict[str, bool]:
    mode = stat.S_IMODE(os.stat(path).st_mode)
    return {name: bool(mode >> (8 - i) & 1) for i, name in enumerate(FLAGS)}


def set_permissions(path: str, flags: dict[str, bool]) -> None:
    os.chmod(path, sum(1 << (8 - i) for i, name in enumerate(FLAGS) if flags.get(name)))
