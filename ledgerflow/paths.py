"""Which paths a job may read: checked on the driver before Spark opens anything."""

from __future__ import annotations

import re

_DEVICES = re.compile(r"(?i)^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\.|$)")


def is_nonlocal(path: str) -> bool:
    """Network shares and devices of Windows, and file URLs with a host."""
    plain = path.strip().replace("/", "\\")
    return plain.startswith("\\\\") or bool(_DEVICES.match(plain.rpartition("\\")[2])) or bool(re.match(r"(?i)^file://(?!/|localhost/)[^/]+", path.strip()))


def checked(path: str, allow_nonlocal: bool = False) -> str:
    if not path or not path.strip():
        raise ValueError("a path is needed")
    if "\0" in path:
        raise ValueError("a path has no null characters")
    if not allow_nonlocal and is_nonlocal(path):
        raise ValueError(f"not a local path: {path!r}")
    return re.sub(r"(?i)^file://localhost/", "file:///", path.strip())
