"""Verified, resumable copies of source files.

A transport opens a location at an offset; the copy goes to a ``.part`` file that
a later call resumes, and becomes the target only when size and SHA-256 match.
Network transports are the caller's matter; local and file URLs work as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import BinaryIO

from quern.functions.scalar import file_sha256

#: Opens a location at an offset; gives the stream and the offset it really starts at.
Transport = Callable[[str, int], tuple[BinaryIO, int]]


class TransferError(OSError):
    """A copy is not what its identity says."""


@dataclass(frozen=True)
class Identity:
    size: int
    sha256: str


def local_transport(location: str, offset: int) -> tuple[BinaryIO, int]:
    source = Path(location.removeprefix("file://")).open("rb")
    source.seek(offset)
    return source, offset


def identity_of(path: str | Path) -> Identity:
    return Identity(Path(path).stat().st_size, file_sha256(path))


def fetch(location: str, target: str | Path, expected: Identity, transport: Transport = local_transport, block: int = 1 << 20) -> Path:
    """Copy to ``target``; a finished target that matches is left alone.

    A transport that starts elsewhere than asked makes the copy start over. A copy that does
    not match its identity is removed and raises.
    """
    target = Path(target)
    if target.exists() and identity_of(target) == expected:
        return target
    part = target.with_name(target.name + ".part")
    offset = part.stat().st_size if part.exists() else 0
    if offset > expected.size:
        part.unlink()
        offset = 0
    source, start = transport(location, offset)
    with source, part.open("r+b" if start and part.exists() else "wb") as out:
        out.seek(start)
        while data := source.read(block):
            out.write(data)
        out.truncate()
    if identity_of(part) != expected:
        part.unlink()
        raise TransferError(f"{location}: size or SHA-256 differs from {expected}")
    part.replace(target)
    return target
