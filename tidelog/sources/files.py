"""File access from inside tasks, for the few places that need part of a file or a chosen name."""

from __future__ import annotations

import re

from pyarrow import fs as arrow_fs


def resolve(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a Spark path; local paths may hold any character."""
    local = re.match(r"^(?:file:)?/+(.*)$", uri)
    if local:
        return arrow_fs.LocalFileSystem(), "/" + local.group(1)
    return arrow_fs.FileSystem.from_uri(uri)


def line_at(uri: str, number: int, encoding: str, step: int = 1 << 16) -> str | None:
    """Line ``number`` (from 0) of a file, reading no further than needed; None when there is none."""
    system, path = resolve(uri)
    data = b""
    with system.open_input_stream(path) as stream:
        while data.count(b"\n") <= number:
            block = stream.read(step)
            if not block:
                break
            data += block
    lines = data.splitlines()
    return lines[number].decode(encoding) if len(lines) > number else None


def is_folder(uri: str) -> bool:
    system, path = resolve(uri)
    return system.get_file_info(path).type == arrow_fs.FileType.Directory


def remove(uri: str) -> bool:
    """Delete a folder if it is there."""
    system, path = resolve(uri)
    if system.get_file_info(path).type != arrow_fs.FileType.Directory:
        return False
    system.delete_dir(path)
    return True
