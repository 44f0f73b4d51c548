"""Small single files (reports, sidecars, model descriptors).

Bulk data is always written by Spark tasks; these helpers write one small
document from the driver through pyarrow's filesystem layer, which speaks
local paths, HDFS and object stores alike.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyarrow import fs as pafs


def filesystem_for(path: str):
    """``(filesystem, inner_path)`` for local paths, ``file:`` URIs (one or
    three slashes), HDFS and object-store URIs."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    elif "://" not in path:
        path = "file://" + path
    return pafs.FileSystem.from_uri(path)


_fs = filesystem_for


def write_text(path: str, text: str, overwrite: bool = False) -> None:
    filesystem, inner = _fs(path)
    info = filesystem.get_file_info(inner)
    if info.type != pafs.FileType.NotFound and not overwrite:
        raise FileExistsError(path)
    parent = inner.rsplit("/", 1)[0]
    if parent:
        filesystem.create_dir(parent, recursive=True)
    with filesystem.open_output_stream(inner) as out:
        out.write(text.encode("utf-8"))


def remove_tree(path: str) -> None:
    """Delete a folder and all below it, if it is there."""
    filesystem, inner = _fs(path)
    if filesystem.get_file_info(inner).type == pafs.FileType.Directory:
        filesystem.delete_dir(inner)


def write_once(path: str, chunks) -> None:
    """Stream ``chunks`` of bytes to ``path``: under a name of its own first, then
    renamed, so that a repeated or parallel attempt of the same task replaces
    the file and never adds a second one."""
    filesystem, inner = _fs(path)
    filesystem.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    folder, name = inner.rsplit("/", 1)
    partial = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with filesystem.open_output_stream(partial) as out:
        for chunk in chunks:
            out.write(chunk)
    filesystem.move(partial, inner)


def write_json(path: str, payload: Any, overwrite: bool = False) -> None:
    write_text(path, json.dumps(payload, ensure_ascii=False, indent=2, default=str), overwrite)


def read_text(path: str) -> str:
    filesystem, inner = _fs(path)
    with filesystem.open_input_stream(inner) as src:
        return src.read().decode("utf-8")
