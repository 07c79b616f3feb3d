"""Whether files are there, on any file system, and where the artifacts of experiments lie."""

from __future__ import annotations

from collections.abc import Mapping


def _info(path: str):  # noqa: ANN202
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return system, inside, system.get_file_info(inside)


def exists(path: str) -> bool:
    """Is there a file or a folder at a path, local or a URI?"""
    from pyarrow import fs

    return _info(path)[2].type != fs.FileType.NotFound


def empty(path: str) -> bool:
    """A file of no bytes, or a folder without files."""
    from pyarrow import fs

    system, inside, info = _info(path)
    return info.size == 0 if info.type == fs.FileType.File else not system.get_file_info(fs.FileSelector(inside, recursive=True))


def names(path: str) -> list[str]:
    """The names of what lies in a folder, in order."""
    from pyarrow import fs

    system, inside, _ = _info(path)
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(inside)))


def read_bytes(path: str) -> bytes:
    """A small file as a whole."""
    system, inside, _ = _info(path)
    with system.open_input_file(inside) as handle:
        return handle.read()


def artifact_path(name: str, *parts: str, root: str, groups: Mapping[str, str] = {}) -> str:  # noqa: B006
    """Folder of an artifact under its group's folder, or a path inside it."""
    group = groups.get(name)
    return "/".join([root.rstrip("/"), *([group] if group else []), name, *parts])


def existing_artifact(name: str, *, root: str, groups: Mapping[str, str] = {}) -> str:  # noqa: B006
    """The artifact's folder, or the one right under the root if only that is there."""
    grouped, flat = artifact_path(name, root=root, groups=groups), artifact_path(name, root=root)
    return flat if not exists(grouped) and exists(flat) else grouped
