"""Files that tasks stage and the driver publishes, all of them or none.

Every attempt of a task stages its files under names of its own, so a second
attempt cannot touch what the first wrote. The commit of the job publishes what
the successful attempts named: it writes down what it is about to do, moves
files that will be replaced aside, moves the new ones into place, and writes
the manifest last. A move that fails undoes the rest; after a crash
``settle``, which every later publication begins with, undoes or completes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

#: What the last publication put into a folder: its run, and name and points of each file.
MANIFEST = "_manifest.json"
_JOURNAL, _ASIDE = "_publishing-", "_previous-"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the name it has there."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _exists(where: fs.FileSystem, name: str) -> bool:
    return where.get_file_info(name).type != fs.FileType.NotFound


def _store(where: fs.FileSystem, name: str, value) -> None:
    with where.open_output_stream(f"{name}.part") as out:
        out.write(json.dumps(value).encode())
    where.move(f"{name}.part", name)


def _load(where: fs.FileSystem, name: str):
    with where.open_input_stream(name) as file:
        return json.loads(file.read())


def _remove_folder(where: fs.FileSystem, name: str) -> None:
    if where.get_file_info(name).type == fs.FileType.Directory:
        where.delete_dir(name)


def names_in(where: fs.FileSystem, folder: str) -> list[str]:
    return [f.base_name for f in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File]


def manifest(path: str) -> dict | None:
    where, target = located(path)
    return _load(where, f"{target}/{MANIFEST}") if _exists(where, f"{target}/{MANIFEST}") else None


def settle(path: str) -> None:
    """Brings a folder whose publication was cut short to the state before it, or after it if its manifest was written."""
    where, target = located(path)
    for name in names_in(where, target):
        if not name.startswith(_JOURNAL) or not name.endswith(".json"):
            continue
        plan = _load(where, f"{target}/{name}")
        aside = f"{target}/{plan['aside']}"
        if (manifest(path) or {}).get("run") != plan["run"]:
            for old in plan["replaced"]:
                if _exists(where, f"{aside}/{old}"):
                    if _exists(where, f"{target}/{old}"):
                        where.delete_file(f"{target}/{old}")
                    where.move(f"{aside}/{old}", f"{target}/{old}")
            for new in set(plan["names"]) - set(plan["replaced"]):
                if _exists(where, f"{target}/{new}"):
                    where.delete_file(f"{target}/{new}")
        _remove_folder(where, aside)
        where.delete_file(f"{target}/{name}")
    # what was begun before its journal stood, or not cleared away after it went, holds nothing that is missed
    for left in where.get_file_info(fs.FileSelector(target, allow_not_found=True)):
        if left.type == fs.FileType.Directory and left.base_name.startswith(_ASIDE):
            where.delete_dir(left.path)
        elif left.base_name.startswith(_JOURNAL):
            where.delete_file(left.path)


def publish(path: str, temporary: str, staged: Iterable[tuple[str, str, int]], overwrite: bool, kind: str = ".las") -> None:
    """Moves staged files (name, name under which it is staged, points) from ``temporary`` to ``path``; with ``overwrite`` all others of the kind go."""
    staged = list(staged)
    names = [name for name, _, _ in staged]
    if len(set(names)) < len(names):
        raise ValueError("several results would have one name")
    settle(path)
    (where, target), hidden = located(path), located(temporary)[1]
    run = uuid.uuid4().hex
    old = [n for n in names_in(where, target) if n.endswith(kind) and (overwrite or n in set(names))]
    plan = {"run": run, "aside": f"{_ASIDE}{run}", "names": names, "replaced": old}
    where.create_dir(f"{target}/{plan['aside']}", recursive=True)
    _store(where, f"{target}/{_JOURNAL}{run}.json", plan)
    try:
        for name in old:
            where.move(f"{target}/{name}", f"{target}/{plan['aside']}/{name}")
        for name, place, _ in staged:
            where.move(f"{hidden}/{place}", f"{target}/{name}")
        _store(where, f"{target}/{MANIFEST}", {"run": run, "files": [{"name": n, "points": k} for n, _, k in staged]})
    except Exception:
        settle(path)
        raise
    _remove_folder(where, f"{target}/{plan['aside']}")
    where.delete_file(f"{target}/{_JOURNAL}{run}.json")
    _remove_folder(where, hidden)


def move_files(source: str, target: str, kind: str = ".las") -> None:
    """Moves complete files of a folder to another of the same file system, each at once."""
    (where, here), there = located(source), located(target)[1]
    where.create_dir(there, recursive=True)
    for name in sorted(n for n in names_in(where, here) if n.endswith(kind)):
        where.move(f"{here}/{name}", f"{there}/{name}")


@dataclass
class Written(WriterCommitMessage):
    """(name, name under which it is staged, points) of an attempt's files."""

    files: tuple[tuple[str, str, int], ...]


class Publisher(DataSourceArrowWriter):
    """Stages files beside the target and publishes them by the job's commit; with a ``stage`` they wait there for ``publish_staged``."""

    def __init__(self, path: str, overwrite: bool, stage: str = ""):
        self.path, self.overwrite, self.stage = path.removeprefix("file:") if "://" not in path else path, overwrite, stage
        self.temporary = _stage_folder(self.path, stage or uuid.uuid4().hex)

    def _folder(self) -> tuple[fs.FileSystem, str]:
        where, folder = located(self.temporary)
        where.create_dir(folder, recursive=True)
        return where, folder

    def commit(self, messages):
        staged = [f for m in messages if m for f in m.files]
        where, folder = self._folder()
        if self.stage:
            _store(where, f"{folder}/staged.json", staged)
        else:
            publish(self.path, self.temporary, staged, self.overwrite)

    def abort(self, messages):
        where, folder = located(self.temporary)
        _remove_folder(where, folder)


def _stage_folder(path: str, stage: str) -> str:
    return f"{path.rstrip('/')}/_temporary-{stage}"


def publish_staged(path: str, stage: str) -> None:
    where, folder = located(_stage_folder(path, stage))
    publish(path, _stage_folder(path, stage), _load(where, f"{folder}/staged.json"), False)


def discard_staged(path: str, stage: str) -> None:
    where, folder = located(_stage_folder(path, stage))
    _remove_folder(where, folder)


def discard_folder(path: str) -> None:
    _remove_folder(*located(path))
