"""Files copied and removed by plan, on the executors.

A plan is a table of addresses (``operators.assets`` makes plans of paths). A file is written beside its place
under a name of its own and put there by a rename, so a reader sees the old or the new one, and a task
that is made again, or twice at once, leaves one whole file. What fails is a row of the result and
ends nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame

BLOCK = 4 << 20
DONE, SAME, FAILED = "copied", "same", "failed"


def place_of(address: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of an address; a plain path is local."""
    return fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)


def _differ(a: tuple[fs.FileSystem, str], b: tuple[fs.FileSystem, str]) -> bool:
    """Whether two files have other bytes; they are read a block at a time and no further than they agree."""
    sizes = [store.get_file_info(path) for store, path in (a, b)]
    if sizes[1].type != fs.FileType.File or sizes[0].size != sizes[1].size:
        return True
    with a[0].open_input_stream(a[1]) as x, b[0].open_input_stream(b[1]) as y:
        while block := x.read(BLOCK):
            if block != y.read(len(block)):
                return True
    return False


def copied(source: str, target: str) -> tuple[str, int]:
    """(``copied`` or ``same``, bytes) of one file; folders on the way are made."""
    a, b = place_of(source), place_of(target)
    size = a[0].get_file_info(a[1]).size
    if size is None:
        raise FileNotFoundError(source)
    if not _differ(a, b):
        return SAME, size
    b[0].create_dir(b[1].rsplit("/", 1)[0] or "/", recursive=True)
    part = f"{b[1]}.{uuid.uuid4().hex}.part"
    try:
        with a[0].open_input_stream(a[1]) as x, b[0].open_output_stream(part) as y:
            while block := x.read(BLOCK):
                y.write(block)
        b[0].move(part, b[1])
    except BaseException:
        if b[0].get_file_info(part).type == fs.FileType.File:
            b[0].delete_file(part)
        raise
    return DONE, size


def _each(rows: DataFrame, names: tuple[str, ...], one, ddl: str) -> DataFrame:
    kinds = [pa.string()] * len(names) + [pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in zip(*[b.column(n).to_pylist() for n in names], strict=True):
                try:
                    out.append((*row, *one(*row), None))
                except Exception as error:  # noqa: BLE001  a file's failure is a row
                    out.append((*row, FAILED, None, f"{type(error).__name__}: {error}"[:600]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], [*names, "action", "bytes", "error"])

    return rows.select(*names).mapInArrow(run, ddl)


def copy_files(plan: DataFrame) -> DataFrame:
    """source, target, action (``copied``, ``same``, ``failed``), bytes, error of each row of ``plan`` (source, target).

    Lazy: the copies are made when the result is written. Several sources of one target would take turns; plans of
    ``slim_plan`` and ``copy_plan`` have none. Repeated rows copy once, as the second finds the same bytes.
    """
    return _each(plan, ("source", "target"), copied, "source string, target string, action string, bytes long, error string")


def remove_files(plan: DataFrame) -> DataFrame:
    """path, action (``removed``, ``gone``, ``failed``), bytes, error of each row of ``plan`` (path). Folders are not removed."""

    def one(path: str) -> tuple[str, int | None]:
        store, own = place_of(path)
        info = store.get_file_info(own)
        if info.type == fs.FileType.NotFound:
            return "gone", None
        if info.type != fs.FileType.File:
            raise IsADirectoryError(path)
        store.delete_file(own)
        return "removed", info.size

    return _each(plan, ("path",), one, "path string, action string, bytes long, error string")
