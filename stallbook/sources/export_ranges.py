"""A splittable reader of chat exports: one export, however large, is read by many tasks.

The partitions of this data source are byte ranges, and a task reads several small files. A range owns the objects that begin in it; it finds its first one by itself: inside a
JSON string every quote is escaped, so a brace that a plain quoted key and a colon follow is never part of a text. Whether that
object is a message or a part of one shows behind its end: an element of the array is followed by a bracket or by a comma and a brace.
The last message is read beyond the end of the range. A task holds one message and one block of bytes.

The files may lie in any store that pyarrow reaches; `chats.read_exports` reads the others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and bytes that are read at once.
RANGE_BYTES, BLOCK_BYTES = 64 << 20, 1 << 20
#: A task reads files of at most this many bytes in all; a file counts some more for being opened, so small files share a task.
TASK_BYTES, OPEN_BYTES = 64 << 20, 1 << 20
_LOOK_BACK = 256
# The keys of an export and of the objects in it.
_KEYS = "info messages date message_count message_count_limit source id user datetime message reply_to type first_name last_name username phone".split()
_OBJECT = re.compile(rb'\{\s*"(' + "|".join(_KEYS).encode() + rb')"\s*:')
_MARK = re.compile(rb'"(?:[^"\\]|\\.)*("?)|[{}]', re.DOTALL)
_INFO = re.compile(rb'"info"\s*:\s*$')
_AFTER = re.compile(rb'\s*(?:\]|,\s*(["{])|(\}))')


class _Bytes:
    """A window over a file that grows at its end and is cut at its start."""

    def __init__(self, file, start: int):
        self.file, self.at, self.data = file, start, b""
        file.seek(start)

    def grow(self) -> bool:
        more = self.file.read(BLOCK_BYTES)
        self.data += more
        return bool(more)

    def cut(self, upto: int) -> None:
        """Forget what lies before an offset, but for a little to look back at."""
        drop = max(0, upto - self.at - _LOOK_BACK)
        self.data, self.at = self.data[drop:], self.at + drop


def _object_end(window: _Bytes, start: int) -> int:
    """Offset behind the object that begins at `start`."""
    depth, at = 0, start
    while True:
        for mark in _MARK.finditer(window.data, at - window.at):
            if mark[0] == b"{":
                depth += 1
            elif mark[0] == b"}":
                depth -= 1
            elif not mark[1]:
                break  # a string that the window cuts
            if depth == 0:
                return window.at + mark.end()
            at = window.at + mark.end()
        if not window.grow():
            raise ValueError(f"the export ends inside the object at byte {start}")


def _is_element(window: _Bytes, end: int) -> bool:
    while not (found := _AFTER.match(window.data, end - window.at)):
        if not window.grow():
            return False
    return found[2] is None and found[1] != b'"'


def objects_of(file, start: int, end: int) -> Iterator[tuple[int, str, bytes]]:
    """(offset, "info" or "message", bytes) of the objects of an export that begin in [start, end)."""
    window = _Bytes(file, max(0, start - _LOOK_BACK))
    at, sure = start, start == 0
    while True:
        found = _OBJECT.search(window.data, max(at - window.at, 0))
        # A match at the very end of the window may be cut off, so the window first reaches behind the place it begins at.
        if not found:
            held = window.at + len(window.data)
            at = max(at, held - _LOOK_BACK)
            window.cut(at)
            if at >= end or not window.grow():
                return
            continue
        place = window.at + found.start()
        if place >= end:
            return
        if found[1] in (b"info", b"messages"):
            at = place + 1  # the export itself: its members follow
            continue
        behind = _object_end(window, place)
        if _INFO.search(window.data, max(0, place - window.at - _LOOK_BACK), place - window.at):
            yield place, "info", window.data[place - window.at : behind - window.at]
        elif sure or _is_element(window, behind):
            yield place, "message", window.data[place - window.at : behind - window.at]
        sure, at = True, behind
        window.cut(at)


class _Ranges(InputPartition):
    """Byte ranges (path, start, end) of one task."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


def dealt(ranges: list[tuple[str, int, int]]) -> list[list[tuple[str, int, int]]]:
    """Ranges in their order, cut into tasks; each range of a file of several has a task of its own."""
    tasks, held = [], TASK_BYTES
    of_file = Counter(path for path, _, _ in ranges)
    for one in ranges:
        cost = one[2] - one[1] + OPEN_BYTES if of_file[one[0]] == 1 else TASK_BYTES
        if held + cost > TASK_BYTES:
            tasks.append([])
            held = 0
        tasks[-1].append(one)
        held += cost
    return tasks


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def partitions(self) -> list[_Ranges]:
        from pyarrow import fs

        system, root = _file_system(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        shown = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
        ranges = [(path, at, min(at + self.size, size)) for path, size in shown for at in range(0, size, self.size)]
        return [_Ranges(task) for task in dealt(ranges)]

    def read(self, partition: _Ranges) -> Iterator[tuple]:
        system, _ = _file_system(self.path)
        for path, start, end in partition.ranges:
            name = path.rsplit("/", 1)[-1]
            with system.open_input_file(path) as file:
                for at, kind, body in objects_of(file, start, end):
                    yield name, at, kind, body.decode()


class ChatExportSource(DataSource):
    """Rows (chat_id: file name, at: byte offset, kind: `info` or `message`, body: JSON) of all exports of a path. Option `rangeBytes`."""

    @classmethod
    def name(cls) -> str:
        return "chat_export"

    def schema(self) -> str:
        return "chat_id string, at bigint, kind string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(self.options)
