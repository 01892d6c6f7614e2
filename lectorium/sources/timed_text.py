"""Lecture texts in folders as a data source: read as a table or as a stream of arriving files, exported all or not at all.

    spark.dataSource.register(LectureFiles)
    spark.read.format("lecture_files").load(folder)                  # segments of all files below
    spark.readStream.format("lecture_files").load(folder)            # those of files that arrive
    exports.write.format("lecture_files").mode("overwrite").save(folder)   # columns path, content

Reading gives what ``scan_timed_text`` gives of the same files, line by line, so a file is never held whole. Folders may
lie in any store that Arrow's file systems reach by their address. An export is written to a draft folder; when all tasks
are done it takes the place of the target in one rename, and when one fails for good the draft goes (a task that still writes
then may leave some of it, under a hidden name).
"""

from __future__ import annotations

import io
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, idx int, start double, end double, text string, offset long, ts boolean"
COLUMNS = pa.schema([("path", pa.string()), ("idx", pa.int32()), ("start", pa.float64()), ("end", pa.float64()), ("text", pa.string()), ("offset", pa.int64()), ("ts", pa.bool_())])
TIMED = re.compile(r"^\s*\[(?:(\d+):)?(\d{1,2}):(\d{2})\]\s*(.*)$", re.S | re.A)
#: Bytes of files that a task reads, and segments that it hands on at a time.
TASK_BYTES, ROWS = 64 << 20, 4096


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


def segments(lines: Iterator[str]) -> Iterator[tuple[float, str, bool]]:
    """(start, text, whether it has a time) of each segment, one line at a time.

    A line without a time belongs to the segment before it; those before the first time stand in front of its text, and
    without any time they are one segment from 0.
    """
    front, start, parts = [], None, []
    for line in lines:
        found = TIMED.match(line)
        if not line.strip(" "):
            continue
        if not found:
            (front if start is None else parts).append(line.strip(" "))
            continue
        if start is not None:
            yield start, _joined(front, parts), True
            front = []
        start = 3600 * int(found[1] or 0) + 60 * int(found[2]) + float(found[3])
        parts = [found[4].strip(" ")]
    if start is not None:
        yield start, _joined(front, parts), True
    elif front:
        yield 0.0, "\n".join(front).strip(" "), False


def _joined(front: list[str], parts: list[str]) -> str:
    return " ".join(x for x in (" ".join(front), "\n".join(parts)) if x or parts).strip(" ")


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int, int]]  # path, time of change, bytes


class Folder:
    """The files of a folder, hidden ones and those of exports aside."""

    def __init__(self, path: str):
        self.path = path

    def listed(self) -> list[tuple[str, int, int]]:
        store, root = opened(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        plain = lambda p: not any(x.startswith((".", "_")) for x in p[len(root) :].split("/"))
        return sorted((f.path, f.mtime_ns or 0, f.size) for f in found if f.type == fs.FileType.File and plain(f.path))

    def dealt(self, files: list[tuple[str, int, int]]) -> list[Files]:
        out, held = [], 0
        for f in files:
            if not out or held + f[2] > TASK_BYTES:
                out.append(Files([]))
                held = 0
            out[-1].files.append(f)
            held += f[2]
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        rows: list[tuple] = []
        for path, _, _ in partition.files:
            with store.open_input_stream(path) as raw:
                text = io.TextIOWrapper(io.BufferedReader(raw), encoding="utf-8", errors="replace", newline="\n")
                held, offset = None, 0
                for i, (start, words, ts) in enumerate(segments(line.rstrip("\n").removesuffix("\r") for line in text)):
                    if held is not None:
                        rows.append((*held[:3], start, *held[4:]))
                    held = (path, i, start, start, words, offset, ts)
                    offset += len(words) + 1
                    if len(rows) >= ROWS:
                        yield self._batch(rows)
                        rows = []
                if held is not None:
                    rows.append(held)
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), COLUMNS, strict=True)], schema=COLUMNS)


class TableReader(Folder, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.dealt(self.listed()) or [Files([])]


class ArrivalReader(Folder, DataSourceStreamReader):
    """Files in order of their time of change; an offset is the last one's time and path.

    A file must be put in place whole, by a rename, and not be changed afterwards.
    """

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        time, path = max(((t, p) for p, t, _ in self.listed()), default=(-1, ""))
        return {"time": time, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        at = lambda o: (o["time"], o["path"])
        return self.dealt([f for f in self.listed() if at(start) < (f[1], f[0]) <= at(end)])

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    files: int


class ExportWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        _, root = opened(self.path)
        self.root, self.draft = root, f"{os.path.dirname(root)}/_draft-{uuid.uuid4()}"

    def write(self, rows) -> Written:
        store, _ = opened(self.path)
        attempt, n = f"{self.draft}/{uuid.uuid4()}", 0  # a task that is tried again writes beside its first try
        for row in rows:
            name = os.path.normpath(row.path).lstrip("/")
            if name.startswith(".."):
                raise ValueError(f"{row.path} lies outside the export")
            store.create_dir(os.path.dirname(f"{attempt}/{name}"), recursive=True)
            with store.open_output_stream(f"{attempt}/{name}") as out:
                out.write((row.content or "").encode())
            n += 1
        message = Written(n)
        message.attempt = attempt
        return message

    def commit(self, messages: list) -> None:
        """Put the parts of the tasks that count together and let them take the target's place."""
        store, _ = opened(self.path)
        whole = f"{self.draft}/whole"
        store.create_dir(whole, recursive=True)
        for m in messages:
            if m is None or not m.files:
                continue
            for f in store.get_file_info(fs.FileSelector(m.attempt, recursive=True)):
                if f.type == fs.FileType.File:
                    to = f"{whole}/{f.path[len(m.attempt) + 1 :]}"
                    store.create_dir(os.path.dirname(to), recursive=True)
                    store.move(f.path, to)
        if store.get_file_info(self.root).type != fs.FileType.NotFound:
            if not self.overwrite and store.get_file_info(fs.FileSelector(self.root)):
                self.abort(messages)
                raise ValueError(f"{self.path} is there already")
            store.move(self.root, f"{self.draft}/before")
        store.create_dir(os.path.dirname(self.root), recursive=True)
        store.move(whole, self.root)
        store.delete_dir(self.draft)

    def abort(self, messages: list) -> None:
        store, _ = opened(self.path)
        if store.get_file_info(self.draft).type != fs.FileType.NotFound:
            store.delete_dir(self.draft)


class LectureFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lecture_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TableReader:
        return TableReader(self.options["path"])

    def streamReader(self, schema) -> ArrivalReader:
        return ArrivalReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ExportWriter:
        return ExportWriter(self.options["path"], overwrite)
