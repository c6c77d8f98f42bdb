"""A sink for sheets: CSV files as spreadsheets read them, written by tasks and committed
as a whole.

    spark.dataSource.register(SheetSink)
    rows.write.format("souk_sheet").option("path", folder).mode("append").save()

Each task writes files of its own under a name of its attempt, in chunks of ``CHUNK`` rows:
a byte order mark, the header, rows by RFC 4180 with CRLF. The commit gives the files of
the attempts that count their names, ``sheet-<write>-<part>.csv``; what other attempts left
goes, and an aborted write leaves nothing. ``mode("overwrite")`` drops earlier sheets at
the commit, ``append`` adds to them. Columns must be text; null is an empty cell. The folder
is one that all machines see.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

#: Fixed value: rows of a chunk.
CHUNK = 500


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str | None  # null: the task had no rows
    rows: int


class SheetSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "souk_sheet"

    def writer(self, schema: StructType, overwrite: bool) -> SheetWriter:
        if any(not isinstance(f.dataType, StringType) for f in schema):
            raise ValueError("a sheet holds text alone")
        return SheetWriter(self.options["path"], schema.names, overwrite)


class SheetWriter(DataSourceWriter):
    def __init__(self, path: str, header: list[str], overwrite: bool):
        self.path, self.header, self.overwrite, self.key = path, header, overwrite, uuid.uuid4().hex

    def _folder(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, folder = self._folder()
        context = TaskContext.get()
        part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        name, sink, n = f"_{self.key}/{part}-{attempt}-{uuid.uuid4().hex}", None, 0
        buffer = io.StringIO(newline="")
        out = csv.writer(buffer, lineterminator="\r\n")

        def flush() -> None:
            sink.write(buffer.getvalue().encode())
            buffer.seek(0)
            buffer.truncate()

        for row in iterator:
            if sink is None:
                fs.create_dir(f"{folder}/_{self.key}")
                sink = fs.open_output_stream(f"{folder}/{name}", compression=None)
                buffer.write("﻿")
                out.writerow(self.header)
            out.writerow(["" if v is None else v for v in row])
            n += 1
            if n % CHUNK == 0:
                flush()
        if sink is not None:
            flush()
            sink.close()
        return Written(part, name if sink is not None else None, n)

    def _sheets(self) -> list[str]:
        fs, folder = self._folder()
        found = fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
        return sorted(f.path for f in found if f.base_name.startswith("sheet-"))

    def commit(self, messages: list[Written | None]) -> None:
        """Names what counts. Sheets of earlier writes go last, so that a failed commit loses none."""
        fs, folder = self._folder()
        before = self._sheets()
        number = 1 + max((int(p.rsplit("sheet-", 1)[1].split("-")[0]) for p in before), default=0)
        fs.create_dir(folder)
        for message in messages:
            if message is not None and message.name is not None:
                fs.move(f"{folder}/{message.name}", f"{folder}/sheet-{number:06d}-{message.part:06d}.csv")
        self._clear()
        for place in before if self.overwrite else []:
            fs.delete_file(place)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, folder = self._folder()
        if fs.get_file_info(f"{folder}/_{self.key}").type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(f"{folder}/_{self.key}")
