"""A streaming source that numbers events as they arrive: files with a JSON array of events each, in a folder.

New files are taken up in the order of their modification times and names. What was taken up, with the number
of each file's first event, is written to a journal before it is read, so that `seq` is dense, grows from
file to file, and is the same after a restart. Planning counts the events of new files; the files themselves
are read by the executors, one task a file. Folder and journal can be in any file system that pyarrow opens by
its URI, and have to be visible to all machines.

    spark.dataSource.register(NumberedEvents)
    raw = spark.readStream.format("numbered_events").option("path", folder).option("journal", journal).load()

Options: path, journal, max_files (a batch; 1000 if not given).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .telemetry import RAW


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


def events_of(text: bytes, name: str) -> list[dict]:
    """The array in a file; numbers stay as they are written."""
    found = json.loads(text, parse_float=str, parse_int=str, parse_constant=str)
    if not isinstance(found, list) or not all(isinstance(e, dict) for e in found):
        raise ValueError(f"not a JSON array of events: {name}")
    return found


def row_of(event: dict, seq: int) -> tuple:
    """An event as a row of RAW: values of other types become text."""
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    readings = event.get("readings")
    return (text(event.get("sensor_id")), text(event.get("timestamp")), {k: text(v) for k, v in readings.items()} if isinstance(readings, dict) else None, text(event.get("source")), text(event.get("metadata")), seq)


class Journal:
    """Numbered entries (file, first seq, events), written once and never changed."""

    def __init__(self, path: str):
        self.fs, self.path = _open(path)

    def entries(self) -> list[dict]:
        from pyarrow import fs

        found = [f.path for f in self.fs.get_file_info(fs.FileSelector(self.path, allow_not_found=True)) if f.path.endswith(".json")]
        return [e for f in sorted(found) for e in json.loads(self.fs.open_input_stream(f).read())]

    def add(self, known: int, new: list[dict]) -> None:
        """Add entries after the first `known`; they are there at once or not at all."""
        self.fs.create_dir(self.path, recursive=True)
        name = f"{self.path}/{known:012d}"
        with self.fs.open_output_stream(f"{name}.tmp") as out:
            out.write(json.dumps(new).encode())
        self.fs.move(f"{name}.tmp", f"{name}.json")


class File(InputPartition):
    def __init__(self, name: str, first: int):
        self.name, self.first = name, first


class Reader(DataSourceStreamReader):
    """Offsets are numbers of journal entries."""

    def __init__(self, options: dict):
        self.folder, self.journal, self.most = options["path"], options["journal"], int(options.get("max_files", 1000))

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        journal = Journal(self.journal)
        known = journal.entries()
        names = {e["file"] for e in known}
        files, folder = _open(self.folder)
        there = [f for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.path.endswith(".json") and f.base_name not in names]
        first = known[-1]["first"] + known[-1]["events"] if known else 0
        new = []
        for f in sorted(there, key=lambda f: (f.mtime_ns or 0, f.base_name))[: self.most]:
            n = len(events_of(files.open_input_stream(f.path).read(), f.base_name))
            new.append({"file": f.base_name, "first": first, "events": n})
            first += n
        if new:
            journal.add(len(known), new)
        return {"files": len(known) + len(new)}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(e["file"], e["first"]) for e in Journal(self.journal).entries()[start["files"] : end["files"]]]

    def read(self, partition: File) -> Iterator[tuple]:
        files, folder = _open(self.folder)
        for k, e in enumerate(events_of(files.open_input_stream(f"{folder}/{partition.name}").read(), partition.name)):
            yield row_of(e, partition.first + k)


class NumberedEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "numbered_events"

    def schema(self) -> str:
        return RAW

    def streamReader(self, schema: StructType) -> Reader:
        return Reader(self.options)
