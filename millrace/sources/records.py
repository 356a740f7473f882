"""Record files: 16 bytes (checkpoint, end of data), then (int32 length, UTF-8 text) of each record. Read and written by
tasks through pyarrow's file systems, so any shared store that these know will do; read as a table or as a stream, and
written by exports that go on where the last one ended."""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

HEADER = struct.Struct("<qq")
#: The checkpoint of files that no export wrote.
NONE = -1
#: A task begins another file beyond so many bytes, which is what it holds.
FILE_BYTES = 1 << 26


def _store(path: str):
    """(file system, path in it) of a URI or a path of this machine."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _record_files(path: str) -> list[tuple[str, int, int]]:
    """(file, checkpoint, end of data) of all finished record files of a file or folder, sorted."""
    from pyarrow import fs

    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        return []
    found = [info] if info.type == fs.FileType.File else [x for x in store.get_file_info(fs.FileSelector(at, recursive=True)) if x.path.endswith(".rec") and "/_draft-" not in x.path]
    out = []
    for x in sorted(found, key=lambda x: x.path):
        with store.open_input_file(x.path) as file:
            out.append((x.path, *HEADER.unpack(file.read(16))))
    return out


class _Part(InputPartition):
    def __init__(self, path: str, file: str):
        self.path, self.file = path, file


def _records(part: _Part) -> Iterator[tuple[str, int, str]]:
    store, _ = _store(part.path)
    with store.open_input_file(part.file) as file:
        _, end = HEADER.unpack(file.read(16))
        seq = 0
        while file.tell() < end:
            (size,) = struct.unpack("<i", file.read(4))
            yield part.file, seq, file.read(size).decode()
            seq += 1


class RecordFiles(DataSource):
    """Option path: a file or folder; a file is a partition. As a stream it gives the exports (files with a checkpoint), in
    whole commits; the offset is the checkpoint up to which they were read."""

    @classmethod
    def name(cls) -> str:
        return "record_file"

    def schema(self) -> str:
        return "file string, seq bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return _RecordReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _RecordStream(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _RecordWriter(self.options["path"], int(self.options.get("checkpoint", NONE)))


class _RecordReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Part]:
        return [_Part(self.path, x) for x, _, _ in _record_files(self.path)]

    def read(self, partition: _Part | None) -> Iterator[tuple[str, int, str]]:
        return _records(partition) if partition is not None else iter(())  # Spark asks once where there are no files


class _RecordStream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"upto": NONE}

    def latestOffset(self) -> dict:
        return {"upto": max((c for _, c, _ in _record_files(self.path)), default=NONE)}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        return [_Part(self.path, x) for x, c, _ in _record_files(self.path) if start["upto"] < c <= end["upto"]]

    def read(self, partition: _Part) -> Iterator[tuple[str, int, str]]:
        return _records(partition)

    def commit(self, end: dict) -> None:
        pass


class _RecordWriter(DataSourceWriter):
    """Tasks write into a draft folder. The commit renames it as a whole: to part-..., or upto-<checkpoint>, of which there is
    one only, so an export that is tried again can't be there twice."""

    def __init__(self, path: str, checkpoint: int):
        self.path, self.checkpoint, self.draft = path, checkpoint, f"_draft-{uuid.uuid4().hex}"

    def write(self, rows) -> WriterCommitMessage:
        store, at = _store(self.path)
        store.create_dir(f"{at}/{self.draft}", recursive=True)
        message = WriterCommitMessage()
        message.files = []
        body = bytearray()

        def flush() -> None:
            name = f"{uuid.uuid4().hex}.rec"
            with store.open_output_stream(f"{at}/{self.draft}/{name}") as file:
                file.write(HEADER.pack(self.checkpoint, 16 + len(body)))
                file.write(bytes(body))
            message.files.append(name)
            body.clear()

        for row in rows:
            if row["value"] and row["value"].strip():
                text = row["value"].encode()
                body += struct.pack("<i", len(text)) + text
                if len(body) >= FILE_BYTES:
                    flush()
        if body:
            flush()
        return message

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, at = _store(self.path)
        draft = f"{at}/{self.draft}"
        kept = {x for m in messages if m is not None for x in m.files}
        if not kept:
            return
        for x in store.get_file_info(fs.FileSelector(draft)):  # what tasks that were tried twice have left
            if x.base_name not in kept:
                store.delete_file(x.path)
        name = f"upto-{self.checkpoint:020d}" if self.checkpoint > NONE else f"part-{uuid.uuid4().hex}"
        if store.get_file_info(f"{at}/{name}").type == fs.FileType.NotFound:
            store.move(draft, f"{at}/{name}")
        else:
            store.delete_dir(draft)

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, at = _store(self.path)
        if store.get_file_info(f"{at}/{self.draft}").type != fs.FileType.NotFound:
            store.delete_dir(f"{at}/{self.draft}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordFiles)


def checkpoint(path: str) -> int:
    """The key up to which a folder's exports go, by their headers."""
    return max((c for _, c, _ in _record_files(path)), default=NONE)


def export_new(entities: DataFrame, key: str, path: str) -> int:
    """Appends the entities whose key (a whole number from 0) lies beyond the last export's checkpoint as JSON records, and the
    checkpoint with them. The key up to which all are exported then. A run that dies leaves the folder as it was."""
    register(entities.sparkSession)
    since = checkpoint(path)
    rows = entities.filter(F.col(key) > since)
    last = rows.agg(F.max(key)).first()[0]
    if last is None:
        return since
    values = rows.filter(F.col(key) <= last).select(F.lit("").alias("file"), F.lit(0).cast("bigint").alias("seq"), F.to_json(F.struct(*entities.columns)).alias("value"))
    values.write.format("record_file").mode("append").option("path", path).option("checkpoint", last).save()
    return last
