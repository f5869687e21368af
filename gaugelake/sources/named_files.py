"""A data source that writes text files under exact names, all or none of them.

Rows are (file, line); those of a file follow one another in one task, as a file is one stream. A
task writes below a folder of its own attempt. The files get their names when all tasks are done;
if one fails for good, the folder goes and nothing is seen; what a task that still ran then writes stays
in a hidden folder. Any file system that Arrow opens will do.
"""

import sys
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

# Ship the writer itself, so that executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "named_files"
SCHEMA = "file STRING, line STRING"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, which may be a plain path or a URI."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, header: str):
        self.path, self.header = path, header
        self.pending = f"{path.rstrip('/')}/_pending-{uuid.uuid4().hex}"

    def write(self, iterator):
        task = TaskContext.get()
        files, folder = opened(f"{self.pending}/{task.partitionId()}-{task.taskAttemptId()}")
        names, stream = [], None
        try:
            for batch in iterator:
                for name, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if not names or name != names[-1]:
                        if not name or "/" in name or name.startswith(("_", ".")):
                            raise ValueError(f"not a file name: {name!r}")
                        if stream:
                            stream.close()
                        if not names:
                            files.create_dir(folder, recursive=True)
                        names.append(name)
                        stream = files.open_output_stream(f"{folder}/{name}")
                        if self.header:
                            stream.write(f"{self.header}\n".encode())
                    stream.write(f"{line}\n".encode())
        finally:
            if stream:
                stream.close()
        return _Written(folder, names)

    def commit(self, messages):
        files, path = opened(self.path)
        files.create_dir(path, recursive=True)
        for message in messages:
            for name in message.names if message else ():
                files.move(f"{message.folder}/{name}", f"{path}/{name}")
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self):
        files, folder = opened(self.pending)
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            files.delete_dir(folder)


class NamedFiles(DataSource):
    """``df.write.format("named_files").option("path", ...).option("header", ...)``"""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], self.options.get("header", ""))


def write_named(lines: DataFrame, path: str, header: str = "") -> None:
    """Write rows (file, line), those of a file together and in order, as files below ``path``.

    A file of that name is replaced. Tied names in two tasks would overwrite each other, so the
    rows must have been dealt out by file.
    """
    lines.sparkSession.dataSource.register(NamedFiles)
    writer = lines.select("file", "line").write.format(FORMAT).mode("append")
    writer.option("path", path).option("header", header).save()
