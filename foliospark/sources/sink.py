"""A sink that writes rows as files: ``df.write.format("foliospark_files")``, registered by ``register``.

Rows have a ``name`` and ``content`` (bytes or text). Each task writes into a folder of its own attempt under ``_temporary``; what it tells the
driver is that folder and a count. Once all tasks are done, the driver moves the folder of one attempt of each task into place, as
``part-<number>``: one rename a task, whatever the number of files. Other attempts' folders, and all of them if the job fails, are deleted, so a task
that ran twice leaves its files once. Two rows of one name in a task are an error. File systems are those of Arrow (local, HDFS, S3, GCS)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType, StructType


def opened(path: str):
    """Arrow's file system for ``path``, and the path there, as it stands: nothing in it is decoded."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    scheme, colon, rest = path.partition("://")
    if colon and scheme != "file":
        host, _, own = rest.partition("/")
        fs, base = FileSystem.from_uri(f"{scheme}://{host}/")
        return fs, f"{base.rstrip('/')}/{own}"
    return LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


@dataclass
class Written(WriterCommitMessage):
    folder: str
    part: int
    files: int


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        kinds = {f.name: type(f.dataType) for f in schema}
        if kinds.get("name") is not StringType or kinds.get("content") not in (BinaryType, StringType):
            raise ValueError("files need a name (string) and content (binary or string)")
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.job = f"_temporary/{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        fs, root = opened(self.path)
        part = TaskContext.get().partitionId()
        folder, n, names = f"{self.job}/{part}-{uuid.uuid4().hex}", 0, set()
        fs.create_dir(f"{root}/{folder}")
        for row in rows:
            name, content = row["name"], row["content"]
            if not name or "/" in name or name in (".", "..") or name in names:
                raise ValueError(f"no name for a file, or one that is there already: {name!r}")
            names.add(name)
            with fs.open_output_stream(f"{root}/{folder}/{name}") as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            n += 1
        return Written(folder, part, n)

    def commit(self, messages: list) -> None:
        from pyarrow.fs import FileSelector, FileType

        fs, root = opened(self.path)
        if self.overwrite:
            for old in fs.get_file_info(FileSelector(root, allow_not_found=True)):
                if old.type == FileType.Directory and old.base_name.startswith("part-"):
                    fs.delete_dir(old.path)
        own = uuid.uuid4().hex[:8]
        for m in messages:
            if m is not None and m.files:
                fs.move(f"{root}/{m.folder}", f"{root}/part-{m.part:05d}-{own}")
        fs.delete_dir(f"{root}/{self.job}")

    def abort(self, messages: list) -> None:
        from pyarrow.fs import FileType

        fs, root = opened(self.path)
        if fs.get_file_info(f"{root}/{self.job}").type != FileType.NotFound:
            fs.delete_dir(f"{root}/{self.job}")


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "foliospark_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Makes the file sink and the PDF source known to the session."""
    from foliospark.sources.pdf_source import PdfSource

    spark.dataSource.register(FileSink)
    spark.dataSource.register(PdfSource)
    return spark
