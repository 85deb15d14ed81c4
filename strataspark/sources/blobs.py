"""A sink for whole files: rows ``name, content`` become files of a folder, on any store that Arrow reaches."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import ship_package

SCHEMA = "name string, content binary"


def open_system(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote(re.sub("^file:/*", "/", path))
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host that Spark would read it with, so that tasks on other machines mean the same place."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def arrow_reaches(path: str) -> bool:
    """Whether byte ranges of files there can be read without Spark."""
    try:
        open_system(path)
        return True
    except Exception:  # a scheme that Arrow does not know, or a library that it lacks
        return False


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Contents go to their files straight from the Arrow batch, no copy of it is made. Tasks write under names of their own, in a folder of the job; the files get their names when all tasks have ended, so a repeated task leaves none twice and two jobs may write to one place."""

    def __init__(self, path: str):
        self.path, self.pending = path.rstrip("/"), f"_pending-{uuid.uuid4().hex}"

    def write(self, iterator):
        system, folder = open_system(self.path)
        pending, files = f"{folder}/{self.pending}", []
        system.create_dir(pending, recursive=True)
        for batch in iterator:
            content = None
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                own = f"{pending}/{uuid.uuid4().hex}"
                with system.open_output_stream(own) as out:
                    if content.is_valid:
                        out.write(content.as_buffer())
                files.append((own, name))
            del batch, content  # before the next one is read
        return _Written(files)

    def commit(self, messages):
        system, folder = open_system(self.path)
        system.create_dir(folder, recursive=True)
        for message in messages:
            for own, name in message.files if message else ():
                system.move(own, f"{folder}/{name}")
        self._clear(system, folder)

    def abort(self, messages):
        self._clear(*open_system(self.path))

    def _clear(self, system, folder):
        from pyarrow import fs

        if system.get_file_info(f"{folder}/{self.pending}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/{self.pending}")


class BlobDataSource(DataSource):
    @classmethod
    def name(cls):
        return "blobs"

    def schema(self):
        return SCHEMA

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """Write ``name, content`` rows as files of a folder. Names must differ; a file with the name of one that is there takes its place."""
    spark = files.sparkSession
    ship_package(spark)
    spark.dataSource.register(BlobDataSource)
    files.select("name", "content").write.format("blobs").mode("append").save(qualified(spark, path))
