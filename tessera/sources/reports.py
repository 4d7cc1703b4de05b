"""A transactional sink: one file a report, none of a failed task visible."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _at(path: str):
    """A file system that executors and driver reach alike, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: a folder of its own, and the names in it."""

    folder: str
    names: list[str] = field(default_factory=list)


class ReportWriter(DataSourceWriter):
    """Tasks write to folders of their own below a hidden one; only the driver's commit moves files to where readers look."""

    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), f"_staged-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Staged:
        files, root = _at(self.path)
        out = Staged(f"{root}/{self.job}/{uuid.uuid4().hex}")
        files.create_dir(out.folder, recursive=True)
        for row in rows:
            if not row.name or "/" in row.name or row.name.startswith((".", "_")):
                raise ValueError(f"no name for a report: {row.name!r}")
            with files.open_output_stream(f"{out.folder}/{row.name}") as file:
                file.write((row.content or "").encode())
            out.names.append(row.name)
        return out

    def commit(self, messages: list) -> None:
        files, root = _at(self.path)
        names = [n for m in messages if m for n in m.names]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("two reports have one name")
        for message in filter(None, messages):
            for name in message.names:
                files.move(f"{message.folder}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """Takes away the hidden folder with all that is still in it, also of tasks that gave no message; one that is being killed may leave a part of it, which no reader sees."""
        from pyarrow import fs

        files, root = _at(self.path)
        if files.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.job}")


class Reports(DataSource):
    @classmethod
    def name(cls) -> str:
        return "reports"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"])


def save(reports: DataFrame, path: str) -> None:
    """K9: writes (name, content) as files of ``path``; a report of a name that is there takes its place. A failed job leaves no file."""
    spark: SparkSession = reports.sparkSession
    spark.dataSource.register(Reports)
    reports.select("name", "content").write.format("reports").mode("append").save(path)
