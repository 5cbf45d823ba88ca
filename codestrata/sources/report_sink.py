"""Reports as a data source writer: committed as a whole, named by run id and prefix.

    spark.dataSource.register(ReportSink)
    rows.write.format("report").option("kind", "json").option("run", "r1").mode("append").save(folder)

Tasks write part files of their own into a hidden folder of the attempt; the
commit adds head and tail, lists the parts and renames the folder to its name.
Readers see the complete report of a run or none, also when tasks or the whole run
were repeated.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from codestrata.session import ship_package

KINDS = ("json", "xml", "txt")
MANIFEST = "_COMMITTED"


def report_name(run: str, kind: str, prefix: str = "") -> str:
    """Name of a report: ``prompt_<run>.<kind>``, with a prefix ``<prefix>_prompt_<run>.<kind>``."""
    if kind not in KINDS:
        raise ValueError(f"unknown report format: {kind}")
    for label, text in (("run", run), ("prefix", prefix)):
        if re.search(r"[/\\\0]", text) or text.startswith((".", "_")) or (label == "run" and not text):
            raise ValueError(f"{label} {text!r} can't be part of a name")
    return f"{prefix + '_' if prefix else ''}prompt_{run}.{kind}"


def _plain(value: object) -> object:
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, bytes):
        return value.hex()
    return value


def _xml(name: str, value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, list):
        return "".join(_xml(name, v) for v in value)
    body = "".join(_xml(k, v) for k, v in value.items()) if isinstance(value, dict) else escape(_shown(value))
    return f"<{name}>{body}</{name}>"


def _shown(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    # XML has no form for other control characters
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "\N{REPLACEMENT CHARACTER}", str(_plain(value)))


def _line(kind: str, row: dict) -> str:
    if kind == "json":
        return "," + json.dumps(row, default=_plain, ensure_ascii=False) + "\n"
    if kind == "xml":
        return _xml("row", row) + "\n"
    return (row["text"] or "") + "\n"


@dataclass
class _Part(WriterCommitMessage):
    file: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.root, self.kind = options["path"].rstrip("/"), options.get("kind", "txt")
        self.run, self.prefix = options["run"], options.get("prefix", "")
        self.name = report_name(self.run, self.kind, self.prefix)
        self.attempt = f".{self.name}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = fs.FileSystem.from_uri(self.root)
        store.create_dir(f"{base}/{self.attempt}")
        context = TaskContext.get()
        # a repeated task writes another file; only the committed one is listed
        file = f"part-{context.partitionId():08d}-{context.taskAttemptId()}"
        n = 0
        with store.open_output_stream(f"{base}/{self.attempt}/{file}") as f:
            for batch in iterator:
                n += batch.num_rows
                f.write("".join(_line(self.kind, row) for row in batch.to_pylist()).encode())
        return _Part(file, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.root)
        here, there = f"{base}/{self.attempt}", f"{base}/{self.name}"
        store.create_dir(here)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.file)
        listed = {m.file for m in parts if m.rows}
        for x in store.get_file_info(fs.FileSelector(here)):
            if x.base_name not in listed:
                store.delete_file(x.path)
        about = {"run": self.run, "prefix": self.prefix, "rows": sum(m.rows for m in parts)}
        if self.kind == "json":
            head, tail = "[" + json.dumps(about) + "\n", "]\n"
        elif self.kind == "xml":
            head = f'<?xml version="1.0" encoding="UTF-8"?>\n<report run={quoteattr(self.run)} prefix={quoteattr(self.prefix)} rows="{about["rows"]}">\n'
            tail = "</report>\n"
        else:
            head = tail = ""
        files = [m.file for m in parts if m.rows]
        for file, text in (("part-", head), ("part-~", tail)):
            if text:
                with store.open_output_stream(f"{here}/{file}") as f:
                    f.write(text.encode())
        if head:
            files = ["part-", *files, "part-~"]
        with store.open_output_stream(f"{here}/{MANIFEST}") as f:
            f.write(json.dumps({**about, "files": files}).encode())
        old = f"{base}/.{self.name}-old-{uuid.uuid4().hex}"
        if store.get_file_info(there).type == fs.FileType.Directory:
            store.move(there, old)
        store.move(here, there)
        if store.get_file_info(old).type == fs.FileType.Directory:
            store.delete_dir(old)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.root)
        if store.get_file_info(f"{base}/{self.attempt}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.attempt}")


class ReportSink(DataSource):
    """Options: path, kind (json, xml, txt), run, prefix. ``txt`` takes a column ``text``."""

    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if self.options.get("kind", "txt") == "txt" and "text" not in schema.fieldNames():
            raise ValueError("a txt report needs a column text")
        return _Writer(self.options)


def commit_report(rows: DataFrame, kind: str, folder: str, run: str, prefix: str = "", order: list[str] = ()) -> str:
    """Write ``rows`` as one report in the given order; returns its location.

    Many tasks write; the parts in name order (head and tail among them) are the
    document. Running it again with the same run id replaces the report by a
    complete one; other runs and prefixes are left alone.
    """
    spark = rows.sparkSession
    ship_package(spark)
    spark.dataSource.register(ReportSink)
    name = report_name(run, kind, prefix)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    if kind == "txt":
        placed = placed.select("text")
    placed.write.format("report").options(path=folder, kind=kind, run=run, prefix=prefix).mode("append").save()
    return f"{folder.rstrip('/')}/{name}"


def committed_parts(location: str) -> list[str]:
    """Files of a committed report in order."""
    store, base = fs.FileSystem.from_uri(location)
    with store.open_input_stream(f"{base.rstrip('/')}/{MANIFEST}") as f:
        return [f"{location.rstrip('/')}/{x}" for x in json.loads(f.read())["files"]]
