"""Data sources of Spark's Python interface: rule files, landed result pages, and two sinks with task and job commits.

Register them once a session (``register``), then use ``spark.read.format("rule_files")``, ``spark.read.format(
"landed_pages")``, ``df.write.format("one_document")`` and ``df.write.format("record_segments")``. Paths are those of any
file system that Arrow knows (a plain path is local). A file or page is a partition.

Both sinks write parts beside the target; the driver's commit makes them visible at once and its abort removes them, so
a failed job leaves what was there before. Committing one document copies the parts in blocks of some MB, in order.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

BLOCK = 4 << 20
#: Pages of a result that are read at most.
PAGE_LIMIT = 8


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _text(path: str) -> str:
    system, own = _system(path)
    with system.open_input_stream(own) as f:
        return f.read().decode("utf-8")


def _listed(path: str, pattern: str) -> list[tuple[str, re.Match]]:
    """Files below a folder (or the file itself) whose name matches, by name."""
    system, own = _system(path)
    info = system.get_file_info(own)
    infos = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(own))
    scheme = path.split("://")[0] if "://" in path else "file"
    found = [(f"{scheme}://{i.path}", re.fullmatch(pattern, i.base_name)) for i in infos if i.type == pafs.FileType.File]
    return sorted(((p, m) for p, m in found if m), key=lambda x: x[0])


@dataclass
class File(InputPartition):
    path: str
    number: int = 0


class Reader(DataSourceReader):
    """Rows of each file."""

    def __init__(self, files: list[File], rows) -> None:
        self.files, self.rows = files, rows

    def partitions(self) -> list[File]:
        return self.files

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is not None:  # Spark asks once even if there are no files
            yield from self.rows(partition)


class RuleFiles(DataSource):
    """YAML or JSON documents of rules: document, name, pos, value (JSON). A list's entries are rows in their order, what
    is no list is one row; numbers stay numbers, in keys too."""

    @classmethod
    def name(cls) -> str:
        return "rule_files"

    def schema(self) -> str:
        return "document string, name string, pos int, value string"

    def reader(self, schema: StructType) -> Reader:
        files = [File(p) for p, _ in _listed(self.options["path"], r".*\.(ya?ml|json)")]

        def rows(file: File) -> Iterator[tuple]:
            import yaml

            stem = re.sub(r"\.[a-z]+$", "", file.path.rsplit("/", 1)[-1])
            for name, value in (yaml.safe_load(_text(file.path)) or {}).items():
                for i, x in enumerate(value if isinstance(value, list) else [value]):
                    yield stem, str(name), i, json.dumps(x, ensure_ascii=False, separators=(",", ":"))

        return Reader(files, rows)


_SPARK = {bool: "boolean", int: "bigint", float: "double", str: "string"}


class LandedPages(DataSource):
    """Items of result pages ``page-<n>.json``, of which the first tells in ``pages`` how many there are; at most ``limit``
    (PAGE_LIMIT) are read. Columns are page, pos and the items' fields, with types as page 1 has them (mixed or nested
    values are JSON text). Order by page and pos to concatenate them."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def _pages(self) -> list[File]:
        found = sorted((int(m[1]), p) for p, m in _listed(self.options["path"], r"page-(\d+)\.json"))
        first = next((p for n, p in found if n == 1), None)
        told = int(json.loads(_text(first)).get("pages") or 1) if first else 0
        most = min(told, int(self.options.get("limit", PAGE_LIMIT)))
        return [File(p, n) for n, p in found if 1 <= n <= most]

    def _fields(self) -> dict[str, str]:
        kinds: dict[str, set] = {}
        for file in self._pages()[:1]:
            for item in json.loads(_text(file.path)).get("items") or []:
                for k, v in item.items():
                    kinds.setdefault(k, set()).update([_SPARK.get(type(v), "json")] if v is not None else [])
        wide = lambda s: "double" if s == {"bigint", "double"} else next(iter(s)) if len(s) == 1 and s != {"json"} else "string"
        return {k: wide(s) for k, s in kinds.items() if k not in ("page", "pos")}

    def schema(self) -> str:
        return ", ".join(["page int", "pos int", *(f"`{k}` {t}" for k, t in self._fields().items())])

    def reader(self, schema: StructType) -> Reader:
        fields = {f.name: f.dataType.simpleString() for f in schema.fields[2:]}

        def cast(value, kind: str):
            if value is None or kind == "string" and isinstance(value, str):
                return value
            if kind == "string":
                return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
            if kind == "double":
                return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None
            return value if _SPARK.get(type(value)) == kind else None

        def rows(file: File) -> Iterator[tuple]:
            for i, item in enumerate(json.loads(_text(file.path)).get("items") or []):
                yield file.number, i, *(cast(item.get(k), t) for k, t in fields.items())

        return Reader(self._pages(), rows)


# ---------------------------------------------------------------- sinks


@dataclass
class Part(WriterCommitMessage):
    path: str
    number: int
    rows: int


class Parts(DataSourceWriter):
    """Tasks write lines to parts of their own attempt; only parts whose task committed count."""

    def __init__(self, path: str) -> None:
        self.path, self.folder = path, f"{path}.{uuid.uuid4().hex}.parts"
        system, own = _system(self.folder)
        system.create_dir(own)

    def line(self, row: Row) -> str:
        """A row of one column is its text; others are JSON."""
        return row[0] if len(row) == 1 else json.dumps(row.asDict(True), ensure_ascii=False, separators=(",", ":"), default=str)

    def write(self, rows: Iterator[Row]) -> Part:
        context = TaskContext.get()
        path = f"{self.folder}/part-{context.partitionId():06}-{context.taskAttemptId()}"
        system, own = _system(path)
        n = 0
        with system.open_output_stream(own) as f:
            for n, row in enumerate(rows, 1):
                f.write(self.line(row).encode("utf-8") + b"\n")
        return Part(path, context.partitionId(), n)

    def abort(self, messages: list) -> None:
        system, own = _system(self.folder)
        system.delete_dir(own)


class DocumentWriter(Parts):
    """``{"app":..,"version":..,"exported_at":..,"cards":[...]}`` in place of what was at the path."""

    def __init__(self, path: str, head: dict) -> None:
        super().__init__(path)
        self.head = head

    def commit(self, messages: list) -> None:
        system, whole = _system(f"{self.folder}/whole")
        _, target = _system(self.path)
        started = False
        with system.open_output_stream(whole) as out:
            out.write((json.dumps(self.head, ensure_ascii=False, separators=(",", ":"))[:-1] + ',"cards":[').encode())
            for part in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number):
                if started:
                    out.write(b",")
                started = True
                with system.open_input_stream(_system(part.path)[1]) as f:
                    held = b""
                    while block := f.read(BLOCK):
                        out.write((held + block[:-1]).replace(b"\n", b","))  # lines are JSON, so line feeds only end them
                        held = block[-1:]
            out.write(b"]}\n")
        system.move(whole, target)
        self.abort(messages)


class SegmentWriter(Parts):
    """The rows as a new segment of a folder, all or none."""

    def commit(self, messages: list) -> None:
        system, own = _system(self.folder)
        kept = {m.path.rsplit("/", 1)[-1] for m in messages if m is not None}
        for info in system.get_file_info(pafs.FileSelector(own)):
            if info.base_name not in kept:  # of attempts that didn't commit
                system.delete_file(info.path)
        target = _system(self.path)[1]
        system.create_dir(target)
        system.move(own, f"{target}/segment-{uuid.uuid4().hex}")


class OneDocument(DataSource):
    """Options: path, app, version, exported_at. Rows of one text column (JSON each) are the cards."""

    @classmethod
    def name(cls) -> str:
        return "one_document"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        o = self.options
        return DocumentWriter(o["path"], {"app": o.get("app", ""), "version": int(o.get("version", 1)), "exported_at": o.get("exported_at", "")})


class RecordSegments(DataSource):
    """Option: path. JSON lines; every write appends a segment."""

    @classmethod
    def name(cls) -> str:
        return "record_segments"

    def writer(self, schema: StructType, overwrite: bool) -> SegmentWriter:
        return SegmentWriter(self.options["path"])


SOURCES = (RuleFiles, LandedPages, OneDocument, RecordSegments)


def register(spark: SparkSession) -> SparkSession:
    for source in SOURCES:
        spark.dataSource.register(source)
    return spark


def rules_of(spark: SparkSession, path: str) -> dict[str, dict[str, list]]:
    """document -> name -> rows, as the files have them now; bounded by the rule files."""
    out: dict[str, dict[str, list]] = {}
    for r in register(spark).read.format("rule_files").option("path", path).load().orderBy("document", "name", "pos").collect():
        out.setdefault(r["document"], {}).setdefault(r["name"], []).append(json.loads(r["value"]))
    return out


def export_document(cards: DataFrame, key: str, path: str, app: str, version: int, exported_at: str) -> None:
    """A backup of all cards in one document, ordered by key."""
    register(cards.sparkSession)
    lines = cards.orderBy(key).select(F.to_json(F.struct(*cards.columns)).alias("value"))
    lines.write.format("one_document").mode("overwrite").option("path", path).option("app", app).option("version", version).option("exported_at", exported_at).save()


def insert(rows: DataFrame, path: str) -> None:
    """Add rows to a folder of segments, or nothing if a task fails."""
    register(rows.sparkSession)
    rows.write.format("record_segments").mode("append").option("path", path).save()
