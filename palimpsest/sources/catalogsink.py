"""A catalog of instruments with its previews, written in two phases: ``df.write.format("law_catalog")``.

Both are nested JSON, an object a line: ``catalog`` has each instrument with its sections in order, ``previews`` each section's
title and pages by its lower-cased id. A task stages its files under a name of its own; only when all have ended does the
driver move the files of the attempts that count into a new version and name it in ``CURRENT``, by a rename. So both
appear together or not at all: readers of the version before aren't disturbed, and a lost task, a second attempt or a
failed job leaves nothing that is read.

Rows (``COLUMNS``) come sorted by instrument, as ``write`` sees to. An instrument is written as its rows come by, so a task holds a
section at a time, however many an instrument has.

Options: ``path``, in a file system that Arrow knows and that all executors share; ``keep``, how many versions stay (2).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

COLUMNS = ("instrument", "title", "source_id", "label", "section_title", "pages")
CATALOG = "id string, title string, sections array<struct<id:string,title:string,text:string>>"
PREVIEWS = "id string, title string, pages array<string>"


@dataclass
class Staged(WriterCommitMessage):
    files: tuple[str, ...]
    instruments: int
    sections: int


def _headline(label: str, title: str, source_id: str) -> str:
    """A section's line in the catalog: what it is called, then what it is about."""
    return " - ".join(x for x in (label, title) if x) or source_id


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.keep = options["path"], int(options.get("keep", 2))
        self.run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def _store(self) -> tuple[FileSystem, str]:
        return FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Row]) -> Staged:
        store, base = self._store()
        task = TaskContext.get()
        folder = f"{base}/_staging/{self.run}/{task.partitionId()}-{task.taskAttemptId()}"
        store.create_dir(folder, recursive=True)
        names = tuple(f"{folder}/{kind}.json" for kind in ("catalog", "previews"))
        instruments = sections = 0
        at = None
        put = lambda out, x: out.write(x.encode())
        dump = lambda x: json.dumps(x, ensure_ascii=False)
        with store.open_output_stream(names[0]) as catalog, store.open_output_stream(names[1]) as previews:
            for row in iterator:
                source, label, about = ((row[c] or "").strip() for c in ("source_id", "label", "section_title"))
                line = _headline(label, about, source)
                if row["instrument"] != at or not instruments:
                    put(catalog, ("]}\n" if instruments else "") + f'{{"id": {dump(row["instrument"])}, "title": {dump(row["title"])}, "sections": [')
                    at, comma = row["instrument"], ""
                    instruments += 1
                put(catalog, comma + dump({"id": source, "title": line, "text": about or label or source}))
                put(previews, dump({"id": source.lower(), "title": line, "pages": list(row["pages"] or [])}) + "\n")
                comma = ", "
                sections += 1
            if instruments:
                put(catalog, "]}\n")
        return Staged(names, instruments, sections)

    def commit(self, messages: list[Staged | None]) -> None:
        store, base = self._store()
        version = f"{base}/versions/{self.run}"
        for kind in ("catalog", "previews"):
            store.create_dir(f"{version}/{kind}", recursive=True)
        for message in filter(None, messages):
            for name in message.files:
                task, kind = name.rsplit("/", 2)[1:]
                store.move(name, f"{version}/{kind.removesuffix('.json')}/{task}.json")
        with store.open_output_stream(f"{base}/CURRENT.{self.run}") as out:
            out.write(self.run.encode())
        store.move(f"{base}/CURRENT.{self.run}", f"{base}/CURRENT")
        store.delete_dir(f"{base}/_staging/{self.run}")
        found = sorted(f.path for f in store.get_file_info(FileSelector(f"{base}/versions")) if f.type == FileType.Directory)
        for old in found[: max(0, len(found) - self.keep)]:
            store.delete_dir(old)

    def abort(self, messages: list[Staged | None]) -> None:
        store, base = self._store()
        if store.get_file_info(f"{base}/_staging/{self.run}").type == FileType.Directory:
            store.delete_dir(f"{base}/_staging/{self.run}")


class LawCatalog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "law_catalog"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if missing := set(COLUMNS) - set(schema.names):
            raise ValueError(f"a catalog needs the columns {sorted(missing)}")
        return _Writer(self.options)


def write(sections: DataFrame, path: str, *order: str, keep: int = 2) -> None:
    """Write sections (``COLUMNS``) as the next version of the catalog at ``path``, an instrument's in the order of the columns
    ``order``. Null instruments are one, with id null."""
    spark = sections.sparkSession
    spark.dataSource.register(LawCatalog)
    dealt = sections.repartition("instrument").sortWithinPartitions(F.col("instrument").asc_nulls_first(), *order)
    rows = dealt.select(*[F.col(c).cast("string") for c in COLUMNS[:-1]], F.col("pages").cast("array<string>"))
    rows.write.format("law_catalog").mode("append").option("path", path).option("keep", keep).save()


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(catalog, previews) of the current version."""
    store, base = FileSystem.from_uri(path)
    with store.open_input_stream(f"{base}/CURRENT") as f:
        version = f.read().decode()
    root = f"{path.rstrip('/')}/versions/{version}"
    return spark.read.schema(CATALOG).json(f"{root}/catalog"), spark.read.schema(PREVIEWS).json(f"{root}/previews")
