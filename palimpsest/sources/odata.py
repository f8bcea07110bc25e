"""Recorded answers of an OData service as a table: ``spark.read.format("odata")``.

A record is a folder with a JSON file a page, as the service gave it: {"value": [entities], "odata.nextLink": ...}. Options:

* ``path``: the folder, in a file system that Arrow knows (local, HDFS, S3, ...) and that driver and executors share; all
  files below it are pages, but for hidden ones.
* ``entity``: its name; ``fields``: a schema (DDL) of what is wanted of it; nested entities are structs or arrays of structs,
  and only those of ``expand`` are read, as the service gives no others.
* ``filter``, ``orderby``, ``top`` are arguments of ``query``, which lets Spark put the pages' rows in order: a reader's pages know nothing of
  each other.

Comparisons that Spark pushes down are answered by the reader: a page is read as JSON and only its fitting entities
become rows. A page whose path states a range of a whole-number field (``id=1..100.json``, or a folder ``id=1..100``) isn't
opened where a filter excludes that range. A page that can't be read or isn't the service's JSON gives one row with its ``problem`` and nulls, unless rows
are filtered by something a null can't fit.

As a stream, pages are offsets in the order of their names; each is read once, and new ones as they come.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringStartsWith,
)
from pyspark.sql.types import ArrayType, StructType

_RANGE = re.compile(r"(\w+)=(-?\d+)\.\.(-?\d+)(?:\.json$|/)")
_TERM = re.compile(r"\s*(\w+)\s+(eq|ne|gt|ge|lt|le)\s+('(?:[^']|'')*'|datetime'[^']*'|-?\d+(?:\.\d+)?|true|false|null)\s*")
_CALL = re.compile(r"\s*(startswith|substringof)\(\s*('(?:[^']|'')*'|\w+)\s*,\s*('(?:[^']|'')*'|\w+)\s*\)\s*(?:eq true)?\s*")
_SQL = {"eq": "=", "ne": "<>", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}
_TESTS = {
    EqualTo: lambda x, v: x == v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: x in v,
    StringStartsWith: lambda x, v: x.startswith(v),
    StringContains: lambda x, v: v in x,
}


def condition(text: str):
    """A $filter as a column: comparisons, ``startswith`` and ``substringof``, joined by ``and``."""
    out = F.lit(True)
    for part in re.split(r"\s+and\s+(?=(?:[^']*'[^']*')*[^']*$)", text.strip()):
        if m := _TERM.fullmatch(part):
            field, op, value = m.groups()
            if value == "null":
                out = out & (F.col(field).isNull() if op == "eq" else F.col(field).isNotNull())
                continue
            said = value[len("datetime") :] if value.startswith("datetime") else value
            out = out & F.expr(f"{field} {_SQL[op]} " + _literal(said))
        elif m := _CALL.fullmatch(part):
            name, a, b = m.groups()
            field, value = (a, b) if name == "startswith" else (b, a)
            held = F.lit(value[1:-1].replace("''", "'"))
            out = out & (F.startswith(F.col(field), held) if name == "startswith" else F.contains(F.col(field), held))
        else:
            raise ValueError(f"not a condition that is read here: {part!r}")
    return out


def _literal(value: str) -> str:
    if value.startswith("'"):
        return "'" + value[1:-1].replace("''", "'").replace("\\", "\\\\").replace("'", "\\'") + "'"
    return value


@dataclass
class Page(InputPartition):
    path: str


def _taken(value, kind):
    """A JSON value as the wanted type: structs and arrays of structs by their fields, unlike values as null."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        return tuple(_taken(value.get(f.name), f.dataType) for f in kind.fields) if isinstance(value, dict) else None
    if isinstance(kind, ArrayType):
        return [_taken(v, kind.elementType) for v in value] if isinstance(value, list) else None
    name = kind.typeName()
    if name == "string":
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if name in ("integer", "long", "short", "byte"):
        return int(value) if isinstance(value, int) and not isinstance(value, bool) else None
    if name in ("double", "float"):
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    if name == "boolean":
        return value if isinstance(value, bool) else None
    raise ValueError(f"fields can't be of the type {name}")


class _Reading:
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema
        self.expand = {x.strip() for x in options.get("expand", "").split(",") if x.strip()}
        self.filters: list[Filter] = []

    def pages(self) -> list[str]:
        store, path = FileSystem.from_uri(self.options["path"])
        found = store.get_file_info(FileSelector(path, recursive=True))
        return sorted(f.path for f in found if f.type == FileType.File and f.base_name[0] not in "._")

    def excluded(self, path: str) -> bool:
        """The range in a page's name fits no filter."""
        stated = _RANGE.search(path)
        if not stated:
            return False
        field, lo, hi = stated[1], int(stated[2]), int(stated[3])
        for f in self.filters:
            if f.attribute != (field,):
                continue
            v = getattr(f, "value", None)
            if isinstance(f, EqualTo) and not lo <= v <= hi or isinstance(f, In) and not any(lo <= x <= hi for x in v):
                return True
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and hi < v or isinstance(f, (LessThan, LessThanOrEqual)) and lo > v:
                return True
        return False

    def fits(self, row: tuple) -> bool:
        at = {f.name: k for k, f in enumerate(self.schema.fields)}
        for f in self.filters:
            x = row[at[f.attribute[0]]]
            if x is None or not isinstance(f, IsNotNull) and not _TESTS[type(f)](x, f.value):
                return False
        return True

    def read(self, partition: Page) -> Iterator[tuple]:
        try:
            with FileSystem.from_uri(self.options["path"])[0].open_input_stream(partition.path) as f:
                page = json.loads(f.read().decode("utf-8", errors="replace"))
            entities = page["value"] if isinstance(page["value"], list) else [page["value"]]
        except (OSError, ValueError, KeyError, TypeError) as error:
            row = tuple(f"{partition.path.rsplit('/', 1)[1]}: {type(error).__name__}" if f.name == "problem" else None for f in self.schema.fields)
            if self.fits(row):
                yield row
            return
        for entity in entities:
            held = {k: v for k, v in entity.items() if not isinstance(v, (dict, list)) or k in self.expand} if isinstance(entity, dict) else {}
            row = tuple(None if f.name == "problem" else _taken(held.get(f.name), f.dataType) for f in self.schema.fields)
            if self.fits(row):
                yield row


class _Batch(_Reading, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        fields = {f.name: f.dataType for f in self.schema.fields}
        for f in filters:
            path = getattr(f, "attribute", ())
            plain = len(path) == 1 and fields[path[0]].typeName() in ("string", "integer", "long", "double", "boolean")
            if plain and (type(f) in _TESTS or isinstance(f, IsNotNull)):
                self.filters.append(f)
            else:
                yield f  # Spark's own

    def partitions(self) -> list[InputPartition]:
        return [Page(p) for p in self.pages() if not self.excluded(p)]


class _Stream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": len(self.pages())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Page(p) for p in self.pages()[start["pages"] : end["pages"]]]


class ODataRecord(DataSource):
    """``spark.dataSource.register(ODataRecord)`` and ``spark.sql.python.filterPushdown.enabled``; see the module."""

    @classmethod
    def name(cls) -> str:
        return "odata"

    def schema(self) -> str:
        return self.options["fields"] + ", problem string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options, schema)


def query(spark: SparkSession, path: str, fields: str, *, filter: str | None = None, orderby: str | None = None, top: int | None = None, expand: str = "") -> DataFrame:
    """Entities as the service would give them for $filter, $orderby ("a desc, b"), $top and $expand.

    Pages that can't be read are left out here; ``problems`` names them. Filter pushdown to Python sources is a setting of
    the session, off by default, and is switched on.
    """
    spark.dataSource.register(ODataRecord)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("odata").options(path=path, fields=fields, expand=expand).load()
    good = rows.where(F.col("problem").isNull())
    if filter:
        good = good.where(condition(filter))
    if orderby:
        by = [x.strip().split() for x in orderby.split(",")]
        good = good.orderBy(*[F.col(x[0]).desc() if x[1:] == ["desc"] else F.col(x[0]).asc() for x in by])
    if top is not None:
        good = good.limit(top)
    return good


def problems(spark: SparkSession, path: str) -> DataFrame:
    """``problem`` of each page of a record that can't be read."""
    spark.dataSource.register(ODataRecord)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("odata").options(path=path, fields="id long").load().where("problem is not null").select("problem")
