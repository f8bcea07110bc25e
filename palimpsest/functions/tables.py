"""Table functions: law documents read in SQL, by lateral joins.

    SELECT d.eli, p.* FROM docs d, LATERAL parse_provisions(d.eli, d.body) p

Such a table function is asked a document at a time. For many documents each has a twin of the body alone that gives a
document's rows as an array, asked for whole batches:

    SELECT d.eli, p.* FROM docs d LATERAL VIEW inline(provisions_in(d.body)) p

Each takes a document's key, of any type, and its body, and hands the key on in its own type: the result's schema follows
from the arguments (``analyze``). The rows are those of the functions in ``lawxml``.

Defined results: a body that is null or not well-formed gives no rows; the body may be binary or text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf
from pyspark.sql.types import BinaryType, DataType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from palimpsest.sources import lawxml

FIELDS: dict[str, tuple[Callable, str]] = {
    "parse_provisions": (lawxml._provisions, "paragraph_id string, paragraph_label string, stk_number int, nr_number int, lineas array<string>"),
    "parse_instructions": (lawxml._instructions, "intro string, act_number string, item_number string, text string, targets array<string>, italic_spans array<string>, new_text string, inserted_ids array<string>"),
    "parse_note_lines": (lawxml._lines, "line string"),
}


def table_function(rows_of: Callable[[ElementTree.Element], Iterator[tuple]], fields: str):
    """A table function of (key, body): key, ord (from 0) and the fields. A session must be there to read the fields."""
    wanted = DataType.fromDDL(fields).fields

    class Parsed:
        @staticmethod
        def analyze(key: AnalyzeArgument, body: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(body.dataType, (BinaryType, StringType)):
                raise ValueError(f"a body is binary or text, not {body.dataType.simpleString()}")
            schema = StructType().add("key", key.dataType).add("ord", "integer")
            for field in wanted:
                schema = schema.add(field)
            return AnalyzeResult(schema=schema)

        def eval(self, key, body):
            if body is None:
                return
            try:
                root = ElementTree.fromstring(body if isinstance(body, str) else bytes(body))
            except ElementTree.ParseError:
                return
            for k, row in enumerate(rows_of(root)):
                yield (key, k, *row)

    return udtf(Parsed)


def array_function(rows_of: Callable[[ElementTree.Element], Iterator[tuple]], fields: str):
    """A function of a body: its rows as an array of structs, ord (from 0) and the fields; of bodies that give none, empty."""
    wanted = f"ord int, {fields}"
    names, kinds = zip(*(f.split() for f in wanted.split(", ")), strict=True)
    types = [lawxml._ARROW[k] for k in kinds]

    def parsed(bodies: pa.Array) -> pa.Array:
        if not any(test(bodies.type) for test in (pa.types.is_binary, pa.types.is_large_binary, pa.types.is_string, pa.types.is_large_string)):
            raise ValueError(f"a body is binary or text, not {bodies.type}")
        held: list[tuple] = []
        ends = [0]
        for body in bodies:  # one tree at a time: they may be large
            try:
                held += [(k, *row) for k, row in enumerate(rows_of(ElementTree.fromstring(body.as_py() or b"")))]
            except ElementTree.ParseError:
                pass
            ends.append(len(held))
        columns = zip(*held, strict=True) if held else [()] * len(names)
        rows = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    parsed.__annotations__ = {"bodies": pa.Array, "return": pa.Array}  # as types, not as text
    return arrow_udf(parsed, f"array<struct<{wanted.replace(' ', ':').replace(',:', ',')}>>")


def register(spark: SparkSession) -> None:
    """Make the table functions, and their twins over batches, known to a session's SQL."""
    for name, (rows_of, fields) in FIELDS.items():
        spark.udtf.register(name, table_function(rows_of, fields))
        spark.udf.register(name.removeprefix("parse_") + "_in", array_function(rows_of, fields))
