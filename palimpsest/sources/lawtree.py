"""Law documents as numbered trees: a row a node, so that looking at a part of a document is a filter or an equi-join.

Elements and stretches of text are numbered in document order. A node's descendants are the nodes from ``node`` to
``last``, and ``above`` lists its ancestors from the root on. So a subtree is a range of numbers, which Parquet can skip by
where the rows were saved in order (``save``, ``inside``); and the nodes of many subtrees are an equi-join of ancestors
with units (``subtrees``), whose rows are as many as nodes times their depth, never all pairs of a document.

Defined results: a body that isn't well-formed has no nodes (``lawxml.problems`` names it); empty stretches of text are no
nodes; a unit without text has an empty one; documents of one id are taken as one, so ids are meant to be unique.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.refs import normal_section
from palimpsest.functions.text import visible

SCHEMA = "eli string, node int, last int, depth int, parent int, above array<int>, tag string, attributes map<string,string>, content string"
_KINDS = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
_NAMES = [f.split()[0] for f in SCHEMA.replace("map<string,string>", "map").split(", ")]
SNIPPET = 80


def _numbered(root: ElementTree.Element) -> list[list]:
    """[node, last, depth, parent, above, tag, attributes, content] of each element and text, in document order."""
    rows: list[list] = []
    above: list[int] = []
    stack: list[tuple[ElementTree.Element, Iterator[ElementTree.Element]]] = []

    def add(tag: str | None, attributes: dict | None, content: str | None) -> int:
        n = len(rows)
        rows.append([n, n, len(above), above[-1] if above else None, list(above), tag, attributes and list(attributes.items()), content])
        return n

    def enter(element: ElementTree.Element) -> None:
        above.append(add(element.tag, element.attrib, None))
        stack.append((element, iter(element)))
        if element.text:
            add(None, None, element.text)

    enter(root)
    while stack:
        element, children = stack[-1]
        child = next(children, None)
        if child is not None:
            enter(child)
            continue
        stack.pop()
        rows[above.pop()][1] = len(rows) - 1
        if element.tail and above:
            add(None, None, element.tail)
    return rows


def nodes(docs: DataFrame) -> DataFrame:
    """The nodes of all documents (eli, body): elements have a ``tag`` and ``attributes``, texts their ``content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for eli, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = _numbered(ElementTree.fromstring(body.as_py() or b""))
                except ElementTree.ParseError:
                    continue
                for k in range(0, len(rows), 5000):
                    columns = zip(*([eli, *r] for r in rows[k : k + 5000]), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _KINDS, strict=True)], names=_NAMES)

    return docs.select("eli", "body").mapInArrow(run, SCHEMA)


def _wanted(root: ElementTree.Element, tags: frozenset[str], attributes: dict[str, str]) -> list[list]:
    """[node, last, depth, parent, above, tag, attributes, text] of each wanted element, in document order; the nodes are
    numbered as by ``_numbered``."""
    rows: list[list] = []
    above: list[int] = []
    parts: list[str] = []  # the texts met so far
    stack: list[tuple[ElementTree.Element, Iterator[ElementTree.Element], list | None, int]] = []
    n = 0

    def enter(element: ElementTree.Element) -> None:
        nonlocal n
        row = None
        if element.tag in tags and all(element.get(k) == v for k, v in attributes.items()):
            row = [n, n, len(above), above[-1] if above else None, list(above), element.tag, list(element.items()), ""]
            rows.append(row)
        stack.append((element, iter(element), row, len(parts)))
        above.append(n)
        n += 1
        if element.text:
            parts.append(element.text)
            n += 1

    enter(root)
    while stack:
        element, children, row, start = stack[-1]
        child = next(children, None)
        if child is not None:
            enter(child)
            continue
        stack.pop()
        above.pop()
        if row is not None:
            row[1], row[7] = n - 1, "".join(parts[start:])
        if element.tail and above:
            parts.append(element.tail)
            n += 1
    return rows


def found(docs: DataFrame, tags: Sequence[str], attributes: dict[str, str] | None = None) -> DataFrame:
    """The elements of some tags, and with some attributes' values, as ``nodes`` has them, each with its ``text`` as ``texts``
    has it. They are picked where a document is read: other nodes are neither handed on nor joined, and nothing is shuffled."""
    asked, having = frozenset(tags), dict(attributes or {})
    names = [*_NAMES[:-1], "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*held, strict=True), _KINDS, strict=True)], names=names)

        held: list[list] = []
        for batch in batches:
            for eli, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    root = ElementTree.fromstring(body.as_py() or b"")
                except ElementTree.ParseError:
                    continue
                for row in _wanted(root, asked, having):
                    held.append([eli, *row])
                    if len(held) >= 5000:
                        yield rows(held)
                        held = []
        if held:
            yield rows(held)

    said = docs.select("eli", "body").mapInArrow(run, SCHEMA.replace("content string", "text string"))
    return said.withColumn("text", visible("text"))


def save(tree: DataFrame, folder: str) -> None:
    """Write nodes in the order of documents and numbers, so that ``inside`` reads few row groups."""
    tree.repartitionByRange("eli", "node").sortWithinPartitions("eli", "node").write.parquet(folder)


def inside(tree: DataFrame, eli: str, node: int, last: int) -> DataFrame:
    """One subtree: a range of one document's numbers."""
    return tree.where((F.col("eli") == eli) & F.col("node").between(node, last))


def subtrees(tree: DataFrame, units: DataFrame) -> DataFrame:
    """The nodes of each unit (eli, node), itself included, with the unit's number as ``unit``."""
    own = units.select(F.col("eli").alias("_eli"), F.col("node").alias("unit")).distinct()
    part_of = tree.select("*", F.explode(F.concat("above", F.array("node"))).alias("_of"))
    return part_of.join(own, (F.col("eli") == F.col("_eli")) & (F.col("_of") == F.col("unit"))).drop("_eli", "_of")


def ancestors(tree: DataFrame, found: DataFrame) -> DataFrame:
    """The ancestors of each found node (eli, node, above), from the root on, with its number as ``below``."""
    wanted = found.select(F.col("eli").alias("_eli"), F.col("node").alias("below"), F.explode("above").alias("_at")).distinct()
    return tree.join(wanted, (F.col("eli") == F.col("_eli")) & (F.col("node") == F.col("_at"))).drop("_eli", "_at")


def texts(tree: DataFrame, units: DataFrame) -> DataFrame:
    """eli, node, text: all text in each unit, as the parser has it. A unit is part of a document, so its text is bounded."""
    parts = subtrees(tree, units).where("content is not null").groupBy("eli", F.col("unit").alias("node"))
    joined = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "content"))), lambda x: x["content"]), "").alias("_t"))
    every = units.select("eli", "node").distinct().join(joined, ["eli", "node"], "left")
    return every.select("eli", "node", visible(F.coalesce("_t", F.lit(""))).alias("text"))


def subsections(tree: DataFrame, section: str | None = None) -> DataFrame:
    """eli, node, last, section, stk: the subsections of a section, or of all, each with its number: that of its own label,
    else its place."""
    heads = tree.where("tag = 'Paragraf'").select("eli", F.col("node").alias("_s"), F.upper(F.coalesce(F.col("attributes")["localId"], F.lit(""))).alias("section"))
    if section is not None:
        heads = heads.where(F.col("section") == normal_section(F.lit(section)))
    stks = tree.where("tag = 'Stk'").select("eli", "node", "last", F.explode("above").alias("_s")).join(heads, ["eli", "_s"])
    labels = tree.where("tag = 'Explicatus'").select("eli", F.col("node").alias("_l"), F.col("parent"))
    first = labels.join(stks.select("eli", F.col("node").alias("parent")), ["eli", "parent"]).groupBy("eli", "parent").agg(F.min("_l").alias("node"))
    said = texts(tree, first).join(first, ["eli", "node"]).select("eli", F.col("parent").alias("node"), F.regexp_extract("text", r"Stk\.\s*(\d+)", 1).try_cast("int").alias("_n"))
    place = F.row_number().over(Window.partitionBy("eli", "_s").orderBy("node"))  # a section's subsections
    return stks.withColumn("_place", place).join(said, ["eli", "node"], "left").select("eli", "node", "last", "section", F.coalesce("_n", "_place").alias("stk"))


def outline(tree: DataFrame, section: str, stk: int | None = None) -> DataFrame:
    """eli, stk, node, level, tag, attributes, snippet: what is below each subsection of a section, an element a row, with
    the text of those that hold no other element, cut to eighty characters."""
    asked = subsections(tree, section)
    asked = asked if stk is None else asked.where(F.col("stk") == stk)
    at = asked.select("eli", F.col("node").alias("unit"), "stk")
    below = subtrees(tree, asked).where("tag is not null and node <> unit").join(at, ["eli", "unit"])
    has = below.select("eli", F.col("parent").alias("node")).distinct().withColumn("_has", F.lit(True))
    leaves = below.join(has, ["eli", "node"], "left_anti")
    said = texts(tree, leaves).select("eli", "node", F.left("text", F.lit(SNIPPET)).alias("snippet"))
    top = tree.select("eli", F.col("node").alias("unit"), F.col("depth").alias("_top"))
    rows = below.join(top, ["eli", "unit"]).join(said, ["eli", "node"], "left")
    return rows.select("eli", "stk", "node", (F.col("depth") - F.col("_top")).alias("level"), "tag", "attributes", "snippet")


def blocks(tree: DataFrame, section: str | None = None, stk: int | None = None) -> DataFrame:
    """eli, section, stk, number, text: each block of a section's subsections, numbered from 1."""
    asked = subsections(tree, section)
    asked = asked if stk is None else asked.where(F.col("stk") == stk)
    lines = subtrees(tree, asked).where("tag = 'Linea'").select("eli", "unit", "node")
    numbered = lines.withColumn("number", F.row_number().over(Window.partitionBy("eli", "unit").orderBy("node")))  # a subsection's blocks
    at = asked.select("eli", F.col("node").alias("unit"), "section", "stk")
    return numbered.join(at, ["eli", "unit"]).join(texts(tree, lines), ["eli", "node"]).select("eli", "section", "stk", "number", "text")
