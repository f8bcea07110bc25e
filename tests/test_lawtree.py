"""Numbered trees against the parser's own trees."""

from xml.etree import ElementTree

from pyspark.sql import functions as F

from palimpsest.session import new_folder
from palimpsest.sources import lawtree, lawxml

LAW = """<Dokument>  <Paragraf localId="9 A"><Explicatus>§ 9 A.</Explicatus>
 <Stk id="s1"><Exitus><Linea>Første­ <Char formaChar="Italic">punkt</Char>.</Linea><Linea>Andet.</Linea></Exitus></Stk>
 <Stk id="s3"><Explicatus>Stk. 3.</Explicatus><Exitus><Linea>Tredje stk.</Linea><Index><Indentatio formaInd="Nummer"><Explicatus>1)</Explicatus><Exitus><Linea>et nummer,</Linea></Exitus></Indentatio></Index></Exitus></Stk></Paragraf>
 hale <Paragraf localId="9B"><Explicatus>§ 9 B.</Explicatus><Stk><Linea/></Stk></Paragraf></Dokument>"""
DEEP = "<a>" * 3000 + "x" + "</a>" * 3000


def trees(spark):
    rows = [("law", LAW.encode()), ("one", b"<r/>"), ("broken", b"<r>"), (None, None), ("deep", DEEP.encode())]
    return spark.createDataFrame(rows, "eli string, body binary")


def test_text_of_every_element_is_the_parsers(spark):
    tree = lawtree.nodes(trees(spark)).where("eli <> 'deep'")
    got = {(r.eli, r.node): r.text for r in lawtree.texts(tree, tree.where("tag is not null")).collect()}
    number = {(r.eli, r.node): r.tag for r in tree.where("tag is not null").collect()}
    for eli, body in (("law", LAW), ("one", "<r/>")):
        mine = sorted(k for k in number if k[0] == eli)
        root = list(ElementTree.fromstring(body).iter())
        assert [number[k] for k in mine] == [e.tag for e in root]
        assert [got[k] for k in mine] == [lawxml._text(e) for e in root]
    assert {k[0] for k in number} == {"law", "one"}


def test_numbers_are_intervals(spark):
    rows = lawtree.nodes(trees(spark)).where("eli = 'law'").orderBy("node").collect()
    assert [r.node for r in rows] == list(range(len(rows)))
    for r in rows:
        below = {x.node for x in rows if r.node in x.above}
        assert below == set(range(r.node + 1, r.last + 1)) and r.depth == len(r.above) and (r.parent is None) == (r.node == 0)
        assert (r.tag is None) != (r.content is None)
    deep = lawtree.nodes(trees(spark)).where("eli = 'deep'")
    assert deep.count() == 3001 and deep.agg({"depth": "max"}).first()[0] == 3000


def test_lookups(spark):
    tree = lawtree.nodes(trees(spark))
    got = sorted(tuple(r) for r in lawtree.blocks(tree, "§ 9 A").collect())
    assert got == []  # an identifier with a space isn't normal
    tree = lawtree.nodes(trees(spark).where("eli = 'law'").selectExpr("eli", "cast(replace(cast(body as string), '9 A\"', '9a\"') as binary) as body"))
    got = sorted(tuple(r) for r in lawtree.blocks(tree, "9 a").collect())
    assert got == [("law", "9A", 1, 1, "Første punkt."), ("law", "9A", 1, 2, "Andet."), ("law", "9A", 3, 1, "Tredje stk."), ("law", "9A", 3, 2, "et nummer,")]
    assert lawtree.blocks(tree, "9A", 3).count() == 2 and lawtree.blocks(tree).count() == 5
    shown = [(r.level, r.tag, r.snippet) for r in lawtree.outline(tree, "9A", 3).orderBy("node").collect()]
    assert shown == [(1, "Explicatus", "Stk. 3."), (1, "Exitus", None), (2, "Linea", "Tredje stk."), (2, "Index", None), (3, "Indentatio", None), (4, "Explicatus", "1)"), (4, "Exitus", None), (5, "Linea", "et nummer,")]


def test_a_saved_tree_is_read_by_ranges(spark):
    folder = new_folder(spark, "tree")
    lawtree.save(lawtree.nodes(trees(spark)), folder)
    tree = spark.read.parquet(folder)
    stk = tree.where("attributes['id'] = 's1'").first()
    part = lawtree.inside(tree, "law", stk.node, stk.last)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(node,{stk.node})" in plan and "EqualTo(eli,law)" in plan
    assert part.count() == stk.last - stk.node + 1 == lawtree.subtrees(tree, tree.where("attributes['id'] = 's1'")).count()
    chars = tree.where("tag = 'Char'")
    above = lawtree.ancestors(tree, chars).orderBy("node").collect()
    assert [r.tag for r in above] == ["Dokument", "Paragraf", "Stk", "Exitus", "Linea"]


def test_found_elements_are_nodes_with_their_texts(spark):
    bodies = {
        "a": '<D>x<P k="1">\u00a0en <C s="m">§ 1</C>\u00ad to<P k="2">\ntre</P> </P><C s="m"/> <C s="n">q</C>hale</D>',
        "b": "<P/>", "c": "<P>ikke lukket", "d": "<D>intet</D>",
    }
    docs = spark.createDataFrame([(k, v.encode()) for k, v in bodies.items()] + [("e", None)], "eli string, body binary")
    tree = lawtree.nodes(docs)
    for tags, having, where in ((["P", "D"], {}, "tag in ('P', 'D')"), (["C"], {"s": "m"}, "tag = 'C' and attributes['s'] = 'm'"), (["Q"], {}, "tag = 'Q'")):
        units = tree.where(where)
        shown = [*[c for c in tree.columns if c not in ("content", "attributes")], "text"]
        want = units.join(lawtree.texts(tree, units), ["eli", "node"])
        got = lawtree.found(docs, tags, having)
        key = lambda df: sorted(str(r) for r in df.select(*shown, F.to_json("attributes").alias("x")).collect())
        assert key(got) == key(want)
        plan = got._jdf.queryExecution().toString()
        assert "Exchange" not in plan and "Join" not in plan
