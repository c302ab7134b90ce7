import random

import pytest

from kindred.operators import ged
from kindred.operators.graphs import GRAPH
from kindred.sources import formats


def test_bss_files(spark, tmp_path):
    rows = [(7, 3, 2, [1, 2, 300], [(0, 1, 1), (1, 2, 4)]), (9, 1, 0, [5], []), (11, 0, 0, [], [])]
    g = spark.createDataFrame(rows, GRAPH)
    formats.write_bss(g, f"{tmp_path}/b")
    back = formats.read_bss(spark, f"{tmp_path}/b").orderBy("gid").collect()
    assert [tuple(r) for r in back] == [(a, b, c, d, [tuple(x) for x in e]) for a, b, c, d, e in rows]
    assert [r.gid for r in formats.first_graphs(g, 2).collect()] == [7, 9]
    with pytest.raises(ValueError):
        list(formats.parse_bss("1\n3 1\n0\n"))


@pytest.mark.parametrize("block, graphs, most", [(9, 6, 4), (60, 30, 12), (100_000, 60, 30)])
def test_bss_splits_of_one_file(spark, tmp_path, block, graphs, most):
    """Wherever a file is cut, between and inside graphs, every graph is read once."""
    r = random.Random(block)
    rows = []
    for gid in range(graphs):
        n = r.choice([0, 1, 2, most])
        rows.append((gid * 7, n, [r.randrange(400) for _ in range(n)], [(i, i + 1, r.randrange(3)) for i in range(n - 1)]))
    text = "".join(f"{g}\n{v} {len(e)}\n" + "".join(f"{x}\n" for x in n) + "".join(f"{a} {b} {x}\n" for a, b, x in e) for g, v, n, e in rows)
    (tmp_path / "all.txt").write_text(text)
    (tmp_path / "more.txt").write_text("\n5000\n2 1\n3\n4\n0 1 9")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = formats.read_bss(spark, str(tmp_path))
        n = formats._bss_pieces(spark, str(tmp_path)).rdd.getNumPartitions()
        back = sorted((g.gid, g.v, g.nodes, [tuple(e) for e in g.edges]) for g in got.collect())
        assert back == sorted([*rows, (5000, 2, [3, 4], [(0, 1, 9)])])
        (tmp_path / "cut.txt").write_text("1\n3 1\n0\n")
        with pytest.raises(Exception, match="cut short"):
            formats.read_bss(spark, f"{tmp_path}/cut.txt").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert n > len(text) // (2 * block) or block == 100_000
    whole = formats.read_bss(spark, f"{tmp_path}/all.txt", whole_files=True)
    assert sorted(x.gid for x in whole.collect()) == [x[0] for x in rows]


def test_reordered_graphs_are_the_same_graphs(spark):
    rows = [(1, 4, 3, [5, 6, 7, 8], [(0, 1, 1), (1, 2, 1), (1, 3, 2)]), (2, 0, 0, [], []), (3, 2, 0, [1, 2], [])]
    got = {r.gid: r for r in ged.reordered(spark.createDataFrame(rows, GRAPH)).collect()}
    for gid, v, e, nodes, edges in rows:
        own = got[gid]
        assert (own.v, own.e) == (v, e) and (own.nodes, [tuple(x) for x in own.edges]) == ged.reorder(nodes, edges)
        assert ged.edit_distance(nodes, edges, own.nodes, [tuple(x) for x in own.edges]) == 0


def test_gxl_and_cxl(spark, tmp_path):
    gxl = '<gxl><graph id="g" edgeids="false" edgemode="undirected"><node id="_1"><attr name="x"><float>1.5</float></attr></node><node id="_0"/><edge from="_0" to="_1"><attr name="v"><int>2</int></attr></edge></graph></gxl>'
    (tmp_path / "a.gxl").write_text(gxl)
    (tmp_path / "c.cxl").write_text('<c><p><print file="a.gxl" class="k"/><print file="b.gxl"/></p></c>')
    g = formats.read_gxl(spark, f"{tmp_path}/a.gxl")
    r = formats.collection(g, formats.read_cxl(spark, f"{tmp_path}/c.cxl")).first()
    assert r["class"] == "k" and not r.directed and {n.id: n.attrs for n in r.nodes} == {"_0": {}, "_1": {"x": "1.5"}} and r.edges[0].attrs == {"v": "2"}
    assert {x["class"] for x in formats.read_cxl(spark, f"{tmp_path}/c.cxl").collect()} == {"k", "NO_CLASS"}
    text = formats.gxl_text(g).first().value
    (tmp_path / "again.gxl").write_text(text)
    again = formats.read_gxl(spark, f"{tmp_path}/again.gxl").first()
    assert sorted(again.nodes) == sorted(r.nodes) and again.edges == r.edges and "<float>1.5</float>" in text


def test_gexf(spark, tmp_path):
    (tmp_path / "12.gexf").write_text(
        '<gexf xmlns="http://x"><graph><attributes class="node"><attribute id="0" title="atom"/></attributes><nodes><node id="a"><attvalues><attvalue for="0" value="N"/></attvalues></node><node id="b"><attvalues><attvalue for="0" value="C"/></attvalues></node></nodes><edges><edge source="b" target="a"/></edges></graph></gexf>'
    )
    (tmp_path / "13.gexf").write_text("<broken")
    r = formats.read_gexf(spark, f"{tmp_path}/*.gexf", "atom").collect()
    assert [(x.gid, x.v, x.e, x.nodes, [tuple(e) for e in x.edges]) for x in r] == [(12, 2, 1, [1, 0], [(0, 1, 1)])]
    assert formats.read_gexf(spark, f"{tmp_path}/*.gexf").first().nodes == [1, 1]
    assert [x.name for x in formats.broken_xml(formats.read_texts(spark, f"{tmp_path}/*.gexf")).collect()] == ["13.gexf"]


def test_result_truth_index_and_number_files(spark, tmp_path):
    res = spark.createDataFrame([(1, 5), (1, 3), (2, 9)], "qid long, gid long")
    formats.result_lines(res).select("value").write.text(f"{tmp_path}/r")
    assert sorted(tuple(r) for r in formats.read_results(spark, f"{tmp_path}/r").collect()) == [(1, 1, 3), (1, 2, 5), (2, 1, 9)]
    (tmp_path / "t.txt").write_text("3 1 2\n4 1 0\n")
    assert [tuple(r) for r in formats.read_truth(spark, f"{tmp_path}/t.txt").collect()] == [(3, 1, 2), (4, 1, 0)]
    codes = spark.createDataFrame([(8, 4, [0.5, 1.0]), (8, 2, [0.25, 2.0]), (1, 3, [0.0, -1.0])], "code long, gid long, emb array<double>")
    body = "\n".join(r.value for r in formats.index_lines(codes).orderBy("code").collect())
    (tmp_path / "i.txt").write_text(f"2 2\n{body}\n")
    assert sorted(tuple(r) for r in formats.read_index(spark, f"{tmp_path}/i.txt").collect()) == sorted((c, g, e) for c, g, e in [(8, 4, [0.5, 1.0]), (8, 2, [0.25, 2.0]), (1, 3, [0.0, -1.0])])
    (tmp_path / "m.txt").write_text("0 2 3\n4\n")
    n = formats.read_numbers(spark, f"{tmp_path}/m.txt")
    assert [r.x for r in n.orderBy("pos").collect()] == [0, 2, 3, 4]
    formats.write_numbers(n, f"{tmp_path}/m2")
    assert n.select(formats.mapping_column(n.x.cast("int"), (5, 6, 7)).alias("h")).collect()[1].h == 7
    m = formats.matrix_values(spark.createDataFrame([(1, 2, 0.5), (0, 1, 1.0)], "src int, tgt int, d double")).collect()
    assert [r.value for r in m] == ["1.00000", "0.50000"]


def test_gxl_of_odd_values(spark, tmp_path):
    node = "array<struct<id:string,attrs:map<string,string>>>"
    edge = "array<struct<src:string,dst:string,attrs:map<string,string>>>"
    values = {"a": "-7", "b": "1e3", "c": "true", "d": 'x<&>"y', "e": "", "f": "1.", "g": "nan", "h": "ü 3"}
    rows = [("g1", True, [("n2", values), ("n1", None)], [("n2", "n1", {}), ("n1", "n2", {"w": "2"})]), ("g0", False, [], None), ("g<2>", False, [("only", {})], [])]
    g = spark.createDataFrame(rows, f"name string, directed boolean, nodes {node}, edges {edge}")
    texts = formats.gxl_text(g)
    back = {r.name: r for r in formats.gxl_graphs(texts).collect()}
    assert set(back) == {"g1", "g0", "g<2>"} and back["g1"].directed and not back["g0"].directed
    assert [(n.id, n.attrs) for n in back["g1"].nodes] == [("n1", {}), ("n2", values)]
    assert [(e.src, e.dst, e.attrs) for e in back["g1"].edges] == [("n1", "n2", {"w": "2"}), ("n2", "n1", {})]
    assert back["g0"].nodes == [] and back["g0"].edges == [] and back["g<2>"].nodes[0].id == "only"
    text = texts.where("name = 'g1'").first().value
    assert all(x in text for x in ("<int>-7</int>", "<float>1e3</float>", "<bool>true</bool>", "<float>1.</float>", "<float>nan</float>", "<string>ü 3</string>"))
    hidden = formats.gxl_text(g, ignore=("a", "d")).where("name = 'g1'")
    assert formats.gxl_graphs(hidden).first().nodes[1].attrs == values | {"a": "", "d": ""}
    more = spark.createDataFrame([("two", '<gxl><graph id="a"><node id="1"><attr name="k">plain</attr></node></graph><graph id="b"/></gxl>'), ("none", None)], "name string, value string")
    assert sorted((r.name, [n.attrs for n in r.nodes]) for r in formats.gxl_graphs(more).collect()) == [("two", []), ("two", [{"k": "plain"}])]
    with pytest.raises(Exception, match="MALFORMED"):
        formats.gxl_graphs(spark.createDataFrame([("x", "<gxl><graph>")], "name string, value string")).collect()
    (tmp_path / "x.gxl").write_text("<gxl><graph><node></gxl>")
    with pytest.raises(Exception, match="MALFORMED"):
        formats.read_gxl(spark, f"{tmp_path}/x.gxl").collect()


def test_files_of_many_elements(spark, tmp_path):
    entry = '<print file="f{0}.gxl" class="k{1}"/>\n'
    (tmp_path / "all.cxl").write_text('<?xml version="1.0"?>\n<!DOCTYPE x SYSTEM "http://nowhere.invalid/x.dtd">\n<GraphCollection><molecules>\n' + "".join(entry.format(i, i % 3) for i in range(4000)) + "</molecules></GraphCollection>")
    graph = '<graph id="g{0}" edgemode="directed"><node id="_{0}"><attr name="x"><int>{0}</int></attr></node></graph>\n'
    (tmp_path / "all.gxl").write_text("<gxl>\n" + "".join(graph.format(i) for i in range(2000)) + "</gxl>")
    want = sorted((f"f{i}.gxl", f"k{i % 3}") for i in range(4000))
    entries, graphs = formats.read_cxl(spark, f"{tmp_path}/all.cxl"), formats.read_gxl(spark, f"{tmp_path}/all.gxl")
    assert sorted(tuple(r) for r in entries.collect()) == want
    assert sorted(int(r.nodes[0].attrs["x"]) for r in graphs.where("directed").collect()) == list(range(2000))
    odd = spark.createDataFrame([('a<&">.gxl', None), ("b.gxl", ""), (None, "c")], "name string, class string")
    formats.write_cxl(entries.union(odd).repartition(3), f"{tmp_path}/again")
    assert sorted(formats.read_cxl(spark, f"{tmp_path}/again").na.fill("-").collect()) == sorted([*want, ('a<&">.gxl', "NO_CLASS"), ("b.gxl", "NO_CLASS"), ("-", "c")])
    formats.write_cxl(odd.limit(0), f"{tmp_path}/empty")
    assert formats.read_cxl(spark, f"{tmp_path}/empty").count() == 0


GEXF = '<gexf xmlns="http://x" xmlns:viz="http://y"><graph>{0}<nodes>{1}</nodes><edges>{2}</edges></graph></gexf>'


def test_gexf_of_odd_files(spark):
    about = '<attributes class="node"><attribute id="0" title="atom"/><attribute id="1" title="c"/></attributes><attributes class="edge"><attribute id="0" title="c"/></attributes>'
    node = '<node id="{0}"><viz:size value="2"/><attvalues><attvalue for="1" value="z"/>{1}</attvalues></node>'
    nodes = node.format("a", '<attvalue for="0" value="N"/>') + node.format("b", "") + '<node id="c"/>'
    edges = '<edge source="c" target="a"/><edge source="a" target="c"/><edge source="b" target="b"/>'
    texts = [("g7.gexf", GEXF.format(about, nodes, edges)), ("8.gexf", GEXF.format("", "", "")), ("x.gexf", "<gexf><graph/></gexf>"), ("9", "no XML"), ("10", None), ("11", "")]
    df = spark.createDataFrame(texts, "name string, value string")
    got = {r.gid: (r.v, r.e, r.nodes, [tuple(e) for e in r.edges]) for r in formats.gexf_graphs(df, "atom").collect()}
    assert got == {7: (3, 2, [0, None, None], [(0, 2, 1), (1, 1, 1)]), 8: (0, 0, [], []), 0: (0, 0, [], [])}
    assert formats.gexf_graphs(df, "c").where("gid = 7").first().nodes == [0, 0, None]  # the vertices' attribute, not the edges'
    assert formats.gexf_graphs(df.where("name = 'g7.gexf'")).first().nodes == [1, 1, 1]
    assert {r.name for r in formats.broken_xml(df).collect()} == {"9", "10", "11"}
    for nodes, edges, said in (('<node id="a"><nodes><node id="b"/></nodes></node>', "", "inside"), ('<node id="a"/>', '<edge source="a" target="q"/>', "not there")):
        with pytest.raises(Exception, match=said):
            formats.gexf_graphs(spark.createDataFrame([("1", GEXF.format("", nodes, edges))], "name string, value string")).collect()


def test_gexf_texts_are_parsed_once(spark, monkeypatch):
    node = '<node id="{0}"><attvalues><attvalue for="atom" value="{1}"/></attvalues></node>'
    texts = [(name, GEXF.format("", "".join(node.format(k, x) for k, x in enumerate(labels)), "")) for name, labels in (("7.gexf", "CN"), ("7b.gexf", "OC"), ("8.gexf", "N"))]
    df = spark.createDataFrame(texts, "name string, value string")
    assert formats._gexf(df, "atom")._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1
    want = [(7, [0, 1]), (7, [2, 0]), (8, [1])]  # two names have one number
    graphs = formats.gexf_graphs(df, "atom")
    assert "from_xml" not in graphs._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.gid, r.nodes) for r in graphs.collect()) == want
    monkeypatch.setattr(formats, "LITERALS", 2)  # more words than that are joined
    assert sorted((r.gid, r.nodes) for r in formats.gexf_graphs(df, "atom").collect()) == want
    words = spark.createDataFrame([("C", 0), ("N", 1)], "w string, rank int")
    assert sorted(str((r.gid, r.nodes)) for r in formats.gexf_graphs(df, "atom", words).collect()) == ["(7, [0, 1])", "(7, [None, 0])", "(8, [1])"]


def test_folder_to_codes(spark, tmp_path):
    from kindred.operators import encode
    from kindred.plans.lifecycle import encode_folder

    node = '<node id="{0}"><attvalues><attvalue for="atom" value="{1}"/></attvalues></node>'
    for i, labels in enumerate(["CN", "NC", "CC", "O"]):
        body = "".join(node.format(k, x) for k, x in enumerate(labels))
        (tmp_path / f"{i}.gexf").write_text(GEXF.format("", body, '<edge source="0" target="1"/>' if len(labels) > 1 else ""))
    (tmp_path / "9.gexf").write_text("<gexf>")
    words = spark.createDataFrame([("C", 0), ("N", 1)], "w string, rank int")
    w = encode.make_weights(2)
    codes, broken = encode_folder(spark, str(tmp_path), w, "atom", words)
    got = {r.gid: r for r in codes.collect()}
    assert set(got) == {0, 1, 2, 3} and [r.name for r in broken.collect()] == ["9.gexf"]
    want = {0: [0, 1], 1: [1, 0], 2: [0, 0], 3: [-1]}
    for gid, nodes in want.items():
        emb, _ = encode.encode_graph(nodes, [(0, 1)] if len(nodes) > 1 else [], w)
        assert got[gid].emb == pytest.approx(emb.tolist())
