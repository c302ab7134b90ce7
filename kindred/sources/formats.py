"""Readers and writers of graph and result formats, all through Spark's own readers.

BSS text holds graphs one after another without a delimiter: id, `v e`, v vertex labels (one a
line), e lines `src dst label`. A line of two numbers stands only in a graph's head, below its id, so a reader
that starts anywhere in a file finds the next graph: large files are read by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import GRAPH, LITERALS
from ..operators.order import numbered
from ..plans.planner import small_enough
from .scratch import written

SCHEMA = pa.schema(
    [("gid", pa.int64()), ("v", pa.int32()), ("e", pa.int32()), ("nodes", pa.list_(pa.int32())), ("edges", pa.list_(pa.struct([("src", pa.int32()), ("dst", pa.int32()), ("label", pa.int32())])))]
)
ATTRIBUTED = "name string, class string, directed boolean, nodes array<struct<id:string,attrs:map<string,string>>>, edges array<struct<src:string,dst:string,attrs:map<string,string>>>"


def parse_bss(text: str) -> Iterator[tuple[int, list[int], list[tuple[int, int, int]]]]:
    """(gid, labels, edges); a truncated last graph raises ValueError."""
    words = iter(text.split())
    for gid in words:
        try:
            v, e = int(next(words)), int(next(words))
            nodes = [int(next(words)) for _ in range(v)]
            edges = [(int(next(words)), int(next(words)), int(next(words))) for _ in range(e)]
        except StopIteration:
            raise ValueError(f"graph {gid} is cut short") from None
        yield int(gid), nodes, edges


def _rows(graphs: Iterable[tuple]) -> pa.RecordBatch:
    rows = [(g, len(n), len(e), n, [{"src": min(s, d), "dst": max(s, d), "label": x} for s, d, x in e]) for g, n, e in graphs]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, SCHEMA)], schema=SCHEMA)


class _Split:
    """The lines of one split of a file, in order: whole graphs, and the lines before the first and after the last of them."""

    def __init__(self, path: str, start: int):
        self.path, self.start, self.head, self.found = path, start, [], False
        self.lines: list[str] = []  # of the graph that is being read
        self.left = -1  # its lines still to come; -1: its size is not yet known

    def add(self, line: str) -> str | None:
        """The text of a graph that this line completes."""
        words = line.split()
        if not words:
            return None
        if not self.found:  # inside a graph that began before this split, until a line of two numbers has its id above it
            if len(words) != 2 or not self.head or len(self.head[-1].split()) != 1:
                self.head.append(line)
                return None
            self.found, self.lines = True, [self.head.pop()]
        self.lines.append(line)
        if len(self.lines) == 2:
            if len(words) != 2:
                raise ValueError(f"{self.path}: no `v e` below the id {self.lines[0]!r}")
            self.left = int(words[0]) + int(words[1])
        elif len(self.lines) > 2:
            self.left -= 1
        if self.left == 0:
            text, self.lines, self.left = "\n".join(self.lines), [], -1
            return text
        return None


PARSED = pa.schema([("path", pa.string()), ("start", pa.int64()), ("whole", pa.bool_()), ("text", pa.string()), ("rest", pa.string())])


def _bss_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, whole, text, rest): graphs' texts (whole), and of each split the lines before its first graph (text) and of
    the one it does not hold to the end (rest; null if no graph starts in it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: _Split | None = None

        def ends() -> list[tuple]:
            if split is None or not (split.head or split.lines):
                return []
            return [(split.path, split.start, False, "\n".join(split.head), "\n".join(split.lines) if split.found else None)]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, PARSED)], schema=PARSED)

        for b in batches:
            rows = []
            for line, file, start in zip(b["value"].to_pylist(), b["path"].to_pylist(), b["start"].to_pylist()):
                if split is None or (file, start) != (split.path, split.start):
                    rows += ends()
                    split = _Split(file, start)
                if (text := split.add(line)) is not None:
                    rows.append((file, start, True, text, None))
            yield out(rows)
        yield out(ends())

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    return lines.mapInArrow(run, "path string, start long, whole boolean, text string, rest string")


def read_bss(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Graphs of BSS files, each split of a file read by a task of its own; graphs that splits cut are put together by file.

    whole_files: for texts whose lines are not those of the format; then a file is one unit of work. A graph that is cut
    short raises ValueError. Reading goes through a stored table of the graphs' texts."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows(g for text in b["text"].to_pylist() for g in parse_bss(text))

    if whole_files:
        return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text").mapInArrow(parse, GRAPH)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for parts in b["parts"].to_pylist():
                open_, graphs = "", []
                for x in parts:  # in order of their place in the file
                    open_ = f"{open_}\n{x['text']}"
                    if x["rest"] is not None:
                        graphs += parse_bss(open_)
                        open_ = x["rest"]
                yield _rows([*graphs, *parse_bss(open_)])

    pieces = written(_bss_pieces(spark, path), "bss")
    # What splits of a file leave over: about two graphs' lines a split.
    cut = pieces.where("not whole").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "text", "rest"))).alias("parts"))
    return pieces.where("whole").select("text").mapInArrow(parse, GRAPH).union(cut.select("parts").mapInArrow(join, GRAPH))


def bss_text(graphs: DataFrame) -> DataFrame:
    """(gid, value): each graph as BSS lines."""
    lines = F.concat(
        F.array(F.col("gid").cast("string"), F.concat_ws(" ", F.col("v").cast("string"), F.col("e").cast("string"))),
        F.transform("nodes", lambda x: x.cast("string")),
        F.transform("edges", lambda e: F.concat_ws(" ", e["src"].cast("string"), e["dst"].cast("string"), e["label"].cast("string"))),
    )
    return graphs.select("gid", F.array_join(lines, "\n").alias("value"))


def write_bss(graphs: DataFrame, path: str) -> None:
    bss_text(graphs).select("value").write.text(path)


def first_graphs(graphs: DataFrame, n: int) -> DataFrame:
    """The n graphs of smallest id."""
    return graphs.orderBy("gid").limit(n)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, value): the files of a folder, each as one text."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), "value")


def read_gexf(spark: SparkSession, path: str, label: str | None = None, words: DataFrame | None = None) -> DataFrame:
    """One graph a file, see gexf_graphs()."""
    return gexf_graphs(read_texts(spark, path), label, words)


def gexf_labels(texts: DataFrame, label: str) -> DataFrame:
    """(w, rank): the distinct values of the attribute `label` and their dense ranks, to be kept for later files."""
    return _ranks(_gexf(texts, label))


def _ranks(raw: DataFrame) -> DataFrame:
    w = raw.select(F.explode("labels").alias("w")).where("w is not null").distinct()
    return numbered(w, "rank", F.asc("w")).select("w", (F.col("rank") - 1).alias("rank"))


def broken_xml(texts: DataFrame) -> DataFrame:
    """(name, value): the texts that are null or no XML, which the readers of GEXF leave out: count them before a conversion."""
    bad = F.from_xml("value", "_corrupt_record string", {"ignoreNamespace": "true"})["_corrupt_record"].isNotNull()
    return texts.where(F.col("value").isNull() | bad).select("name", "value")


def gexf_graphs(texts: DataFrame, label: str | None = None, words: DataFrame | None = None) -> DataFrame:
    """Graphs of GEXF texts (name, value), each graph's id the number in its name; vertex labels 1, or the ranks of the
    values of attribute `label` in words (by default those of these texts; a value that is not there has rank null).

    Texts that are no XML are left out; broken_xml() names them."""
    raw = _gexf(texts, label)
    if label is None:
        ranked = raw.select("gid", "src", "dst", F.transform("ids", lambda _: F.lit(1)).alias("nodes"))
    else:
        if words is None:
            raw = written(raw, "gexf")  # texts are parsed once, for the words and for the graphs
            words = _ranks(raw)
        few = words.select("w", F.col("rank").cast("int").alias("rank")).limit(LITERALS + 1).collect()  # bounded, and then part of the plan
        if len(few) <= LITERALS:
            keys, ranks = F.lit([r["w"] for r in few]).cast("array<string>"), F.lit([r["rank"] for r in few]).cast("array<int>")
            ranked = raw.select("gid", "src", "dst", F.transform("labels", lambda w: F.get(ranks, (F.array_position(keys, w) - 1).cast("int"))).alias("nodes"))
        else:  # names may have one number, so graphs are told apart by their rows
            raw = written(raw.withColumn("row", F.monotonically_increasing_id()), "gexf_rows")
            at = raw.select("row", F.posexplode("labels").alias("i", "w")).join(F.broadcast(words) if small_enough(words) else words, "w", "left")
            nodes = at.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", F.col("rank").cast("int").alias("rank")))).alias("x"))
            ranked = raw.join(nodes, "row", "left").select("gid", "src", "dst", F.coalesce(F.transform("x", lambda s: s["rank"]), F.array().cast("array<int>")).alias("nodes"))
    edges = F.transform(F.arrays_zip("src", "dst"), lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), F.lit(1).alias("label")))
    return ranked.select("gid", F.size("nodes").alias("v"), F.size("src").alias("e"), "nodes", edges.alias("edges"))


# The parts of the formats that are read; a struct within a list may be missing
GEXF = """graph struct<
    attributes:array<struct<_class:string,attribute:array<struct<_id:string,_title:string>>>>,
    nodes:struct<node:array<struct<_id:string,attvalues:struct<attvalue:array<struct<_for:string,_value:string>>>,nodes:string>>>,
    edges:struct<edge:array<struct<_source:string,_target:string>>>>"""
KINDS = ("bool", "int", "float", "string", "enum")  # of a GXL attribute's value, its element's name
_ATTRS = f"attr:array<struct<_name:string,_VALUE:string,{','.join(f'{k}:string' for k in KINDS)}>>"
GXL = f"_id string, _edgemode string, node array<struct<_id:string,{_ATTRS}>>, edge array<struct<_from:string,_to:string,{_ATTRS}>>"


def _gexf(texts: DataFrame, label: str | None) -> DataFrame:
    """(gid, ids, labels, src, dst). A vertex is found in its graph's list of ids, which is meant for small graphs; vertices
    inside vertices are refused, and so are edges to a vertex that is not there."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    parsed = F.from_xml("value", f"{GEXF}, _corrupt_record string", {"ignoreNamespace": "true"})
    # exploded, so that the filter stays above it: a filter on the column itself would parse each text once more for each condition
    g = texts.select("name", F.explode(F.array(parsed)).alias("x")).where("x is not null and x._corrupt_record is null")
    nodes = F.coalesce(F.col("x.graph.nodes.node"), none("struct<_id:string,attvalues:struct<attvalue:array<struct<_for:string,_value:string>>>,nodes:string>"))
    inner = F.exists(nodes, lambda n: n["nodes"].isNotNull())
    nodes = F.when(inner, F.raise_error(F.concat(F.lit("vertices inside vertices are not read: "), F.col("name")))).otherwise(nodes)
    about = F.filter(F.coalesce("x.graph.attributes", none("struct<_class:string,attribute:array<struct<_id:string,_title:string>>>")), lambda a: F.coalesce(a["_class"], F.lit("node")) == "node")
    titles = F.flatten(F.transform(about, lambda a: F.coalesce(a["attribute"], none("struct<_id:string,_title:string>"))))
    g = g.select("name", nodes.alias("nodes"), titles.alias("titles"), F.coalesce("x.graph.edges.edge", none("struct<_source:string,_target:string>")).alias("edges"))
    if label is None:
        labels = F.transform("nodes", lambda n: F.lit("1"))
    else:
        meant = F.transform(F.filter("titles", lambda t: t["_title"] == label), lambda t: t["_id"])
        g = g.withColumns({"meant": meant, "known": F.transform("titles", lambda t: t["_id"])})
        own = lambda v: F.array_contains("meant", v["_for"]) | ((v["_for"] == label) & ~F.coalesce(F.array_contains("known", v["_for"]), F.lit(False)))
        labels = F.transform("nodes", lambda n: F.get(F.filter(n["attvalues"]["attvalue"], own), F.lit(0))["_value"])
    g = g.select("name", F.transform("nodes", lambda n: n["_id"]).alias("ids"), labels.alias("labels"), "edges")

    def place(x: Column) -> Column:
        at = F.array_position("ids", x).cast("int")
        return F.when(at > 0, at - 1).otherwise(F.raise_error(F.concat(F.lit("an edge names a vertex that is not there: "), F.col("name"))).cast("int"))

    ends = F.transform("edges", lambda e: F.struct(place(e["_source"]).alias("s"), place(e["_target"]).alias("t")))
    pairs = F.array_sort(F.array_distinct(F.transform(ends, lambda e: F.struct(F.least(e["s"], e["t"]).alias("src"), F.greatest(e["s"], e["t"]).alias("dst")))))
    digits = F.regexp_replace("name", r"\D", "")
    g = g.select(F.when(digits == "", 0).otherwise(digits.cast("long")).alias("gid"), "ids", "labels", pairs.alias("pairs"))
    return g.select("gid", "ids", "labels", F.transform("pairs", lambda p: p["src"]).alias("src"), F.transform("pairs", lambda p: p["dst"]).alias("dst"))


def _attributed(found: DataFrame) -> DataFrame:
    """(name, class, directed, nodes, edges) of (name, g), g one graph as GXL describes it."""

    def attrs(x: Column) -> Column:
        value = lambda a: F.trim(F.coalesce(*(a[k] for k in (*KINDS, "_VALUE")), F.lit("")))
        pairs = F.transform(F.filter(x["attr"], lambda a: a["_name"].isNotNull()), lambda a: F.struct(a["_name"].alias("k"), value(a).alias("v")))
        return F.map_from_entries(F.coalesce(pairs, F.array().cast("array<struct<k:string,v:string>>")))

    nodes = F.transform("g.node", lambda n: F.struct(n["_id"].alias("id"), attrs(n).alias("attrs")))
    edges = F.transform("g.edge", lambda e: F.struct(e["_from"].alias("src"), e["_to"].alias("dst"), attrs(e).alias("attrs")))
    kind = {k.split(" ")[0]: k.split(" ")[1] for k in ATTRIBUTED.split(", ")}
    listed = lambda c, k: F.coalesce(c.cast(kind[k]), F.array().cast(kind[k])).alias(k)
    directed = F.coalesce(F.col("g._edgemode"), F.lit("undirected")) == "directed"
    return found.select("name", F.lit(None).cast("string").alias("class"), directed.alias("directed"), listed(nodes, "nodes"), listed(edges, "edges"))


def _elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The elements `tag` of XML files, each file streamed by one task; a broken file fails the job."""
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).option("mode", "FAILFAST").schema(schema).load(path)


def read_gxl(spark: SparkSession, path: str) -> DataFrame:
    """(name, class, directed, nodes, edges) of the graphs in GXL files; attributes are strings, an attribute without a value is ''."""
    own = _elements(spark, path, "graph", GXL)
    return _attributed(own.select(F.col("_metadata.file_name").alias("name"), F.struct(*own.columns).alias("g")))


def gxl_graphs(texts: DataFrame) -> DataFrame:
    """(name, class, directed, nodes, edges) of GXL texts (name, value); a broken text fails the job, a null one has no graph."""
    fields = GXL.replace(" array", ":array").replace(" string", ":string")
    found = F.from_xml("value", f"graph array<struct<{fields}>>", {"ignoreNamespace": "true", "mode": "FAILFAST"})
    return _attributed(texts.select("name", F.explode(found["graph"]).alias("g")))


def read_cxl(spark: SparkSession, path: str) -> DataFrame:
    """(name, class) of the entries of collections; a missing class is NO_CLASS."""
    entry = _elements(spark, path, "print", "_file string, _class string")
    return entry.select(F.col("_file").alias("name"), F.coalesce(F.nullif("_class", F.lit("")), F.lit("NO_CLASS")).alias("class"))


def write_cxl(entries: DataFrame, path: str) -> None:
    """Entries (name, class) as collections, every part file one of its own; a null class is left away."""
    own = entries.select(F.col("name").alias("_file"), F.col("class").alias("_class"))
    own.write.format("xml").option("rowTag", "print").option("rootTag", "GraphCollection").save(path)


def collection(graphs: DataFrame, entries: DataFrame) -> DataFrame:
    """The graphs of a collection with their classes."""
    return graphs.drop("class").join(entries, "name")


def gxl_text(graphs: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(name, value): attributed graphs as GXL; an attribute is float, int, bool or string by what its text is.

    Attributes named in ignore are written without their value; nodes, edges and attributes are in ascending order."""
    number = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"

    def attrs(entries: Column) -> Column:
        def put(a: Column) -> Column:
            v = F.when(~a["key"].isin(*ignore), a["value"]) if ignore else a["value"]
            kind = F.when(v.isin("true", "false"), "bool").when(v.rlike(r"^-?\d+$"), "int").when(v.rlike(number), "float").otherwise("string")
            return F.struct(a["key"].alias("_name"), *(F.when(kind == k, v).alias(k) for k in ("bool", "int", "float", "string")))

        return F.transform(F.array_sort(F.map_entries(entries)), put)

    order = lambda column, *by: F.array_sort(F.transform(column, lambda x: F.struct(*(x[c].alias(c) for c in by), F.map_entries(x["attrs"]).alias("attrs"))))
    nodes = F.transform(order("nodes", "id"), lambda n: F.struct(n["id"].alias("_id"), attrs(F.map_from_entries(n["attrs"])).alias("attr")))
    edges = F.transform(order("edges", "src", "dst"), lambda e: F.struct(e["src"].alias("_from"), e["dst"].alias("_to"), attrs(F.map_from_entries(e["attrs"])).alias("attr")))
    mode = F.when(F.col("directed"), "directed").otherwise("undirected")
    graph = F.struct(F.col("name").alias("_id"), F.lit("false").alias("_edgeids"), mode.alias("_edgemode"), nodes.alias("node"), edges.alias("edge"))
    return graphs.select("name", F.to_xml(F.struct(graph.alias("graph")), {"rowTag": "gxl"}).alias("value"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(gid, qid, ged) of lines `gid qid ged`."""
    return spark.read.option("sep", " ").schema("gid long, qid long, ged int").csv(path)


def result_lines(results: DataFrame, order: str = "gid") -> DataFrame:
    """(qid, value): `qid gid gid ...`, ids in ascending order of a column."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct(order, F.col("gid").alias("id")))), lambda s: s["id"].cast("string"))
    return results.groupBy("qid").agg(ids.alias("ids")).select("qid", F.concat_ws(" ", F.col("qid").cast("string"), F.array_join("ids", " ")).alias("value"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(qid, rank, gid) of such lines; a query without ids has no row."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("x"))
    return parts.select(F.col("x")[0].cast("long").alias("qid"), F.posexplode(F.slice("x", 2, 1_000_000_000)).alias("rank", "gid")).select("qid", (F.col("rank") + 1).alias("rank"), F.col("gid").cast("long").alias("gid"))


def index_lines(codes: DataFrame) -> DataFrame:
    """(code, value): inverted-index text of a code: `code n`, then per posting its id and embedding with 6 decimals."""
    number = lambda x: F.format_string("%f", x.cast("double"))
    row = F.concat_ws(" ", F.col("gid").cast("string"), F.array_join(F.transform("emb", number), " "))
    return codes.select("code", "gid", row.alias("row")).groupBy("code").agg(F.sort_array(F.collect_list(F.struct("gid", "row"))).alias("rows")).select("code", F.concat_ws("\n", F.concat_ws(" ", F.col("code").cast("string"), F.size("rows").cast("string")), F.array_join(F.transform("rows", lambda r: r["row"]), "\n")).alias("value"))


def write_index(codes: DataFrame, path: str) -> None:
    """Inverted-index text: every part file is an index of its own, its first line `codes length`."""
    size = F.size("emb")
    lines = index_lines(codes).join(codes.select("code", size.alias("size")).distinct(), "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b["size"].to_pylist(), b["value"].to_pylist())]
        if rows:
            yield pa.record_batch([pa.array(["\n".join([f"{len(rows)} {rows[0][0]}", *(v for _, v in rows)])])], ["value"])

    lines.repartition("code").sortWithinPartitions("code").mapInArrow(run, "value string").write.text(path)


def write_index_table(codes: DataFrame, path: str) -> None:
    """The index as Parquet, postings of neighbouring codes together, so that a probe reads few row groups."""
    codes.select("code", "gid", "emb").repartitionByRange("code").sortWithinPartitions("code", "gid").write.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(code, gid, emb) of index files: `codes length`, then the codes as index_lines() writes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b["value"].to_pylist():
                w = iter(text.split())
                n, size = int(next(w)), int(next(w))
                rows = []
                for _ in range(n):
                    code, k = int(next(w)), int(next(w))
                    rows += [(code, int(next(w)), [float(next(w)) for _ in range(size)]) for _ in range(k)]
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["code", "gid", "emb"])

    return spark.read.text(path, wholetext=True).mapInArrow(run, "code long, gid long, emb array<double>")


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(pos, x) of a text with one or several numbers on its lines: bit weights, distance mappings. One small file."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")).alias("pos", "x")).select("pos", F.col("x").cast("double").alias("x"))


def write_numbers(numbers: DataFrame, path: str) -> None:
    numbers.orderBy("pos").select(F.col("x").cast("string").alias("value")).coalesce(1).write.text(path)


def matrix_values(distances: DataFrame) -> DataFrame:
    """(src, tgt, value): distances with 5 decimals, row-major by orderBy."""
    return distances.select("src", "tgt", F.format_string("%.5f", F.col("d").cast("double")).alias("value")).orderBy("src", "tgt")


def matrix_lines(counts: DataFrame, row: str, column: str, n: str, size: int = 12) -> DataFrame:
    """(row, value): a line for each row 0..size - 1 with its count in each column 0..size - 1, and 0 where there is none."""
    at = F.map_from_entries(F.collect_list(F.struct(F.col(column).cast("int"), F.col(n).cast("string"))))
    rows = counts.where(F.col(row).between(0, size - 1) & F.col(column).between(0, size - 1)).groupBy(F.col(row).cast("int").alias("row")).agg(at.alias("m"))
    all_rows = counts.sparkSession.range(size).select(F.col("id").cast("int").alias("row"))
    cell = lambda j: F.coalesce(F.try_element_at("m", j), F.lit("0"))
    return all_rows.join(rows, "row", "left").select("row", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), cell), " ").alias("value"))


def mapping_column(distance: Column, mapping: tuple[int, ...]) -> Column:
    """The code distance for a graph distance; null outside the mapping."""
    out = F.lit(None).cast("int")
    for d, h in enumerate(mapping):
        out = F.when(distance == d, F.lit(h)).otherwise(out)
    return out
