"""Reading and writing documents: options, decoding, parsing to node tables, and serialising them."""

from __future__ import annotations

import atexit
import codecs
import gc
import mimetypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..model import NODE, Node
from ..operators import edit
from . import flat, html, xml
from .serialize import to_xml


@dataclass(frozen=True)
class ReadOptions:
    """Reader options. parse_by_mime chooses the parser by the document's type, else parse_html does."""

    parse_html: bool = False
    parse_by_mime: bool = False
    fragment: bool = False
    validate: bool = False
    subst_entities: bool = True
    canonicalize: bool = True
    preserve_comment: bool = False
    remove_ws: bool = False
    check_namespaces: bool = False
    warnings: bool = True
    input_encoding: str | None = None
    encoding_errors: bool = True
    accepted_mimes: tuple[str, ...] = ()
    base_uri: str = ""
    mime_handlers: dict[str, Callable[[str], Node]] = field(default_factory=dict)
    attrs: dict[str, str] = field(default_factory=dict)

    def option(self, **kw) -> ReadOptions:
        return replace(self, **kw)


@dataclass(frozen=True)
class WriteOptions:
    """Writer options. method: xml, html, xhtml or plain."""

    method: str = "xml"
    indent: bool = False
    encoding: str = "utf-8"
    xml_pi: bool = True
    no_empty: frozenset[str] | bool = False
    doctype: str = ""
    show_tree: bool = False


def mime_of(path: Column) -> Column:
    """The type of a path by its extension."""
    types = {k[1:]: v for k, v in mimetypes.types_map.items()} | {"xml": "text/xml", "xsl": "text/xml", "html": "text/html", "htm": "text/html", "xhtml": "application/xhtml+xml"}
    known = F.create_map(*[F.lit(x) for kv in sorted(types.items()) for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("text/plain"))


def guess_encoding(data: bytes, given: str | None = None, mime: str = "") -> str:
    """The encoding given, else that of the type's charset, the byte-order mark or the XML declaration, else UTF-8."""
    if given:
        return given
    if m := re.search(r"charset=[\"']?([\w.:-]+)", mime):
        return m[1]
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(mark):
            return name
    if m := re.match(rb"\s*<\?xml[^>]*encoding=[\"']([\w.:-]+)", data):
        return m[1].decode()
    return "utf-8"


def decode(data: bytes | None, given: str | None = None, mime: str = "") -> tuple[str, str | None]:
    """The text with line ends made one newline, and a problem or None."""
    data = data or b""
    name = guess_encoding(data, given, mime)
    try:
        s, problem = data.decode(name), None
    except (UnicodeDecodeError, LookupError) as e:
        s, problem = data.decode("utf-8", "replace"), f"encoding {name}: {e}"
    return normalize_newlines(s), problem


def normalize_newlines(s: str) -> str:
    return s.replace("\r\n", "\n").replace("\r", "\n")


def parse(source: str | None, o: ReadOptions, mime: str | None = None) -> tuple[Node, list[tuple[int, str]]]:
    """Parses and canonicalises one document by its options."""
    if mime and mime in o.mime_handlers:
        return model.link(o.mime_handlers[mime](source or "")), []
    as_html = (mime or "").startswith(("text/html", "application/xhtml")) if o.parse_by_mime else o.parse_html
    source = normalize_newlines(source or "")
    if as_html:
        tree, problems = html.parse_html(source, o.fragment, o.warnings)
    else:
        tree, problems = xml.parse_xml(source, o.fragment)
    if o.canonicalize:
        tree = edit.canonicalize(tree, o.preserve_comment, o.subst_entities)
    if o.remove_ws:
        tree = edit.remove_doc_ws(tree)
    if o.check_namespaces:
        tree = edit.propagate_namespaces(tree)
        problems += [(2, m) for m in edit.namespace_errors(tree)]
    if o.validate:
        from ..operators import dtd

        rules = dtd.declarations(tree)
        if rules:
            problems += [(2, m) for m in dtd.validate(tree, rules)]
            tree = dtd.transform(tree, rules)
    if any(level >= 2 for level, _ in problems):
        tree = model.root()
    return model.link(tree), problems


def shred(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", mime: str | None = None, **options) -> DataFrame:
    """NODE rows of each document; problems are rows of kind error (value: message, attrs: level). A document that fails keeps its root alone.

    A null id stays null; a null text is empty. Each document is parsed in one task, and no document's rows move.
    What works on whole trees (map_trees, rewrite) and location paths read the documents themselves, as the result remembers them.
    """
    o = ReadOptions(**options)
    direct = _is_direct(o)
    cols = [F.col(doc_id).cast("long").alias("_i"), F.col(text).alias("_t"), (F.col(mime) if mime else F.lit(None)).cast("string").alias("_m")]

    def run(batches):
        if direct:
            gc.set_threshold(50_000)
            for batch in batches:
                for f in flat.batches(batch, lambda i, t: _rows(i, t, o)):
                    for k in range(0, f.n, BATCH_ROWS):
                        yield f.rows(np.arange(k, min(f.n, k + BATCH_ROWS)))
            return
        for batch in batches:
            out: list[tuple] = []
            for i, t, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.extend(model.rows(i, _tree(t, m, o, False)))
                if len(out) > BATCH_ROWS:
                    yield from model.batches(out)
                    out = []
            yield from model.batches(out)

    texts = _bounded(docs.select(*cols))
    nodes = texts.mapInArrow(run, NODE)
    nodes._texts = (texts, o)
    return nodes


#: Rows of an Arrow batch of nodes or results.
BATCH_ROWS = model.BATCH_ROWS
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def _bounded(df: DataFrame) -> DataFrame:
    """The session's Arrow batches held to BATCH_BYTES, unless it asks for less; a worker gets one large document at a time."""
    conf = df.sparkSession.conf
    was = conf.get(_BATCH, None)
    if was is None or not was.isdigit() or int(was) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def _is_direct(o: ReadOptions) -> bool:
    return o == ReadOptions(warnings=o.warnings, encoding_errors=o.encoding_errors, input_encoding=o.input_encoding, base_uri=o.base_uri)


def _tree(text: str | None, mime: str | None, o: ReadOptions, direct: bool) -> Node:
    """The linked tree of a document, its problems as children of the root."""
    if direct and (tree := xml.xml_tree(normalize_newlines(text or ""))) is not None:
        return tree
    tree, problems = parse(text, o, mime)
    for level, message in problems:
        if level > 1 or o.warnings:
            tree.children.append(Node("error", None, message, {"level": str(level)}))
    return model.link(tree)


def _rows(i: int | None, text: str | None, o: ReadOptions) -> list[list]:
    """NODE rows of a document with plain options."""
    found = xml.xml_rows(i, normalize_newlines(text or ""))
    return found if found is not None else model.rows(i, _tree(text, None, o, False))


def map_flat(nodes: DataFrame, f: Callable[[flat.Flat], pa.RecordBatch], schema) -> DataFrame | None:
    """Batches of f for the columns of some documents each, where the table is one of shred() with plain options; else None."""
    docs, o = getattr(nodes, "_texts", None) or (None, None)
    if docs is None or not _is_direct(o):
        return None

    def run(batches):
        gc.set_threshold(50_000)
        for batch in batches:
            for x in flat.batches(batch, lambda i, t: _rows(i, t, o)):
                got = f(x)
                for k in range(0, got.num_rows, BATCH_ROWS):
                    yield got.slice(k, BATCH_ROWS)

    return _bounded(docs).mapInArrow(run, schema)


def ids(nodes: DataFrame) -> DataFrame:
    """doc_id of each document."""
    known = getattr(nodes, "_texts", None)
    return nodes.where("level = 0").select("doc_id") if known is None else known[0].select(F.col("_i").alias("doc_id"))


def _each_tree(nodes: DataFrame, f: Callable[[int, Node], list[tuple]], make: Callable[[list[tuple]], Iterator], schema) -> DataFrame:
    """Arrow batches that make() forms of the rows of f(doc_id, tree). Documents are parsed where they lie if the table is one of shred();
    else a document's nodes meet in one task. One tree is in memory at a time."""
    known = getattr(nodes, "_texts", None)
    if known is not None:
        docs, o = known
        direct = _is_direct(o)

        def trees(batch):
            ids, texts, mimes = batch.columns
            for k in range(batch.num_rows):
                yield ids[k].as_py(), _tree(texts[k].as_py(), mimes[k].as_py(), o, direct)
    else:
        docs = nodes.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in NODE.fieldNames() if c != "doc_id"])).alias("n"))

        def trees(batch):
            for k in range(batch.num_rows):
                yield batch.column(0)[k].as_py(), model.tree_of(batch.column(1)[k].values)

    def run(batches):
        gc.set_threshold(50_000)  # trees are taken apart below, so that the collector, which reads all that lives, need not come often
        out: list[tuple] = []
        for batch in batches:
            for i, tree in trees(batch):
                out.extend(f(i, tree))
                model.unlink(tree)  # else its nodes, which name each other, stay until the collector comes
                del tree
                if len(out) > BATCH_ROWS:
                    yield from make(out)
                    out = []
            yield from make(out)
            out = []

    return _bounded(docs).mapInArrow(run, schema)


#: Stored node tables that have a key: the session's application and the key, and where the table lies.
_stored: dict[tuple, str] = {}


def state_of(spark: SparkSession, *paths: str) -> tuple:
    """Bytes and time of change of the files at some paths, in any store that Spark reads."""
    out = []
    for p in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        out.append((p, fs.getContentSummary(hadoop).getLength(), fs.getFileStatus(hadoop).getModificationTime()))
    return tuple(out)


def store(nodes: DataFrame, key: tuple | None = None) -> DataFrame:
    """Writes a node table as Parquet into the folder of spark.checkpoint.dir (a temporary one where none is set, in local mode) and reads it back.

    Documents are parsed once, however many joins follow, and each join's scan reads only its columns, with kind and name pushed down.
    With a key, which must name the source, its state (state_of) and the options, later calls of this application read the same table.
    Deleted when Python exits.
    """
    spark = nodes.sparkSession
    known = (spark.sparkContext.applicationId, key)
    if key is not None and known in _stored and _exists(spark, _stored[known]):
        return spark.read.schema(nodes.schema).parquet(_stored[known])
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_sylva_nodes", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark._sylva_nodes = "file://" + tempfile.mkdtemp(prefix="sylva-nodes-")
    path = f"{base.rstrip('/')}/nodes-{uuid.uuid4().hex[:12]}"
    nodes.write.parquet(path)
    if key is not None:
        _stored[known] = path
    atexit.register(_delete, spark, path)
    return spark.read.schema(nodes.schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has gone; its folder goes with it
        return


def read_documents(spark: SparkSession, path: str, **options) -> DataFrame:
    """The documents under a path: uri, mime, text and encoding problem. Contents come from Spark's binary reader, so any store will do."""
    o = ReadOptions(**options)
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("uri"), mime_of(F.col("path")).alias("mime"), "content")
    if o.accepted_mimes:
        files = files.where(F.col("mime").isin(list(o.accepted_mimes)))

    def run(batches):
        for batch in batches:
            got = [decode(c, o.input_encoding, m or "") for m, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in got]), pa.array([x[1] if o.encoding_errors else None for x in got], pa.string())], ["uri", "mime", "text", "problem"])

    return files.mapInArrow(run, "uri string, mime string, text string, problem string")


def read_string(spark: SparkSession, *sources: str, **options) -> DataFrame:
    """NODE rows of the given texts, numbered from 0."""
    return shred(spark.createDataFrame(list(enumerate(sources)), "doc_id long, text string"), **options)


def errors(nodes: DataFrame) -> DataFrame:
    """doc_id, level and message of all problems."""
    return nodes.where("kind = 'error'").select("doc_id", F.col("attrs")["level"].cast("int").alias("level"), F.col("value").alias("msg"))


def status(nodes: DataFrame) -> DataFrame:
    """doc_id and the highest level of its problems, 0 if there are none."""
    return nodes.groupBy("doc_id").agg(F.coalesce(F.max(F.when(F.col("kind") == "error", F.col("attrs")["level"].cast("int"))), F.lit(0)).alias("level"))


def document_ok(nodes: DataFrame) -> DataFrame:
    """The nodes of documents without a problem of level 2 or more."""
    bad = errors(nodes).where("level >= 2").select("doc_id").distinct()
    return nodes.join(bad, "doc_id", "left_anti")


def map_trees(nodes: DataFrame, f: Callable[[int, Node], list[tuple]], schema: str) -> DataFrame:
    """Rows of f(doc_id, tree) for each document; a document's nodes meet in one task, as a tree must."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def make(rows):
        for k in range(0, len(rows), BATCH_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + BATCH_ROWS], strict=True), arrow.types, strict=True)], schema=arrow)

    return _each_tree(nodes, f, make, schema)


def rewrite(nodes: DataFrame, f: Callable[[Node], list[Node]]) -> DataFrame:
    """NODE rows after f, a function from a document's tree to trees, whose first becomes the document."""
    return _each_tree(nodes, lambda i, tree: [r for t in f(tree)[:1] for r in model.rows(i, t)], model.batches, NODE)


def _pieces(nodes: DataFrame, no_empty: frozenset[str] | bool) -> DataFrame:
    """doc_id and text of each document as XML: what stands before and after each node's children, in document order. Nothing leaves the JVM."""
    from ..functions import strings as S

    value, name = F.coalesce("value", F.lit("")), F.col("name")
    attrs = F.array_join(F.transform(F.map_entries(F.coalesce("attrs", F.create_map().cast("map<string,string>"))), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), S.escape_attr(e["value"]), F.lit('"'))), "")
    keep = F.lit(True) if no_empty is True else F.lit(False) if not no_empty else name.isin(*no_empty)
    tag, closed = F.concat(F.lit("<"), name, attrs), F.concat(F.lit("</"), name, F.lit(">"))
    text = {
        "element": F.when(F.col("size") > 0, F.concat(tag, F.lit(">"))).when(keep, F.concat(tag, F.lit(">"), closed)).otherwise(F.concat(tag, F.lit("/>"))),
        "text": S.escape_text(value),
        "cdata": F.concat(F.lit("<![CDATA["), value, F.lit("]]>")),
        "comment": F.concat(F.lit("<!--"), value, F.lit("-->")),
        "pi": F.concat(F.lit("<?"), name, F.when(value != "", F.concat(F.lit(" "), value)).otherwise(""), F.lit("?>")),
        "charref": F.concat(F.lit("&#"), value, F.lit(";")),
        "entityref": F.concat(F.lit("&"), name, F.lit(";")),
        "dtd": value,
        "error": F.concat(F.lit("<!-- "), F.coalesce(name, F.lit("error")), F.lit(": "), value, F.lit(" -->")),
    }
    before = F.lit("")
    for kind, x in text.items():
        before = F.when(F.col("kind") == kind, x).otherwise(before)
    opened = F.struct(F.col("pre").alias("p"), F.lit(0).alias("l"), before.alias("s"))
    ended = F.struct((F.col("pre") + F.col("size")).alias("p"), (F.lit(1 << 30) - F.col("level")).alias("l"), closed.alias("s"))  # after the last node below; inner ones first
    both = F.when((F.col("kind") == "element") & (F.col("size") > 0), F.array(opened, ended)).otherwise(F.array(opened))
    rows = nodes.where("pre is not null").select("doc_id", F.explode(both).alias("x"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "").alias("text"))


def serialize(nodes: DataFrame, **options) -> DataFrame:
    """doc_id and text of each document. Plain XML is put together by Spark; indentation, HTML and plain text go through trees."""
    o = WriteOptions(**options)
    pi, doctype = f'<?xml version="1.0" encoding="{o.encoding.upper()}"?>\n', f"<!DOCTYPE {o.doctype}>\n"
    head = (pi if o.xml_pi and o.method in ("xml", "xhtml") else "") + (doctype if o.doctype else "")
    if o.method == "xml" and not o.indent:
        return _pieces(nodes, o.no_empty).select("doc_id", F.concat(F.lit(head), "text").alias("text"))
    return map_trees(nodes, lambda i, t: [(i, head + to_xml(t, o.method, o.no_empty, o.indent))], "doc_id long, text string")


def write_documents(nodes: DataFrame, path: str, **options) -> None:
    """Writes the documents' text as Parquet (doc_id, text); Spark's writer commits whole tasks only."""
    serialize(nodes, **options).write.mode("overwrite").parquet(path)
