"""Reading and writing by configuration: options as values that are combined, documents by their URI, and the error status of documents.

An option changes a Config; `configure(with_parse_html(), with_indent())` combines some. read_document() takes a URI (or a folder, or a pattern) that
Spark's readers open, or `string:` and the document itself; other schemes give an error row of level 3, as the engine makes no network requests by itself.
Status and messages are rows of kind error in the document, so they go with it through every stage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import uri as U
from ..model import NODE, Node
from . import documents as D

YES, NO = True, False
yes, no = YES, NO


@dataclass(frozen=True)
class Config:
    read: D.ReadOptions = field(default_factory=D.ReadOptions)
    write: D.WriteOptions = field(default_factory=D.WriteOptions)
    attrs: dict[str, str] = field(default_factory=dict)
    show_errors: bool = True
    ignore_non_xml: bool = False
    mime: str | None = None
    compression: str | None = None
    numbered: bool = False


Option = Callable[[Config], Config]


def configure(*options: Option, base: Config | None = None) -> Config:
    c = base or Config()
    for o in options:
        c = o(c)
    return c


def _read(**kw) -> Option:
    return lambda c: replace(c, read=replace(c.read, **kw))


def _write(**kw) -> Option:
    return lambda c: replace(c, write=replace(c.write, **kw))


# input


def with_parse_html(on: bool = YES) -> Option:
    return _read(parse_html=on)


def with_parse_by_mime_type(on: bool = YES) -> Option:
    return _read(parse_by_mime=on)


def with_validate(on: bool = YES) -> Option:
    """Against the document's own DTD."""
    return _read(validate=on)


def with_subst_dtd_entities(on: bool = YES) -> Option:
    return _read(subst_entities=on)


with_subst_html_entities = with_subst_dtd_entities


def with_check_namespaces(on: bool = YES) -> Option:
    return _read(check_namespaces=on)


def with_canonicalize(on: bool = YES) -> Option:
    return _read(canonicalize=on)


def with_preserve_comment(on: bool = YES) -> Option:
    return _read(preserve_comment=on)


def with_remove_ws(on: bool = YES) -> Option:
    return _read(remove_ws=on)


def with_warnings(on: bool = YES) -> Option:
    return _read(warnings=on)


def with_errors(on: bool = YES) -> Option:
    """Whether error rows stay in the table."""
    return lambda c: replace(c, show_errors=on)


def with_encoding_errors(on: bool = YES) -> Option:
    return _read(encoding_errors=on)


def with_input_encoding(name: str) -> Option:
    return _read(input_encoding=name)


def with_default_base_uri(uri: str) -> Option:
    return _read(base_uri=uri)


def with_accepted_mime_types(*types: str) -> Option:
    return _read(accepted_mimes=tuple(types))


def with_mime_type_handler(mime: str, parse: Callable[[str], Node]) -> Option:
    return lambda c: replace(c, read=replace(c.read, mime_handlers=c.read.mime_handlers | {mime: parse}, parse_by_mime=True))


def with_file_mime_type(mime: str) -> Option:
    """One type for all files, whatever their names."""
    return lambda c: replace(c, mime=mime)


def with_ignore_none_xml_contents(on: bool = YES) -> Option:
    """Documents that are neither XML nor HTML keep their root alone."""
    return lambda c: replace(c, ignore_non_xml=on)


def with_input_option(key: str, value: str) -> Option:
    return with_sys_attr(key, value)


def with_input_options(pairs: dict[str, str]) -> Option:
    return lambda c: replace(c, attrs=c.attrs | pairs)


def with_sys_attr(key: str, value: str) -> Option:
    return lambda c: replace(c, attrs=c.attrs | {key: value})


# output


def with_indent(on: bool = YES) -> Option:
    return _write(indent=on)


def with_output_encoding(name: str) -> Option:
    return _write(encoding=name)


def with_output_xml() -> Option:
    return _write(method="xml")


def with_output_html() -> Option:
    return _write(method="html")


def with_output_xhtml() -> Option:
    return _write(method="xhtml")


def with_output_plain() -> Option:
    return _write(method="plain")


def with_xml_pi(on: bool = YES) -> Option:
    return _write(xml_pi=on)


def with_no_empty_elem_for(*names: str) -> Option:
    return _write(no_empty=frozenset(names))


def with_add_default_dtd(doctype: str) -> Option:
    return _write(doctype=doctype)


def with_show_tree(on: bool = YES) -> Option:
    return _write(show_tree=on)


def with_compression(codec: str = "zstd") -> Option:
    """The codec of stored node tables."""
    return lambda c: replace(c, compression=codec)


# documents


def is_mime_doc(*types: str) -> Column:
    return F.col("mime").isin(*types)


def is_text_doc() -> Column:
    return F.col("mime").startswith("text/")


def is_xml_html_doc() -> Column:
    return F.col("mime").rlike(r"^(text|application)/(xml|html|xhtml\+xml|xslt\+xml)|\+xml$")


def get_encoding(content: bytes, mime: str = "", given: str | None = None) -> str:
    return D.guess_encoding(content, given, mime)


def _numbered(files: DataFrame) -> DataFrame:
    return files.withColumn("doc_id", F.xxhash64("uri"))


def _parsed(docs: DataFrame, c: Config) -> DataFrame:
    """NODE rows of doc_id, uri, mime, text and problem."""
    if c.mime:
        docs = docs.withColumn("mime", F.lit(c.mime))
    if c.ignore_non_xml:
        docs = docs.withColumn("text", F.when(is_xml_html_doc(), F.col("text")))
    options = {k: getattr(c.read, k) for k in c.read.__dataclass_fields__}
    nodes = D.shred(docs, mime="mime", **options)
    if c.read.encoding_errors:
        bad = docs.where(F.col("problem").isNotNull()).select("doc_id", F.col("problem").alias("msg"))
        nodes = nodes.unionByName(error_rows(bad, 2))
    return nodes if c.show_errors else nodes.where("kind <> 'error'")


def error_rows(found: DataFrame, level: int) -> DataFrame:
    """NODE rows of kind error for doc_id and msg; their place in the document is not set."""
    from ..operators.nodes import node

    made = found.select(F.col("doc_id").alias("_i"), node("error", None, F.col("msg"), {"level": str(level)}).alias("n")).select("_i", "n.*")
    return made.withColumn("doc_id", F.col("_i").cast("long")).select(*NODE.fieldNames())


def get_protocol_handler(uri: str) -> str:
    """The scheme by which a URI is read: string, file or another that Spark's readers open."""
    return uri.split(":", 1)[0] if ":" in uri.split("/", 1)[0] else "file"


UNSUPPORTED = frozenset(("http", "https", "ftp", "stdin"))


def get_unsupported(spark: SparkSession, uri: str) -> DataFrame:
    """A document whose one error says that its scheme is not read."""
    text = f"unsupported protocol: {get_protocol_handler(uri)}"
    return error_rows(spark.range(1).select(F.col("id").alias("doc_id"), F.lit(text).alias("msg")), 3)


def get_string_contents(spark: SparkSession, uri: str) -> DataFrame:
    made = spark.createDataFrame([(uri, "text/xml", uri.split(":", 1)[1], None)], "uri string, mime string, text string, problem string")
    return _numbered(made)


def get_xml_contents(spark: SparkSession, uri: str, c: Config) -> DataFrame:
    """doc_id, uri, mime, text and problem of the documents at a URI."""
    if get_protocol_handler(uri) == "string":
        return get_string_contents(spark, uri)
    options = {k: getattr(c.read, k) for k in c.read.__dataclass_fields__}
    return _numbered(D.read_documents(spark, uri, **options))


def read_document(spark: SparkSession, uri: str, *options: Option) -> DataFrame:
    """NODE rows of the documents at a URI."""
    if get_protocol_handler(uri) in UNSUPPORTED:
        return get_unsupported(spark, uri)
    c = configure(*options)
    return _parsed(get_xml_contents(spark, uri, c), c)


def read_from_document(uris: DataFrame, root: str, *options: Option) -> DataFrame:
    """NODE rows of those documents under root whose uri a table names; URIs may be relative to root. The listing is joined, so nothing is collected."""
    c = configure(*options)
    files = get_xml_contents(uris.sparkSession, root, c)
    wanted = uris.select(U.expand(F.col("uri"), F.lit(root.rstrip("/") + "/")).alias("uri")).distinct()
    plain = lambda x: F.regexp_replace(x, "^file:/+", "/")  # noqa: E731  file:/x and file:///x are one
    return _parsed(files.join(wanted.select(plain(F.col("uri")).alias("_u")), plain(F.col("uri")) == F.col("_u"), "left_semi"), c)


def read_string(spark: SparkSession, source: str, *options: Option) -> DataFrame:
    return read_document(spark, f"string:{source}", *options)


def read_from_string(docs: DataFrame, text: str, doc_id: str, *options: Option) -> DataFrame:
    """NODE rows of a column of documents."""
    made = docs.select(F.col(doc_id).alias("doc_id"), F.lit("").alias("uri"), F.lit("text/xml").alias("mime"), F.col(text).alias("text"), F.lit(None).cast("string").alias("problem"))
    return _parsed(made, configure(*options))


def xread(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """XML content without a prolog."""
    return read_from_string(docs, text, doc_id, _read(fragment=True, canonicalize=False))


def xread_doc(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return read_from_string(docs, text, doc_id, with_canonicalize(NO))


def hread(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """HTML content."""
    return read_from_string(docs, text, doc_id, with_parse_html(), _read(fragment=True), with_warnings(NO))


def hread_doc(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return read_from_string(docs, text, doc_id, with_parse_html(), with_warnings(NO))


def write_document_to_string(nodes: DataFrame, *options: Option) -> DataFrame:
    """doc_id and text."""
    w = configure(*options).write
    if w.show_tree:
        from .serialize import tree_picture

        return D.map_trees(nodes, lambda i, t: [(i, tree_picture(t))], "doc_id long, text string")
    return D.serialize(nodes, **{k: getattr(w, k) for k in w.__dataclass_fields__})


def encode_document(texts: DataFrame, *options: Option, text: str = "text") -> DataFrame:
    """Text as bytes of the output encoding; what it cannot express becomes character references."""
    from ..functions import encoding

    return texts.withColumn(text, encoding.get_output_encoding_fct(configure(*options).write.encoding)(F.col(text)))


def write_document(nodes: DataFrame, path: str, *options: Option) -> None:
    encode_document(write_document_to_string(nodes, *options), *options).write.mode("overwrite").parquet(path)


def write_binary_value(nodes: DataFrame, path: str, *options: Option) -> None:
    """A stored node table, compressed if the options say so."""
    c = configure(*options)
    nodes.write.mode("overwrite").option("compression", c.compression or "zstd").parquet(path)


def read_binary_value(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODE).parquet(path)


# error status


def get_err_status(nodes: DataFrame) -> DataFrame:
    return D.status(nodes)


def get_error_messages(nodes: DataFrame) -> DataFrame:
    return D.errors(nodes)


def clear_err_status(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind <> 'error'")


def filter_error_msg(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes without messages, and the messages."""
    return clear_err_status(nodes), get_error_messages(nodes)


def issue(nodes: DataFrame, level: int, msg: str, where: Column | None = None) -> DataFrame:
    """A message of a level in each document that has a node where the condition holds."""
    found = nodes.where(F.lit(True) if where is None else where).select("doc_id").distinct().withColumn("msg", F.lit(msg))
    return nodes.unionByName(error_rows(found, level))


def issue_warn(nodes: DataFrame, msg: str, where: Column | None = None) -> DataFrame:
    return issue(nodes, 1, msg, where)


def issue_err(nodes: DataFrame, msg: str, where: Column | None = None) -> DataFrame:
    return issue(nodes, 2, msg, where)


def issue_fatal(nodes: DataFrame, msg: str, where: Column | None = None) -> DataFrame:
    return issue(nodes, 3, msg, where)


def set_document_status(nodes: DataFrame) -> DataFrame:
    """A document with a message of level 2 or more keeps its root and messages alone."""
    bad = get_error_messages(nodes).where("level >= 2").select("doc_id").distinct().withColumn("_bad", F.lit(True))
    return nodes.join(bad, "doc_id", "left").where("_bad is null or kind in ('root', 'error')").select(*nodes.columns)


def document_status_ok(nodes: DataFrame) -> DataFrame:
    return D.document_ok(nodes)


# base URIs


def set_base_uri_from_doc(nodes: DataFrame, uri: Column | None = None) -> DataFrame:
    """doc_id and base: the href of an HTML base element, against the document's own URI if one is given."""
    base = nodes.where("kind = 'element' and name = 'base'").groupBy("doc_id").agg(F.min_by(F.col("attrs")["href"], "pre").alias("href"))
    return base.select("doc_id", (F.col("href") if uri is None else U.expand(F.col("href"), uri)).alias("base"))


def change_base_uri(base: Column, new: Column) -> Column:
    """A URI against the base before."""
    return U.expand(new, base)
