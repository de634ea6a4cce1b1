"""Registered queries of node predicates, accessors and changes, of reading and writing by configuration, of error status and of encodings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encoding as E
from ..operators import nodes as N
from ..sources import config as C
from ..sources.documents import shred
from .queries import query, table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a customer, with every kind of node."""
    one = F.format_string('<x:c xmlns:x="urn:%s" key="%d" x:seg="%s"><!--%s--><?p %d?><![CDATA[%s]]><b>%d</b> <e/></x:c>', "c_mktsegment", "c_custkey", "c_mktsegment", "c_name", "c_custkey", "c_mktsegment", F.floor("c_acctbal").cast("long"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), one.alias("text"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred(_texts(spark, sf_dir), canonicalize=False, check_namespaces=True)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _got(nodes: DataFrame, what: str) -> DataFrame:
    return nodes.select("doc_id", F.lit(what).alias("what"), F.col("got").cast("string").alias("got"))


# predicates

_COUNTED = (("is_root", 1), ("is_elem", 3), ("is_text", 2), ("is_blob", 2), ("is_white_space", 1), ("is_cmt", 1), ("is_pi", 1), ("is_cdata", 1), ("is_attr", 0), ("is_error", 0), ("is_dtd", 0), ("is_char_ref", 0), ("is_entity_ref", 0), ("is_xml_pi", 0))


@query(" UNION ALL ".join(f"SELECT '{k}' AS what, {n} * count(*) AS n FROM customer" for k, n in _COUNTED))
def node_kinds(spark, sf_dir):
    counts = _nodes(spark, sf_dir).agg(*[F.count(F.when(getattr(N, k)(), 1)).alias(k) for k, _ in _COUNTED])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in _COUNTED]), F.array(*[k for k, _ in _COUNTED]))).alias("what", "n"))


_TESTED = (
    ("has_name", lambda: N.has_name("b"), "true", 1),
    ("has_name_with", lambda: N.has_name_with(lambda x: x.startswith("x:")), "true", 1),
    ("has_local_part", lambda: N.has_local_part("c"), "true", 1),
    ("has_name_prefix", lambda: N.has_name_prefix("x"), "true", 1),
    ("has_namespace_uri", lambda: N.has_namespace_uri("urn:BUILDING"), "c_mktsegment = 'BUILDING'", 1),
    ("has_qname", lambda: N.has_qname("urn:BUILDING", "c"), "c_mktsegment = 'BUILDING'", 1),
    ("has_attr", lambda: N.has_attr("key"), "true", 1),
    ("has_attr_value", lambda: N.has_attr_value("key", lambda v: v.cast("int") < 20), "c_custkey < 20", 1),
    ("has_text", lambda: N.has_text(lambda v: v.startswith("-")), "floor(c_acctbal) < 0", 1),
)
for _name, _test, _sql, _n in _TESTED:
    query(f"SELECT c_custkey AS doc_id, {_n}::BIGINT AS n FROM customer WHERE {_sql}", f"node_{_name}")(
        lambda spark, sf_dir, t=_test: _nodes(spark, sf_dir).where(t()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    )

_SEG_NAME = "'{urn:' || c_mktsegment || '}c'"
_READ = (
    ("get_text", lambda n: N.get_text(n).where("got <> ' '"), "floor(c_acctbal)::BIGINT::VARCHAR"),
    ("get_blob", lambda n: N.get_blob(n).where("value <> ' '"), "floor(c_acctbal)::BIGINT::VARCHAR"),
    ("get_cmt", N.get_cmt, "c_name"),
    ("get_cdata", N.get_cdata, "c_mktsegment"),
    ("get_pi_name", N.get_pi_name, "'p'"),
    ("get_pi_content", N.get_pi_content, "c_custkey::VARCHAR"),
    ("get_elem_name", lambda n: N.get_elem_name(n.where("level = 1")), "'x:c'"),
    ("get_name", lambda n: N.get_name(n.where("level = 2 and sib = 3")), "'b'"),
    ("get_local_part", lambda n: N.get_local_part(n.where("level = 1")), "'c'"),
    ("get_name_prefix", lambda n: N.get_name_prefix(n.where("level = 1")), "'x'"),
    ("get_namespace_uri", lambda n: N.get_namespace_uri(n.where("level = 1")), "'urn:' || c_mktsegment"),
    ("get_universal_name", lambda n: N.get_universal_name(n.where("level = 1")), _SEG_NAME),
    ("get_universal_uri", lambda n: N.get_universal_uri(n.where("level = 1")), "'urn:' || c_mktsegment || 'c'"),
    ("get_qname", lambda n: N.get_qname(n.where("level = 1")).withColumn("got", F.concat_ws("|", "got.prefix", "got.local", "got.ns_uri")), "'x|c|urn:' || c_mktsegment"),
    ("get_attr_value", lambda n: N.get_attr_value(n.where("name = 'b'"), "none"), "''"),
    ("get_attr_value0", lambda n: N.get_attr_value0(n, "key"), "c_custkey::VARCHAR"),
    ("get_qattr_value", lambda n: N.get_qattr_value(n, "urn:BUILDING", "seg").where("level = 1"), "CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment ELSE '' END"),
    ("get_attrl", lambda n: N.get_attrl(n).where("attr_pos = 1").withColumn("got", F.concat("attr_name", F.lit("="), "attr_value")), "'key=' || c_custkey"),
)
for _name, _f, _sql in _READ:
    query(f"SELECT c_custkey AS doc_id, {_sql} AS got FROM customer", f"node_{_name}")(lambda spark, sf_dir, f=_f: f(_nodes(spark, sf_dir)).select("doc_id", F.col("got").cast("string").alias("got")))


@query("SELECT c_custkey AS doc_id, c_mktsegment AS got FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def node_has_qattr(spark, sf_dir):
    """Attributes by qualified name, whatever their prefix."""
    nodes = _nodes(spark, sf_dir)
    found = [N.has_qattr(nodes, "urn:BUILDING", "seg"), N.has_qattr_value(nodes, "urn:MACHINERY", "seg", lambda v: v == "MACHINERY")]
    return _union([N.get_attr_value0(x, "x:seg").select("doc_id", "got") for x in found])


_SHOW = {
    "change_text": (lambda n: N.change_text(n, lambda v: F.concat(v, F.lit("!"))).where("kind = 'text' and value <> ' !'"), "value", "floor(c_acctbal)::BIGINT || '!'"),
    "change_cmt": (lambda n: N.change_cmt(n, F.upper).where("kind = 'comment'"), "value", "upper(c_name)"),
    "change_elem_name": (lambda n: N.change_elem_name(n, lambda x: F.concat(x, F.lit("2"))).where("level = 1"), "local", "'c2'"),
    "change_pi_name": (lambda n: N.change_pi_name(n, F.upper).where("kind = 'pi'"), "name", "'P'"),
    "change_qname": (lambda n: N.change_qname(n, lambda x: F.concat(F.lit("y:"), x)).where("name = 'y:b'"), "prefix", "'y'"),
    "change_attr_name": (lambda n: N.get_attr_value0(N.change_attr_name(n, F.upper), "KEY"), "got", "c_custkey::VARCHAR"),
    "change_attr_value": (lambda n: N.get_attr_value0(N.change_attr_value(n, "key", lambda v: F.concat(F.lit("#"), v)), "key"), "got", "'#' || c_custkey"),
    "change_attrl": (lambda n: N.change_attrl(n, lambda m: F.map_filter(m, lambda k, v: k == "key")).where("level = 1").withColumn("got", F.size("attrs")), "got", "'1'"),
    "set_elem_name": (lambda n: N.set_elem_name(n, F.col("name") == "b", "z").where("name = 'z'"), "local", "'z'"),
    "set_qname": (lambda n: N.set_qname(n, F.col("name") == "b", "q", "z", "urn:q").where("name = 'q:z'"), "ns_uri", "'urn:q'"),
    "set_pi_name": (lambda n: N.set_pi_name(n, F.lit(True), "r").where("kind = 'pi'"), "name", "'r'"),
    "set_attr_name": (lambda n: N.get_attr_value0(N.set_attr_name(n, "key", "id"), "id"), "got", "c_custkey::VARCHAR"),
    "set_attrl": (lambda n: N.get_attr_value0(N.set_attrl(n, F.col("name") == "b", {"u": "v"}), "u"), "got", "'v'"),
    "add_attr": (lambda n: N.get_attr_value0(N.add_attr(n, F.col("level") == 1, "key", "new"), "key"), "got", "'new'"),
    "add_attrl": (lambda n: N.add_attrl(n, F.col("level") == 1, {"a": "1", "b": "2"}).where("level = 1").withColumn("got", F.size("attrs")), "got", "'5'"),
    "remove_attr": (lambda n: N.remove_attr(n, "key").where("level = 1").withColumn("got", F.size("attrs")), "got", "'2'"),
    "remove_qattr": (lambda n: N.remove_qattr(n, "urn:BUILDING", "seg").where("level = 1").withColumn("got", F.size("attrs")), "got", "CASE WHEN c_mktsegment = 'BUILDING' THEN '2' ELSE '3' END"),
}
for _name, (_f, _col, _sql) in _SHOW.items():
    query(f"SELECT c_custkey AS doc_id, {_sql} AS got FROM customer", f"node_{_name}")(lambda spark, sf_dir, f=_f, c=_col: f(_nodes(spark, sf_dir)).select("doc_id", F.col(c).cast("string").alias("got")))


@query("SELECT * FROM (VALUES ('text', NULL, 't'), ('comment', NULL, 'c'), ('cdata', NULL, 'd'), ('pi', 'p', 'i'), ('charref', NULL, '65'), ('entityref', 'amp', NULL), ('element', 'x:e', NULL), ('attr', 'a', 'v'), ('error', NULL, 'm'), ('dtd', 'r', '<!DOCTYPE r>'), ('dtd', 'ELEMENT', NULL), ('dtd', 'ENTITY', NULL), ('dtd', 'PENTITY', NULL)) AS t(kind, name, value)")
def node_constructors(spark, sf_dir):
    made = [N.mk_text("t"), N.mk_cmt("c"), N.mk_cdata("d"), N.mk_pi("p", "i"), N.mk_char_ref(65), N.mk_entity_ref("amp"), N.mk_element("x:e", {"a": "1"}), N.mk_attr("a", "v"), N.mk_error(2, "m"), N.mk_dtd_doctype({"name": "r"}), N.mk_dtd_element({"name": "e", "model": "ANY"}), N.mk_dtd_entity({"name": "n", "value": "v"}), N.mk_dtd_pentity({"name": "n", "value": "v"})]
    return N.table_of(spark, *made).where("kind <> 'root'").select("kind", "name", "value")


_DTD = '<!DOCTYPE d [<!ELEMENT d (#PCDATA)><!ATTLIST d k CDATA "%s"><!ENTITY e "v"><!ENTITY % p "w"><!NOTATION n SYSTEM "s">]><d/>'
_DTD_PARTS = ("doctype", "element", "attlist", "entity", "pentity", "notation")


@query("SELECT c_custkey AS doc_id, unnest([" + ", ".join(f"'{p.upper()}'" for p in _DTD_PARTS) + "]) AS part, 1::BIGINT AS n FROM customer")
def dtd_declarations(spark, sf_dir):
    """Declarations of a document type as nodes, each by its own predicate."""
    nodes = shred(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(_DTD).alias("text")), canonicalize=False)
    each = [N.get_dtd_part(nodes.where(getattr(N, f"is_dtd_{p}")())).groupBy("doc_id", F.col("got").alias("part")).agg(F.count(F.lit(1)).alias("n")) for p in _DTD_PARTS]
    return _union(each)


@query("SELECT c_custkey AS doc_id, c_mktsegment AS got FROM customer")
def dtd_attr_value(spark, sf_dir):
    one = F.format_string('<!DOCTYPE d [<!ATTLIST d k CDATA "%s">]><d/>', "c_mktsegment")
    nodes = shred(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), one.alias("text")), canonicalize=False)
    return N.get_dtd_attr_value(nodes, "default").select("doc_id", "got")


# reading and writing by configuration

_SOURCE = '<d a="%d"> <!--c--> <b>%s</b> <e/> </d>'
_SPACED = "'<d a=\"' || c_custkey || '\"> {}<b>' || c_mktsegment || '</b> <e/> </d>'"
_WRITTEN = (
    ("canonicalize", (), (), _SPACED.format(" ")),
    ("preserve_comment", (C.with_preserve_comment(),), (), _SPACED.format("<!--c--> ")),
    ("remove_ws", (C.with_remove_ws(),), (), "'<d a=\"' || c_custkey || '\"><b>' || c_mktsegment || '</b><e/></d>'"),
    ("no_empty_elem_for", (C.with_remove_ws(),), (C.with_no_empty_elem_for("e"),), "'<d a=\"' || c_custkey || '\"><b>' || c_mktsegment || '</b><e></e></d>'"),
    ("output_html", (C.with_remove_ws(),), (C.with_output_html(),), "'<d a=\"' || c_custkey || '\"><b>' || c_mktsegment || '</b><e></e></d>'"),
    ("output_xhtml", (C.with_remove_ws(),), (C.with_output_xhtml(),), "'<d a=\"' || c_custkey || '\"><b>' || c_mktsegment || '</b><e></e></d>'"),
    ("indent", (C.with_remove_ws(),), (C.with_indent(),), "'<d a=\"' || c_custkey || '\">' || chr(10) || '  <b>' || c_mktsegment || '</b>' || chr(10) || '  <e/>' || chr(10) || '</d>'"),
    ("add_default_dtd", (C.with_remove_ws(),), (C.with_add_default_dtd("d"),), "'<!DOCTYPE d>' || chr(10) || '<d a=\"' || c_custkey || '\"><b>' || c_mktsegment || '</b><e/></d>'"),
)
for _name, _in, _out, _sql in _WRITTEN:

    def _run(spark, sf_dir, i=_in, o=_out):
        docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.format_string(_SOURCE, "c_custkey", "c_mktsegment").alias("text"))
        return C.write_document_to_string(C.read_from_string(docs, "text", "doc_id", *i), C.with_xml_pi(C.no), *o)

    query(f"SELECT c_custkey AS doc_id, {_sql} AS text FROM customer", f"with_{_name}")(_run)


@query("SELECT c_custkey AS doc_id, '<?xml version=\"1.0\" encoding=\"US-ASCII\"?>' || chr(10) || '<d>' || c_mktsegment || '&#233;</d>' AS text FROM customer")
def with_output_encoding(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.format_string("<d>%sé</d>", "c_mktsegment").alias("text"))
    o = C.with_output_encoding("us-ascii")
    made = C.encode_document(C.write_document_to_string(C.read_from_string(docs, "text", "doc_id"), o), o)
    return made.select("doc_id", F.decode("text", "US-ASCII").alias("text"))


@query("SELECT c_custkey AS doc_id, 2::BIGINT AS n FROM customer WHERE c_custkey % 2 = 0")
def xread(spark, sf_dir):
    """Content without a single root; odd ones are not well formed and give an error."""
    one = F.when(F.col("c_custkey") % 2 == 0, "<a/>x<a/>").otherwise("<a>")
    nodes = C.xread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), one.alias("text")))
    return C.document_status_ok(nodes).where("name = 'a'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS doc_id, 3::BIGINT AS n FROM customer")
def hread(spark, sf_dir):
    """HTML content, whose open paragraphs are closed."""
    nodes = C.hread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("<p>one<p>two<p>three").alias("text")))
    return nodes.where("name = 'p'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'string' AS scheme, 'd' AS name, NULL AS msg UNION ALL SELECT 'http', NULL, 'unsupported protocol: http'")
def read_document(spark, sf_dir):
    """A document in its URI, and a scheme that is not read."""
    found = C.read_document(spark, "string:<d/>").where("kind = 'element'").select(F.lit("string").alias("scheme"), "name", F.lit(None).cast("string").alias("msg"))
    return found.union(C.read_document(spark, "http://localhost/x.xml").select(F.lit("http"), F.lit(None).cast("string"), "value"))


# error status


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 = 0 THEN 3 WHEN c_custkey % 2 = 0 THEN 2 WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS level FROM customer")
def err_status(spark, sf_dir):
    key = F.try_element_at("attrs", F.lit("key")).cast("int")
    nodes = C.issue_warn(_nodes(spark, sf_dir), "third", key % 3 == 0)
    nodes = C.issue_fatal(C.issue_err(nodes, "even", key % 2 == 0), "fourth", key % 4 == 0)
    return C.get_err_status(nodes)


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 9 END::BIGINT AS n FROM customer")
def document_status_set(spark, sf_dir):
    """Content of failed documents goes; their root and message stay."""
    key = F.try_element_at("attrs", F.lit("key")).cast("int")
    nodes = C.set_document_status(C.issue_err(_nodes(spark, sf_dir), "even", key % 2 == 0))
    return nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS doc_id, 2 AS level, 'even' AS msg FROM customer WHERE c_custkey % 2 = 0")
def error_messages(spark, sf_dir):
    key = F.try_element_at("attrs", F.lit("key")).cast("int")
    rest, messages = C.filter_error_msg(C.issue_err(_nodes(spark, sf_dir), "even", key % 2 == 0))
    return messages.union(C.get_error_messages(rest))


# encodings

_ENCODED = {
    "unicode_to_xml_entity": (E.unicode_to_xml_entity, "array_to_string(list_transform(string_split(text, ''), lambda x: CASE WHEN unicode(x) > 127 THEN '&#' || unicode(x) || ';' ELSE x END), '')"),
    "unicode_remove_none_ascii": (E.unicode_remove_none_ascii, "array_to_string(list_filter(string_split(text, ''), lambda x: unicode(x) <= 127), '')"),
    "unicode_remove_none_latin1": (E.unicode_remove_none_latin1, "array_to_string(list_filter(string_split(text, ''), lambda x: unicode(x) <= 255), '')"),
    "utf8_roundtrip": (lambda s: E.utf8_to_unicode(E.unicode_to_utf8(s))["text"], "text"),
    "output_encoding": (lambda s: E.get_decoding_fct("latin1")(E.get_output_encoding_fct("iso-8859-1")(s)), "array_to_string(list_transform(string_split(text, ''), lambda x: CASE WHEN unicode(x) > 255 THEN '&#' || unicode(x) || ';' ELSE x END), '')"),
    "normalize_nl": (lambda s: E.normalize_nl(F.concat(s, F.lit("\r\n\r"))), "text || chr(10) || chr(10)"),
    "int_to_char_ref": (lambda s: F.concat(E.int_to_char_ref(F.length(s)), E.int_to_char_ref_hex(F.length(s))), "'&#' || length(text) || ';&#x' || upper(to_hex(length(text))) || ';'"),
}
for _name, (_f, _sql) in _ENCODED.items():
    query(f"SELECT doc_id, md5({_sql}) AS v FROM documents WHERE text IS NOT NULL AND text <> ''", f"encoding_{_name}")(
        lambda spark, sf_dir, f=_f: table(spark, sf_dir, "documents").where("text is not null and text <> ''").select("doc_id", F.md5(f(F.col("text")).cast("binary")).alias("v"))
    )
