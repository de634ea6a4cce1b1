"""Registered queries of XPath functions, stylesheets, schemas and codecs, each operator on documents of the star schema.

The documents are the nations (nation > group > customer > bal) or one small document a customer; the SQL computes the same answers from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codec as K
from ..operators import rng, xslt, xsd
from ..sources.documents import shred
from . import xpath as X
from .queries import nations, query, table

_CUST = "(SELECT n_nationkey AS k, n_name AS name, c_custkey AS c, c_mktsegment AS seg, floor(c_acctbal)::BIGINT AS bal FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey)"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each customer: c(key, seg) > bal, name."""
    one = F.format_string('<c key="%d" seg="%s"><bal>%d</bal><name>%s</name></c>', "c_custkey", "c_mktsegment", F.floor("c_acctbal").cast("long"), "c_name")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), one.alias("text"))


# XPath functions: one value a nation; the SQL is over the nation's name n, key k and customers

_FUNCTIONS = (
    ("starts_with", "starts-with(/nation/@name, 'A')", "CASE WHEN name[1] = 'A' THEN 'true' ELSE 'false' END"),
    ("contains", "contains(/nation/@name, 'I')", "CASE WHEN contains(name, 'I') THEN 'true' ELSE 'false' END"),
    ("substring_before", "substring-before(/nation/@name, 'A')", "CASE WHEN contains(name, 'A') THEN split_part(name, 'A', 1) ELSE '' END"),
    ("substring_after", "substring-after(/nation/@name, 'A')", "CASE WHEN contains(name, 'A') THEN name[instr(name, 'A') + 1:] ELSE '' END"),
    ("substring", "substring(/nation/@name, 2, 3)", "name[2:4]"),
    ("string_length", "string-length(/nation/@name)", "length(name)::VARCHAR"),
    ("normalize_space", "normalize-space(concat('  ', /nation/@name, '   x '))", "name || ' x'"),
    ("translate", "translate(/nation/@name, 'AEIOU', 'aeiou')", "translate(name, 'AEIOU', 'aeiou')"),
    ("concat", "concat(/nation/@name, '-', /nation/@key)", "name || '-' || k"),
    ("string", "string(/nation/@key)", "k::VARCHAR"),
    ("boolean", "boolean(//customer[bal < 0])", "CASE WHEN count(*) FILTER (bal < 0) > 0 THEN 'true' ELSE 'false' END"),
    ("not", "not(//customer[bal < 0])", "CASE WHEN count(*) FILTER (bal < 0) > 0 THEN 'false' ELSE 'true' END"),
    ("true_false", "concat(true(), false())", "'truefalse'"),
    ("number", "number(/nation/@key) + 1", "(k + 1)::VARCHAR"),
    ("floor", "floor(/nation/@key div 3)", "(k // 3)::VARCHAR"),
    ("ceiling", "ceiling(/nation/@key div 3)", "((k + 2) // 3)::VARCHAR"),
    ("round", "round(/nation/@key div 4)", "(floor(k / 4 + 0.5)::BIGINT)::VARCHAR"),
    ("count", "count(//customer)", "count(c)::VARCHAR"),
    ("sum", "sum(//bal)", "CASE WHEN count(c) = 0 THEN 'NaN' ELSE sum(bal)::BIGINT::VARCHAR END"),
    ("last", "string(/nation/group[last()]/@name)", "coalesce(max(seg), '')"),
    ("position", "string(/nation/group[position() = 1]/@name)", "coalesce(min(seg), '')"),
    ("name", "name(/*)", "'nation'"),
    ("local_name", "local-name(//@key)", "'key'"),
    ("namespace_uri", "namespace-uri(/*)", "''"),
    ("generate_id", "generate-id(/nation) = generate-id(//group/..)", "CASE WHEN count(c) > 0 THEN 'true' ELSE 'false' END"),
    ("format_number", "format-number(count(//customer) * 1000, '#,##0')", "format('{:,}', count(c) * 1000)"),
    ("mod", "/nation/@key mod 4", "(k % 4)::VARCHAR"),
    ("unary", "- /nation/@key - -1", "(1 - k)::VARCHAR"),
    ("multiply", "/nation/@key * 2 - 3", "(k * 2 - 3)::VARCHAR"),
    ("logic", "/nation/@key > 3 and (/nation/@key < 10 or /nation/@key = 20)", "CASE WHEN k > 3 AND (k < 10 OR k = 20) THEN 'true' ELSE 'false' END"),
    ("equality", "/nation/@name != 'FRANCE'", "CASE WHEN name <> 'FRANCE' THEN 'true' ELSE 'false' END"),
    ("union", "count(//group | //customer | //group[1])", "(count(c) + count(DISTINCT seg))::VARCHAR"),
    ("filter", "string((//customer)[2]/@key)", "coalesce((list(c ORDER BY seg, c))[2]::VARCHAR, '')"),
    ("ancestor", "count(//bal/ancestor::*)", "(count(c) + count(DISTINCT seg) + (count(c) > 0)::BIGINT)::VARCHAR"),
    ("variable", "count(//customer[@key > $least])", "count(*) FILTER (c > 50)::VARCHAR"),
)
for _name, _expr, _sql in _FUNCTIONS:
    query(f"SELECT k AS doc_id, {_sql} AS value FROM {_CUST} GROUP BY k, name", f"xpath_fn_{_name}")(
        lambda spark, sf_dir, e=_expr: X.xpath(nations(spark, sf_dir), e, vars={"least": 50.0}).select(F.col("doc_id").cast("int"), "value")
    )


@query("SELECT c_custkey AS doc_id, c_name AS value FROM customer")
def xpath_fn_id(spark, sf_dir):
    """id() by the document type's ID attribute."""
    one = F.format_string('<!DOCTYPE d [<!ELEMENT d ANY><!ELEMENT x ANY><!ATTLIST x k ID #REQUIRED>]><d><x k="a">no</x><x k="i%d">%s</x></d>', "c_custkey", "c_name")
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), one.alias("text"))
    return X.xpath(shred(docs), "string(id(concat('i', substring-after(//x[2]/@k, 'i'))))").select("doc_id", "value")


@query("SELECT k AS doc_id, count(c) AS n FROM " + _CUST + " WHERE bal < 0 GROUP BY 1 HAVING count(c) > 0")
def xpath_node_set(spark, sf_dir):
    """A node set as keys, and the rows that it selects."""
    nodes = nations(spark, sf_dir)
    found = X.from_node_set(nodes, X.node_set(nodes, "//customer[bal < 0]"))
    return found.groupBy(F.col("doc_id").cast("int").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT k AS doc_id, count(c) AS n FROM " + _CUST + " WHERE bal >= 0 GROUP BY 1 HAVING count(c) > 0")
def xpath_process(spark, sf_dir):
    """Selected nodes replaced, here by nothing."""
    new = X.process(nations(spark, sf_dir), "//customer[bal < 0]", lambda n: [])
    return new.where("name = 'customer'").groupBy(F.col("doc_id").cast("int").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))


# stylesheets: a text a nation

_ROOT = '<xsl:template match="/">{}</xsl:template>'
_EACH = '<xsl:for-each select="//customer"><xsl:sort select="@key" data-type="number"/>{}</xsl:for-each>'
_SHEETS = (
    ("choose", _ROOT.format(_EACH.format('<xsl:choose><xsl:when test="bal &lt; 0">n</xsl:when><xsl:when test="bal &lt; 5000">l</xsl:when><xsl:otherwise>h</xsl:otherwise></xsl:choose>')), "coalesce(string_agg(CASE WHEN bal < 0 THEN 'n' WHEN bal < 5000 THEN 'l' ELSE 'h' END, '' ORDER BY c) FILTER (c IS NOT NULL), '')"),
    ("if", _ROOT.format(_EACH.format('<xsl:if test="bal &lt; 0"><xsl:value-of select="@key"/>;</xsl:if>')), "coalesce(string_agg(c || ';', '' ORDER BY c) FILTER (bal < 0), '')"),
    (
        "call_template",
        _ROOT.format('<xsl:call-template name="sum"><xsl:with-param name="n" select="//bal"/></xsl:call-template>')
        + '<xsl:template name="sum"><xsl:param name="n"/><xsl:param name="t" select="0"/><xsl:choose><xsl:when test="$n"><xsl:call-template name="sum"><xsl:with-param name="n" select="$n[position() &gt; 1]"/><xsl:with-param name="t" select="$t + $n[1]"/></xsl:call-template></xsl:when><xsl:otherwise><xsl:value-of select="$t"/></xsl:otherwise></xsl:choose></xsl:template>',
        "coalesce(sum(bal), 0)::BIGINT::VARCHAR",
    ),
    ("key", '<xsl:key name="seg" match="customer" use="../@name"/>' + _ROOT.format("<xsl:value-of select=\"count(key('seg', 'BUILDING'))\"/>"), "count(*) FILTER (seg = 'BUILDING')::VARCHAR"),
    (
        "modes",
        '<xsl:template match="nation"><xsl:apply-templates select="group" mode="a"><xsl:sort select="@name"/></xsl:apply-templates>|<xsl:apply-templates select="group" mode="b"><xsl:sort select="@name" order="descending"/></xsl:apply-templates></xsl:template><xsl:template match="group" mode="a"><xsl:value-of select="count(customer)"/>,</xsl:template><xsl:template match="group" mode="b"><xsl:value-of select="substring(@name, 1, 1)"/></xsl:template>',
        None,
    ),
    (
        "priority",
        _ROOT.format('<xsl:apply-templates select="//customer"><xsl:sort select="@key" data-type="number"/></xsl:apply-templates>')
        + '<xsl:template match="*">x</xsl:template><xsl:template match="customer">c</xsl:template><xsl:template match="customer[bal &lt; 0]">n</xsl:template><xsl:template match="customer[bal &gt; 9000]" priority="-1">never</xsl:template>',
        "coalesce(string_agg(CASE WHEN bal < 0 THEN 'n' ELSE 'c' END, '' ORDER BY c) FILTER (c IS NOT NULL), '')",
    ),
    ("variable", '<xsl:variable name="m" select="count(//customer)"/>' + _ROOT.format('<xsl:variable name="t"><xsl:value-of select="$m * 2"/></xsl:variable><xsl:value-of select="concat($t, \'/\', $m)"/>'), "count(c) * 2 || '/' || count(c)"),
    ("format_number", _ROOT.format("<xsl:value-of select=\"format-number(count(//customer) * 12345, '#,##0')\"/>"), "format('{:,}', count(c) * 12345)"),
    ("default_rules", "", "coalesce(string_agg(bal, '' ORDER BY seg, c), '')"),
    ("copy_of", _ROOT.format('<xsl:copy-of select="//customer[@key mod 7 = 0]"/>'), "coalesce(string_agg('<customer key=\"' || c || '\"><bal>' || bal || '</bal></customer>', '' ORDER BY seg, c) FILTER (c % 7 = 0), '')"),
    (
        "copy",
        '<xsl:template match="@*|node()"><xsl:copy><xsl:apply-templates select="@*|node()"/></xsl:copy></xsl:template><xsl:template match="group"/><xsl:template match="@name"><xsl:attribute name="called"><xsl:value-of select="."/></xsl:attribute></xsl:template>',
        "'<nation key=\"' || k || '\" called=\"' || name || '\"/>'",
    ),
    ("message", _ROOT.format('<xsl:message>seen</xsl:message><xsl:value-of select="nation/@key"/>'), "k::VARCHAR"),
    ("element", _ROOT.format('<xsl:element name="n{nation/@key}"><xsl:attribute name="a"><xsl:value-of select="nation/@name"/></xsl:attribute><xsl:comment>c</xsl:comment></xsl:element>'), "'<n' || k || ' a=\"' || name || '\"><!--c--></n' || k || '>'"),
    ("literal", _ROOT.format('<r k="{nation/@key + 1}-{count(//group)}"><xsl:text> t </xsl:text></r>'), "'<r k=\"' || (k + 1) || '-' || count(DISTINCT seg) || '\"> t </r>'"),
    (
        "attribute_set",
        '<xsl:attribute-set name="base"><xsl:attribute name="b">1</xsl:attribute></xsl:attribute-set><xsl:attribute-set name="s" use-attribute-sets="base"><xsl:attribute name="a"><xsl:value-of select="nation/@key"/></xsl:attribute></xsl:attribute-set>' + _ROOT.format('<x xsl:use-attribute-sets="s"/>'),
        "'<x b=\"1\" a=\"' || k || '\"/>'",
    ),
    ("param", '<xsl:param name="p" select="3"/>' + _ROOT.format('<xsl:value-of select="$p + nation/@key"/>'), "(k + 3)::VARCHAR"),
)


def _sheet(body: str) -> str:
    return f'<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform">{body}</xsl:stylesheet>'


_MODES = (
    "SELECT k AS doc_id, coalesce(string_agg(m || ',', '' ORDER BY seg), '') || '|' || coalesce(string_agg(seg[1], '' ORDER BY seg DESC), '') AS text FROM "
    f"(SELECT k, seg, count(c) AS m FROM {_CUST} WHERE c IS NOT NULL GROUP BY 1, 2) GROUP BY 1"
)
for _name, _body, _sql in _SHEETS:
    query(_MODES if _sql is None else f"SELECT k AS doc_id, {_sql} AS text FROM {_CUST} GROUP BY k, name", f"xsl_{_name}")(
        lambda spark, sf_dir, b=_body, some=_sql is None: xslt.transform_to_text(nations(spark, sf_dir), _sheet(b)).where("text <> '|'" if some else "true").select(F.col("doc_id").cast("int"), "text")
    )

_PARTS = {
    "base.xsl": _sheet('<xsl:template match="nation">base:<xsl:value-of select="@name"/></xsl:template><xsl:template name="tail">!</xsl:template>'),
    "more.xsl": _sheet('<xsl:template name="head">[</xsl:template>'),
}


@query("SELECT n_nationkey AS doc_id, '[base:' || n_name || '!' AS text FROM nation")
def xsl_import_include(spark, sf_dir):
    """An import has less precedence and is reached by apply-imports; an include has the same."""
    body = '<xsl:import href="base.xsl"/><xsl:include href="more.xsl"/><xsl:template match="nation"><xsl:call-template name="head"/><xsl:apply-imports/><xsl:call-template name="tail"/></xsl:template>'
    return xslt.transform_to_text(nations(spark, sf_dir), _sheet(body), load=_PARTS.get).select(F.col("doc_id").cast("int"), "text")


@query("SELECT c_custkey AS doc_id, c_mktsegment || '| ' || c_name || ' ' AS text FROM customer")
def xsl_strip_space(spark, sf_dir):
    one = F.format_string("<d> <a>%s</a>\n <keep> <b>%s</b> </keep></d>", "c_mktsegment", "c_name")
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), one.alias("text"))
    body = '<xsl:strip-space elements="*"/><xsl:preserve-space elements="keep"/>' + _ROOT.format('<xsl:value-of select="d/a"/>|<xsl:value-of select="d/keep"/>')
    return xslt.transform_to_text(shred(docs), _sheet(body))


# Relax NG and XML Schema: whether a customer's document is valid

_RNG = (
    ("group", '<element name="bal"><text/></element><element name="name"><text/></element>', "true"),
    ("order_matters", '<element name="name"><text/></element><element name="bal"><text/></element>', "false"),
    ("interleave", '<interleave><element name="name"><text/></element><element name="bal"><text/></element></interleave>', "true"),
    ("choice", '<choice><element name="bal"><value>1</value></element><element name="bal"><data type="integer"><param name="minInclusive">0</param></data></element></choice><element name="name"><text/></element>', "floor(c_acctbal) >= 0"),
    ("value", '<element name="bal"><text/></element><element name="name"><choice><value>Customer#000000001</value><value>Customer#000000002</value></choice></element>', "c_name IN ('Customer#000000001', 'Customer#000000002')"),
    ("data", '<element name="bal"><data type="unsignedShort"><param name="maxExclusive">5000</param></data></element><element name="name"><text/></element>', "floor(c_acctbal) BETWEEN 0 AND 4999"),
    ("except", '<element name="bal"><data type="integer"><except><choice><value>0</value><value>100</value></choice></except></data></element><element name="name"><text/></element>', "floor(c_acctbal) NOT IN (0, 100)"),
    ("list", '<element name="bal"><list><data type="integer"/></list></element><element name="name"><list><oneOrMore><data type="token"/></oneOrMore></list></element>', "true"),
    ("optional", '<optional><element name="zip"><text/></element></optional><element name="bal"><text/></element><optional><element name="name"><text/></element></optional>', "true"),
    ("zero_or_more", '<zeroOrMore><choice><element name="bal"><text/></element><element name="name"><text/></element></choice></zeroOrMore>', "true"),
    ("one_or_more", '<oneOrMore><element name="bal"><text/></element></oneOrMore>', "false"),
    ("any_name", '<oneOrMore><element><anyName><except><name>zip</name></except></anyName><text/></element></oneOrMore>', "true"),
    ("mixed", '<mixed><element name="bal"><text/></element><element name="name"><text/></element></mixed>', "true"),
    ("not_allowed", "<notAllowed/>", "false"),
)


def _grammar(body: str, seg: str = "<text/>") -> str:
    return f'<element name="c" xmlns="http://relaxng.org/ns/structure/1.0" datatypeLibrary="http://www.w3.org/2001/XMLSchema-datatypes"><attribute name="key"><data type="nonNegativeInteger"/></attribute><attribute name="seg">{seg}</attribute>{body}</element>'


for _name, _body, _sql in _RNG:
    query(f"SELECT c_custkey AS doc_id, {_sql} AS ok FROM customer", f"rng_{_name}")(lambda spark, sf_dir, b=_body: rng.validate_rng(shred(customers(spark, sf_dir)), _grammar(b)).select("doc_id", "ok"))


@query("SELECT c_custkey AS doc_id, c_mktsegment IN ('BUILDING', 'MACHINERY') AS ok FROM customer")
def rng_attribute(spark, sf_dir):
    body = '<zeroOrMore><element><anyName/><text/></element></zeroOrMore>'
    return rng.validate_rng(shred(customers(spark, sf_dir)), _grammar(body, "<choice><value>BUILDING</value><value>MACHINERY</value></choice>")).select("doc_id", "ok")


@query("SELECT c_custkey AS doc_id, floor(c_acctbal) >= 0 AS ok FROM customer")
def rng_include_override(spark, sf_dir):
    """A grammar that includes another and replaces one of its definitions; recursion by name."""
    base = '<grammar xmlns="http://relaxng.org/ns/structure/1.0" datatypeLibrary="http://www.w3.org/2001/XMLSchema-datatypes"><start><ref name="c"/></start><define name="c"><element name="c"><attribute name="key"/><attribute name="seg"/><ref name="bal"/><element name="name"><text/></element></element></define><define name="bal"><element name="bal"><empty/></element></define></grammar>'
    own = '<grammar xmlns="http://relaxng.org/ns/structure/1.0" datatypeLibrary="http://www.w3.org/2001/XMLSchema-datatypes"><include href="base.rng"><define name="bal"><element name="bal"><data type="nonNegativeInteger"/></element></define></include></grammar>'
    return rng.validate_rng(shred(customers(spark, sf_dir)), own, load={"base.rng": base}.get).select("doc_id", "ok")


_SEG = '<xs:attribute name="key" type="xs:nonNegativeInteger" use="required"/><xs:attribute name="seg" type="{}"/>'
_XSD = (
    ("sequence", '<xs:sequence><xs:element name="bal" type="xs:int"/><xs:element name="name" type="xs:string"/></xs:sequence>', "xs:string", "", "true"),
    ("all", '<xs:all><xs:element name="name" type="xs:string"/><xs:element name="bal" type="xs:unsignedInt"/></xs:all>', "xs:string", "", "floor(c_acctbal) >= 0"),
    ("choice", '<xs:choice minOccurs="2" maxOccurs="2"><xs:element name="bal" type="xs:int"/><xs:element name="name" type="xs:NMTOKEN"/></xs:choice>', "xs:string", "", "regexp_full_match(c_name, '[A-Za-z0-9._:-]+')"),
    ("occurs", '<xs:sequence><xs:element name="bal" type="xs:int" maxOccurs="unbounded"/><xs:element name="name" type="xs:string" minOccurs="0"/><xs:element name="zip" type="xs:string" minOccurs="0"/></xs:sequence>', "xs:string", "", "true"),
    ("any", '<xs:sequence><xs:element name="bal" type="xs:int"/><xs:any processContents="skip"/></xs:sequence>', "xs:string", "", "true"),
    ("missing", '<xs:sequence><xs:element name="bal" type="xs:int"/></xs:sequence>', "xs:string", "", "false"),
    ("group_ref", '<xs:sequence><xs:group ref="g"/></xs:sequence>', "xs:string", '<xs:group name="g"><xs:sequence><xs:element name="bal" type="xs:int"/><xs:element name="name" type="xs:string"/></xs:sequence></xs:group>', "true"),
    ("enumeration", '<xs:sequence><xs:element name="bal" type="xs:int"/><xs:element name="name" type="xs:string"/></xs:sequence>', "seg", '<xs:simpleType name="seg"><xs:restriction base="xs:token"><xs:enumeration value="BUILDING"/><xs:enumeration value="FURNITURE"/></xs:restriction></xs:simpleType>', "c_mktsegment IN ('BUILDING', 'FURNITURE')"),
    ("union", '<xs:sequence><xs:element name="bal" type="u"/><xs:element name="name" type="xs:string"/></xs:sequence>', "xs:string", '<xs:simpleType name="small"><xs:restriction base="xs:int"><xs:maxInclusive value="100"/></xs:restriction></xs:simpleType><xs:simpleType name="large"><xs:restriction base="xs:int"><xs:minInclusive value="9000"/></xs:restriction></xs:simpleType><xs:simpleType name="u"><xs:union memberTypes="small large"/></xs:simpleType>', "floor(c_acctbal) <= 100 OR floor(c_acctbal) >= 9000"),
    ("list", '<xs:sequence><xs:element name="bal" type="l"/><xs:element name="name" type="xs:string"/></xs:sequence>', "xs:string", '<xs:simpleType name="l"><xs:list itemType="xs:nonNegativeInteger"/></xs:simpleType>', "floor(c_acctbal) >= 0"),
    ("facets", '<xs:sequence><xs:element name="bal" type="f"/><xs:element name="name" type="xs:string"/></xs:sequence>', "xs:string", '<xs:simpleType name="f"><xs:restriction base="xs:integer"><xs:totalDigits value="3"/></xs:restriction></xs:simpleType>', "abs(floor(c_acctbal)) <= 999"),
)
for _name, _body, _seg, _types, _sql in _XSD:
    _schema = f'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="c"><xs:complexType>{_body}{_SEG.format(_seg)}</xs:complexType></xs:element>{_types}</xs:schema>'
    query(f"SELECT c_custkey AS doc_id, {_sql} AS ok FROM customer", f"xsd_doc_{_name}")(lambda spark, sf_dir, s=_schema: xsd.validate_xsd(shred(customers(spark, sf_dir)), s).select("doc_id", "ok"))


# codecs: a customer's values to XML and back

_ID = K.attr("key", K.integer())
_CODECS = (
    ("attr", K.record(a=_ID, b=K.attr("seg")), '<c key="1" seg="%s"/>', ("c_custkey", "c_mktsegment")),
    ("elem", K.record(a=_ID, b=K.elem("seg", K.text())), None, ("c_custkey", "c_mktsegment")),
    ("elem_ns", K.record(a=_ID, b=K.elem("x:seg", K.text(), "urn:x")), None, ("c_custkey", "c_mktsegment")),
    ("text_attr", K.record(a=_ID, b=K.text_attr("seg")), None, ("c_custkey", "c_mktsegment")),
    ("option", K.record(a=_ID, b=K.option(K.elem("seg", K.text()))), None, ("c_custkey", "c_mktsegment")),
    ("attr_implied", K.record(a=_ID, b=K.attr_implied("seg")), None, ("c_custkey", "c_mktsegment")),
    ("default", K.record(a=_ID, b=K.default("BUILDING", K.attr("seg"))), None, ("c_custkey", "c_mktsegment")),
    ("add_fixed_attr", K.add_fixed_attr("version", "1", K.record(a=_ID, b=K.attr("seg"))), None, ("c_custkey", "c_mktsegment")),
    ("elem_with_attr", K.record(a=_ID, b=K.elem_with_attr("f", "kind", "seg", K.text())), None, ("c_custkey", "c_mktsegment")),
    ("alt", K.record(a=_ID, b=K.alt(lambda v: int(v < "F"), K.elem("late", K.text()), K.elem("early", K.text()))), None, ("c_custkey", "c_mktsegment")),
    ("wrap", K.record(a=_ID, b=K.wrap(K.elem("seg", K.text()), str.upper, str.lower)), None, ("c_custkey", "c_mktsegment")),
    ("xml_text", K.record(a=_ID, b=K.elem("seg", K.xml_text())), None, ("c_custkey", "c_mktsegment")),
)
for _name, _codec, _, _cols in _CODECS:

    def _run(spark, sf_dir, c=K.elem("c", _codec), cols=_cols):
        xml = table(spark, sf_dir, "customer").select(K.encode_col(F.struct(*[F.col(x).alias(y) for x, y in zip(cols, "ab", strict=True)]), c).alias("x"))
        return xml.select(K.decode_col(F.col("x"), c, "a long, b string").alias("v")).select("v.a", "v.b")

    query("SELECT c_custkey AS a, c_mktsegment AS b FROM customer", f"codec_{_name}")(_run)


def _decoded(name: str, codec: K.Codec, sql: str) -> None:
    """What a codec reads from the customers' documents, by its error."""

    def run(spark, sf_dir):
        got = customers(spark, sf_dir).select("doc_id", K.decode_col(F.col("text"), K.elem("c", codec), "a long").alias("v"))
        return got.select("doc_id", "v.a", F.col("v.error").isNull().alias("ok"))

    query(sql, f"codec_{name}")(run)


_OK = "SELECT c_custkey AS doc_id, {} AS a, {} AS ok FROM customer"
_decoded("ignore_cont", K.ignore_cont(K.ignore_attr(K.record(a=K.lift(7)))), _OK.format("7::BIGINT", "true"))
_decoded("filter_cont", K.ignore_attr(K.filter_cont(lambda n: n.name == "bal", K.record(a=K.elem("bal", K.integer())))), _OK.format("floor(c_acctbal)::BIGINT", "true"))
_decoded("filter_attr", K.filter_attr(lambda k: k == "key", K.ignore_cont(K.record(a=_ID))), _OK.format("c_custkey", "true"))
_decoded("check_empty", K.record(a=_ID), _OK.format("NULL::BIGINT", "false"))
_decoded("attr_fixed", K.ignore_cont(K.seq_fixed(K.attr_fixed("seg", "BUILDING"), K.record(a=_ID))), _OK.format("CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey END", "c_mktsegment = 'BUILDING'"))
_decoded("wrap_maybe", K.ignore_attr(K.filter_cont(lambda n: n.name == "bal", K.record(a=K.wrap_maybe(K.elem("bal", K.integer()), lambda v: v if v >= 0 else None, int)))), _OK.format("CASE WHEN floor(c_acctbal) >= 0 THEN floor(c_acctbal)::BIGINT END", "floor(c_acctbal) >= 0"))
_decoded("zero", K.zero(), _OK.format("NULL::BIGINT", "false"))


@query("SELECT vec_id AS a, len(embedding)::BIGINT AS n, round(list_sum(embedding)::DOUBLE, 3) AS total FROM embeddings")
def codec_list(spark, sf_dir):
    """A list of numbers as elements, each a row's whole vector."""
    c = K.elem("v", K.record(a=_ID, b=K.list_(K.elem("x", K.prim()))))
    rows = table(spark, sf_dir, "embeddings").select(F.struct(F.col("vec_id").alias("a"), F.col("embedding").cast("array<double>").alias("b")).alias("s"))
    got = rows.select(K.decode_col(K.encode_col(F.col("s"), c), c, "a long, b array<double>").alias("v"))
    return got.select("v.a", F.size("v.b").cast("long").alias("n"), F.round(F.aggregate("v.b", F.lit(0.0), lambda x, y: x + y), 3).alias("total"))
