"""Predicates, accessors, changes and constructors of node rows, as columns over a NODE table: nothing here leaves the JVM.

A predicate is a boolean column for where(). An accessor keeps the rows of its kind of node and adds a column, so a node of another kind gives
no row, not a null. A change gives the table with one component rewritten in the nodes of its kind; the others stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import NODE

Text = Callable[[Column], Column]
NAMED = ("element", "attr", "pi")


def _kind(*kinds: str) -> Callable[[], Column]:
    return lambda: F.col("kind").isin(*kinds)


# predicates

is_text = is_blob = _kind("text")  # bytes are decoded when they are read, so a blob is text
is_char_ref, is_entity_ref, is_cmt, is_cdata, is_pi = (_kind(k) for k in ("charref", "entityref", "comment", "cdata", "pi"))
is_elem, is_dtd, is_attr, is_error, is_root = (_kind(k) for k in ("element", "dtd", "attr", "error", "root"))


def is_xml_pi() -> Column:
    return is_pi() & (F.col("name") == "xml")


def is_white_space() -> Column:
    return is_text() & F.col("value").rlike(r"^[ \t\r\n]*$")


def has_text(p: Text) -> Column:
    return is_text() & p(F.col("value"))


def has_name_with(p: Text) -> Column:
    return F.col("name").isNotNull() & p(F.col("name"))


def has_qname(uri: str, local: str) -> Column:
    return has_namespace_uri(uri) & has_local_part(local)


def has_name(name: str) -> Column:
    return F.coalesce(F.col("name") == name, F.lit(False))


def has_local_part(local: str) -> Column:
    return F.coalesce(F.col("local") == local, F.lit(False))


def has_name_prefix(prefix: str) -> Column:
    return F.coalesce(F.col("prefix") == prefix, F.lit(False))


def has_namespace_uri(uri: str) -> Column:
    return F.coalesce(F.col("ns_uri") == uri, F.lit(False))


def has_attr(name: str) -> Column:
    return F.coalesce(F.map_contains_key("attrs", name), F.lit(False))


def has_attr_value(name: str, p: Text) -> Column:
    return has_attr(name) & F.coalesce(p(F.try_element_at("attrs", F.lit(name))), F.lit(False))


def qattr_name(nodes: DataFrame, uri: str, local: str, as_: str = "attr_name") -> DataFrame:
    """The nodes with the written name of their attribute local in the namespace uri; the prefixes in scope come from the declarations of the node and its ancestors.

    The declarations alone are joined with the nodes (by document and range), so that the table is read twice but no document is gathered.
    """
    declared = nodes.where(is_elem()).select("doc_id", "pre", "size", F.explode("attrs").alias("d", "u")).where(F.col("d").startswith("xmlns:")).select("doc_id", F.col("pre").alias("_p"), F.col("size").alias("_s"), F.substring("d", 7, 1 << 20).alias("_x"), "u")
    named = nodes.where(F.size(F.filter(F.map_keys("attrs"), lambda k: k.endswith(f":{local}"))) > 0).select("doc_id", "pre", F.explode(F.map_keys("attrs")).alias(as_)).where(F.col(as_).endswith(f":{local}"))
    scoped = named.join(declared, "doc_id").where((F.col("pre") >= F.col("_p")) & (F.col("pre") <= F.col("_p") + F.col("_s")) & (F.col(as_) == F.concat("_x", F.lit(f":{local}"))))
    nearest = scoped.groupBy("doc_id", "pre", as_).agg(F.max_by("u", "_p").alias("u")).where(F.col("u") == uri).select("doc_id", "pre", as_)
    return nodes.join(nearest, ["doc_id", "pre"])


def has_qattr(nodes: DataFrame, uri: str, local: str) -> DataFrame:
    """The nodes with an attribute of that qualified name."""
    return qattr_name(nodes, uri, local, "_n").select(*nodes.columns)


def has_qattr_value(nodes: DataFrame, uri: str, local: str, p: Text) -> DataFrame:
    return get_qattr_value0(nodes, uri, local, "_v").where(p(F.col("_v"))).select(*nodes.columns)


_DECLARATIONS = {"doctype": None, "element": "ELEMENT", "attlist": "ATTLIST", "entity": "ENTITY", "pentity": "PENTITY", "notation": "NOTATION"}


def _dtd(part: str) -> Callable[[], Column]:
    name = _DECLARATIONS[part]
    return lambda: is_dtd() & (F.col("value").isNotNull() if name is None else F.col("value").isNull() & (F.col("name") == name))


is_dtd_doctype, is_dtd_element, is_dtd_attlist, is_dtd_entity, is_dtd_pentity, is_dtd_notation = (_dtd(p) for p in _DECLARATIONS)


def has_dtd_attr(name: str) -> Column:
    return is_dtd() & has_attr(name)


# accessors


def _get(nodes: DataFrame, where: Column, value: Column, as_: str) -> DataFrame:
    return nodes.where(where).withColumn(as_, value)


def get_text(nodes: DataFrame, as_: str = "got") -> DataFrame:
    return _get(nodes, is_text(), F.col("value"), as_)


def get_blob(nodes: DataFrame, as_: str = "got") -> DataFrame:
    return _get(nodes, is_text(), F.encode("value", "UTF-8"), as_)


def get_cmt(nodes: DataFrame, as_: str = "got") -> DataFrame:
    return _get(nodes, is_cmt(), F.col("value"), as_)


def get_cdata(nodes: DataFrame, as_: str = "got") -> DataFrame:
    return _get(nodes, is_cdata(), F.col("value"), as_)


def get_char_ref(nodes: DataFrame, as_: str = "got") -> DataFrame:
    return _get(nodes, is_char_ref(), F.col("value").cast("int"), as_)


def get_entity_ref(nodes: DataFrame, as_: str = "got") -> DataFrame:
    return _get(nodes, is_entity_ref(), F.col("name"), as_)


def get_pi_name(nodes: DataFrame, as_: str = "got") -> DataFrame:
    return _get(nodes, is_pi(), F.col("name"), as_)


def get_pi_content(nodes: DataFrame, as_: str = "got") -> DataFrame:
    return _get(nodes, is_pi(), F.coalesce("value", F.lit("")), as_)


def get_elem_name(nodes: DataFrame, as_: str = "got") -> DataFrame:
    return _get(nodes, is_elem(), F.col("name"), as_)


def get_attr_name(nodes: DataFrame, as_: str = "got") -> DataFrame:
    return _get(nodes, is_attr(), F.col("name"), as_)


def get_name(nodes: DataFrame, as_: str = "got") -> DataFrame:
    return _get(nodes, F.col("kind").isin(*NAMED), F.col("name"), as_)


def get_qname(nodes: DataFrame, as_: str = "got") -> DataFrame:
    """A struct of prefix, local and ns_uri."""
    return _get(nodes, F.col("kind").isin(*NAMED), F.struct("prefix", "local", "ns_uri"), as_)


def get_local_part(nodes: DataFrame, as_: str = "got") -> DataFrame:
    return _get(nodes, F.col("kind").isin(*NAMED), F.col("local"), as_)


def get_name_prefix(nodes: DataFrame, as_: str = "got") -> DataFrame:
    return _get(nodes, F.col("kind").isin(*NAMED), F.col("prefix"), as_)


def get_namespace_uri(nodes: DataFrame, as_: str = "got") -> DataFrame:
    return _get(nodes, F.col("kind").isin(*NAMED), F.col("ns_uri"), as_)


def get_universal_name(nodes: DataFrame, as_: str = "got") -> DataFrame:
    """{uri}local, or the local name where there is no namespace."""
    return _get(nodes, F.col("kind").isin(*NAMED), F.concat(F.when(F.col("ns_uri") != "", F.concat(F.lit("{"), "ns_uri", F.lit("}"))).otherwise(""), "local"), as_)


def get_universal_uri(nodes: DataFrame, as_: str = "got") -> DataFrame:
    """The URI and the local name, one after the other."""
    return _get(nodes, F.col("kind").isin(*NAMED), F.concat("ns_uri", "local"), as_)


def get_attrl(nodes: DataFrame) -> DataFrame:
    """A row for each attribute, in the order in which they are written: the node's columns, attr_pos, attr_name and attr_value."""
    return nodes.where(is_elem() | is_root()).select("*", F.posexplode(F.map_entries("attrs")).alias("attr_pos", "_e")).select(*nodes.columns, "attr_pos", F.col("_e.key").alias("attr_name"), F.col("_e.value").alias("attr_value"))


def get_attr_value(nodes: DataFrame, name: str, as_: str = "got") -> DataFrame:
    """The attribute's value, or an empty text where there is none."""
    return _get(nodes, is_elem() | is_root(), F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit("")), as_)


def get_attr_value0(nodes: DataFrame, name: str, as_: str = "got") -> DataFrame:
    """The attribute's value; no row where there is none."""
    return _get(nodes, has_attr(name), F.element_at("attrs", name), as_)


def get_qattr_value(nodes: DataFrame, uri: str, local: str, as_: str = "got") -> DataFrame:
    found = get_qattr_value0(nodes, uri, local, as_).select("doc_id", "pre", as_)
    return nodes.where(is_elem()).join(found, ["doc_id", "pre"], "left").withColumn(as_, F.coalesce(as_, F.lit("")))


def get_qattr_value0(nodes: DataFrame, uri: str, local: str, as_: str = "got") -> DataFrame:
    return qattr_name(nodes, uri, local, "_n").withColumn(as_, F.element_at("attrs", F.col("_n"))).select(*nodes.columns, as_)


def get_dtd_part(nodes: DataFrame, as_: str = "got") -> DataFrame:
    """The kind of a declaration: DOCTYPE, ELEMENT, ATTLIST, ENTITY, PENTITY or NOTATION."""
    return _get(nodes, is_dtd(), F.when(is_dtd_doctype(), "DOCTYPE").otherwise(F.col("name")), as_)


def get_dtd_attrl(nodes: DataFrame, as_: str = "got") -> DataFrame:
    return _get(nodes, is_dtd(), F.coalesce("attrs", F.create_map().cast("map<string,string>")), as_)


def get_dtd_attr_value(nodes: DataFrame, name: str, as_: str = "got") -> DataFrame:
    return _get(nodes, has_dtd_attr(name), F.element_at("attrs", name), as_)


def get_error_level(nodes: DataFrame, as_: str = "got") -> DataFrame:
    return _get(nodes, is_error(), F.col("attrs")["level"].cast("int"), as_)


def get_error_msg(nodes: DataFrame, as_: str = "got") -> DataFrame:
    return _get(nodes, is_error(), F.col("value"), as_)


# changes


def _change(nodes: DataFrame, where: Column, column: str, value: Column) -> DataFrame:
    return nodes.withColumn(column, F.when(where, value).otherwise(F.col(column)))


def _rename(nodes: DataFrame, where: Column, name: Column) -> DataFrame:
    """Names, and the prefix and local part with them; a new prefix has no namespace until namespaces are propagated again."""
    prefixed = name.contains(":")
    new = {"prefix": F.when(prefixed, F.substring_index(name, ":", 1)).otherwise(""), "local": F.when(prefixed, F.substring(name, F.instr(name, ":") + 1, F.length(name))).otherwise(name), "name": name}
    return nodes.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in new.items()})


def change_text(nodes: DataFrame, f: Text) -> DataFrame:
    return _change(nodes, is_text(), "value", f(F.col("value")))


change_blob = change_text


def change_cmt(nodes: DataFrame, f: Text) -> DataFrame:
    return _change(nodes, is_cmt(), "value", f(F.col("value")))


def change_elem_name(nodes: DataFrame, f: Text) -> DataFrame:
    return _rename(nodes, is_elem(), f(F.col("name")))


def change_attr_name(nodes: DataFrame, f: Text) -> DataFrame:
    """The names of all attributes of the elements."""
    return _change(nodes, is_elem() & F.col("attrs").isNotNull(), "attrs", F.transform_keys("attrs", lambda k, v: f(k)))


def change_pi_name(nodes: DataFrame, f: Text) -> DataFrame:
    return _rename(nodes, is_pi(), f(F.col("name")))


def change_qname(nodes: DataFrame, f: Text) -> DataFrame:
    """The names of elements and instructions."""
    return _rename(nodes, is_elem() | is_pi(), f(F.col("name")))


def change_attr_value(nodes: DataFrame, name: str, f: Text) -> DataFrame:
    return _change(nodes, has_attr(name), "attrs", F.transform_values("attrs", lambda k, v: F.when(k == name, f(v)).otherwise(v)))


def change_attrl(nodes: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """f of the map of attributes, an empty one where there is none."""
    return _change(nodes, is_elem(), "attrs", f(F.coalesce("attrs", F.create_map().cast("map<string,string>"))))


def set_elem_name(nodes: DataFrame, where: Column, name: str) -> DataFrame:
    return _rename(nodes, is_elem() & where, F.lit(name))


def set_qname(nodes: DataFrame, where: Column, prefix: str, local: str, uri: str) -> DataFrame:
    own = F.col("kind").isin("element", "pi") & where
    return _rename(_change(nodes, own, "ns_uri", F.lit(uri)), own, F.lit(f"{prefix}:{local}" if prefix else local))  # names last, as the condition may ask for them


def set_pi_name(nodes: DataFrame, where: Column, name: str) -> DataFrame:
    return _rename(nodes, is_pi() & where, F.lit(name))


def set_attr_name(nodes: DataFrame, old: str, new: str) -> DataFrame:
    return change_attr_name(nodes, lambda k: F.when(k == old, new).otherwise(k))


def set_attrl(nodes: DataFrame, where: Column, attrs: dict[str, str]) -> DataFrame:
    return _change(nodes, is_elem() & where, "attrs", _map(attrs))


def add_attrl(nodes: DataFrame, where: Column, attrs: dict[str, str]) -> DataFrame:
    """New attributes; one of the same name is replaced."""
    kept = F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*attrs))
    return _change(nodes, is_elem() & where, "attrs", F.map_concat(kept, _map(attrs)))


def add_attr(nodes: DataFrame, where: Column, name: str, value: str) -> DataFrame:
    return add_attrl(nodes, where, {name: value})


def remove_attr(nodes: DataFrame, name: str) -> DataFrame:
    return _change(nodes, is_elem() & has_attr(name), "attrs", F.map_filter("attrs", lambda k, v: k != name))


def remove_qattr(nodes: DataFrame, uri: str, local: str) -> DataFrame:
    found = qattr_name(nodes, uri, local, "_n").select("doc_id", "pre", "_n")
    joined = nodes.join(found, ["doc_id", "pre"], "left")
    return joined.withColumn("attrs", F.when(F.col("_n").isNotNull(), F.map_filter("attrs", lambda k, v: k != F.col("_n"))).otherwise(F.col("attrs"))).select(*nodes.columns)


def set_dtd_attr_value(nodes: DataFrame, name: str, value: str) -> DataFrame:
    kept = F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string,string>")), lambda k, v: k != name)
    return _change(nodes, is_dtd(), "attrs", F.map_concat(kept, _map({name: value})))


def _map(attrs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in attrs.items() for x in kv]).cast("map<string,string>") if attrs else F.create_map().cast("map<string,string>")


# constructors: rows without a place in a document yet


def node(kind: str, name: Column | str | None = None, value: Column | str | None = None, attrs: dict[str, Column | str] | None = None) -> Column:
    """A struct of NODE's columns for one node."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    name = lit(name)
    parts = {
        "kind": F.lit(kind), "prefix": F.when(name.contains(":"), F.substring_index(name, ":", 1)).otherwise(F.when(name.isNotNull(), "")), "local": F.substring_index(name, ":", -1), "name": name, "value": lit(value),
        "attrs": F.create_map(*[x for k, v in attrs.items() for x in (F.lit(k), lit(v))]) if attrs else F.lit(None),
    }
    return F.struct(*[parts.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in NODE.fields])


def mk_text(value: Column | str) -> Column:
    return node("text", None, value)


mk_blob = mk_text


def mk_cmt(value: Column | str) -> Column:
    return node("comment", None, value)


def mk_cdata(value: Column | str) -> Column:
    return node("cdata", None, value)


def mk_char_ref(code: int | Column) -> Column:
    return node("charref", None, (code if isinstance(code, Column) else F.lit(code)).cast("string"))


def mk_entity_ref(name: Column | str) -> Column:
    return node("entityref", name)


def mk_pi(name: Column | str, value: Column | str = "") -> Column:
    return node("pi", name, value)


def mk_element(name: Column | str, attrs: dict[str, Column | str] | None = None) -> Column:
    return node("element", name, None, attrs)


def mk_attr(name: Column | str, value: Column | str) -> Column:
    return node("attr", name, value)


def mk_error(level: int, value: Column | str) -> Column:
    return node("error", None, value, {"level": str(level)})


def mk_dtd_elem(part: str, attrs: dict[str, Column | str]) -> Column:
    """A declaration: part is doctype, element, attlist, entity, pentity or notation."""
    if part == "doctype":
        return node("dtd", attrs["name"], F.concat(F.lit("<!DOCTYPE "), attrs["name"] if isinstance(attrs["name"], Column) else F.lit(attrs["name"]), F.lit(">")), {k: v for k, v in attrs.items() if k != "name"})
    return node("dtd", _DECLARATIONS[part], None, attrs)


def mk_dtd_doctype(attrs: dict[str, Column | str]) -> Column:
    return mk_dtd_elem("doctype", attrs)


def mk_dtd_element(attrs: dict[str, Column | str]) -> Column:
    return mk_dtd_elem("element", attrs)


def mk_dtd_entity(attrs: dict[str, Column | str]) -> Column:
    return mk_dtd_elem("entity", attrs)


def mk_dtd_pentity(attrs: dict[str, Column | str]) -> Column:
    return mk_dtd_elem("pentity", attrs)


def table_of(spark: SparkSession, *made: Column) -> DataFrame:
    """A NODE table of one document whose rows are the given nodes, each a child of a root."""
    rows = spark.range(1).select(F.posexplode(F.array(node("root", "/"), *made)).alias("_k", "n")).select("_k", "n.*")
    top = F.col("_k") == 0
    place = {"doc_id": F.lit(0), "node_id": F.col("_k"), "pre": F.col("_k"), "size": F.when(top, len(made)).otherwise(0), "level": F.when(top, 0).otherwise(1), "parent_id": F.when(~top, 0), "sib": F.greatest(F.col("_k") - 1, F.lit(0))}
    return rows.select(*[(place[f.name].cast(f.dataType) if f.name in place else F.col(f.name)).alias(f.name) for f in NODE.fields])
