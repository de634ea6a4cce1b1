"""The axes as joins on node tables: an equi-join on the document with an equality or a range on pre and size.

ctx is any table with doc_id and node_id of context nodes (c_ctx, if there, is carried along); the result holds, for each context
node and node on the axis, the node's columns, c_node_id and axis_pos, the node's place on the axis from 1.

Children, parents and siblings join on the document and the parent. Axes up and down join on the document and a bucket of BUCKET places, over which
the wider of the two nodes is spread, so a large document is many keys and no task compares all its nodes with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import NODE

REVERSE = frozenset(("parent", "ancestor", "ancestor-or-self", "preceding", "preceding-sibling"))
#: Places in document order that share a key of a join up or down.
BUCKET = 4096
DOWN = frozenset(("descendant", "descendant-or-self", "rev-descendant-or-self"))
UP = frozenset(("ancestor", "ancestor-or-self"))
NAMES = ("self", "child", "parent", "descendant", "descendant-or-self", "ancestor", "ancestor-or-self", "following", "preceding", "following-sibling", "preceding-sibling", "attribute")
#: Two more, which XPath does not have.
EXTRA = ("descendant-or-following", "rev-descendant-or-self")


def _rule(axis: str) -> Column:
    """The join condition besides the document, of node n and context c."""
    n, c = (lambda x: F.col(f"n.{x}")), (lambda x: F.col(f"c.c_{x}"))
    low = (n("pre") > c("pre")) & (n("pre") <= c("pre") + c("size"))
    up = (n("pre") < c("pre")) & (c("pre") <= n("pre") + n("size"))
    same = n("pre") == c("pre")
    return {
        "self": same,
        "child": n("parent_id") == c("node_id"),
        "parent": n("node_id") == c("parent_id"),
        "descendant": low,
        "descendant-or-self": low | same,
        "rev-descendant-or-self": low | same,
        "ancestor": up,
        "ancestor-or-self": up | same,
        "following": n("pre") > c("pre") + c("size"),
        "preceding": n("pre") + n("size") < c("pre"),
        "descendant-or-following": n("pre") > c("pre"),
        "following-sibling": (n("parent_id") == c("parent_id")) & (n("sib") > c("sib")),
        "preceding-sibling": (n("parent_id") == c("parent_id")) & (n("sib") < c("sib")),
    }[axis]


def attributes(nodes: DataFrame) -> DataFrame:
    """Attribute rows (kind attr) of elements: parent_id is the element, pre its own; sib the place by name."""
    found = nodes.where("kind = 'element' and attrs is not null").select("*", F.posexplode(F.array_sort(F.map_entries("attrs"))).alias("k", "e"))
    name = F.col("e.key")
    cut = F.instr(name, ":")
    return found.select(
        "doc_id", (-F.shiftleft("node_id", 20) - F.col("k") - 1).alias("node_id"), "pre", F.lit(0).cast("long").alias("size"), (F.col("level") + 1).alias("level"), F.col("node_id").alias("parent_id"), F.col("k").alias("sib"),
        F.lit("attr").alias("kind"), F.when(cut > 0, F.substring(name, F.lit(1), cut - 1)).otherwise("").alias("prefix"), F.when(cut > 0, F.expr("substring(e.key, instr(e.key, ':') + 1)")).otherwise(name).alias("local"),
        F.lit("").alias("ns_uri"), name.alias("name"), F.col("e.value").alias("value"), F.lit(None).cast("map<string,string>").alias("attrs"),
    )


def axis(ctx: DataFrame, nodes: DataFrame, name: str, test: Column | None = None, positions: bool = True) -> DataFrame:
    """Nodes on an axis that pass the test (a condition on their columns), with axis_pos and axis_last, counted among those that pass."""
    if name == "attribute":
        nodes, name = attributes(nodes), "child"
    if test is not None:
        nodes = nodes.where(test)
    own = [F.col(x) for x in nodes.columns]
    c = ctx.select(F.col("doc_id").alias("c_doc_id"), *[F.col(x).alias(f"c_{x}") for x in ctx.columns if x != "doc_id" and not x.startswith("c_")], *[x for x in ctx.columns if x == "c_ctx"]).alias("c")
    n, same = nodes.select(*own), F.col("n.doc_id") == F.col("c.c_doc_id")
    if name in DOWN | UP:
        bucket = lambda pre: F.floor(F.col(pre) / BUCKET)
        spread = lambda pre, size: F.explode(F.sequence(bucket(pre), F.floor((F.col(pre) + F.col(size)) / BUCKET)))
        n = n.withColumn("_bucket", bucket("pre") if name in DOWN else spread("pre", "size"))
        c = c.withColumn("c__bucket", spread("c_pre", "c_size") if name in DOWN else bucket("c_pre")).alias("c")
        same &= F.col("n._bucket") == F.col("c.c__bucket")
    joined = n.alias("n").join(c, same & _rule(name))
    out = joined.select(*[F.col(f"n.{x}") for x in nodes.columns], *[F.col(f"c.{x}") for x in c.columns if x in ("c_node_id", "c_pre", "c_ctx")])
    if not positions:
        return out
    order = F.col("pre").desc() if name in REVERSE or name.startswith("rev-") else F.col("pre")
    w = Window.partitionBy("doc_id", "c_node_id", *[x for x in out.columns if x == "c_ctx"])
    ranked = w.orderBy(order, F.col("sib"))
    return out.withColumn("axis_pos", F.row_number().over(ranked)).withColumn("axis_last", F.count(F.lit(1)).over(w))


def move(ctx: DataFrame, nodes: DataFrame, where: str) -> DataFrame:
    """One step: up, down (first child), left or right (next sibling)."""
    name = {"up": "parent", "down": "child", "left": "preceding-sibling", "right": "following-sibling"}[where]
    return axis(ctx, nodes, name).where("axis_pos = 1").drop("axis_pos", "axis_last")


def to_root(ctx: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.where("level = 0").join(ctx.select("doc_id").distinct(), "doc_id", "left_semi")


def at_root(nodes: DataFrame) -> DataFrame:
    return nodes.where("level = 0")


def move_on(ctx: DataFrame, nodes: DataFrame, name: str, test: Column | None = None) -> DataFrame:
    """The first node on an axis that passes a test."""
    return axis(ctx, nodes, name, test).where("axis_pos = 1").drop("axis_pos", "axis_last")


def string_value(ctx: DataFrame, nodes: DataFrame, as_: str = "string_value") -> DataFrame:
    """doc_id, node_id and string value of each context node: its texts in order, or its own value."""
    texts = axis(ctx, nodes, "descendant", F.col("kind").isin("text", "cdata"), positions=False)
    joined = texts.groupBy("doc_id", F.col("c_node_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "value"))), lambda x: x["value"]), "").alias("_s"))
    keyed = ctx.select("doc_id", "node_id", "kind", "value").join(joined, ["doc_id", "node_id"], "left")
    return keyed.select("doc_id", "node_id", F.when(F.col("kind").isin("element", "root"), F.coalesce("_s", F.lit(""))).otherwise(F.coalesce("value", F.lit(""))).alias(as_))


def subtree(ctx: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of each context node's subtree, renumbered from 0; c_node_id tells the subtrees apart."""
    found = axis(ctx, nodes, "descendant-or-self", positions=False)
    base = F.col("c_pre")
    top = F.min("level").over(Window.partitionBy("doc_id", "c_node_id"))
    return found.select("doc_id", (F.col("node_id") - base).alias("node_id"), (F.col("pre") - base).alias("pre"), "size", (F.col("level") - top).alias("level"), F.when(F.col("pre") > base, F.col("parent_id") - base).alias("parent_id"), *NODE.fieldNames()[6:], "c_node_id")
