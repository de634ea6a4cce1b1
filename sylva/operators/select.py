"""Selection on tables: the list-valued combinators as filters, joins, windows and aggregates.

A stage's rows carry a key (the input row) and an order; the functions take the key columns by name. On node tables the
key is (doc_id, node_id) and the order pre.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import NODE
from .axes import axis

KEY = ("doc_id", "node_id")


# nodes by kind and contents


def is_kind(kind: str) -> Column:
    return F.col("kind") == kind


def has_name(name: str) -> Column:
    return F.col("name") == name


def has_local(name: str) -> Column:
    return F.col("local") == name


def has_attr(name: str) -> Column:
    return F.coalesce(F.map_contains_key("attrs", name), F.lit(False))


def attr_value(name: str) -> Column:
    """The attribute's value, '' where there is none."""
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def attr_value0(nodes: DataFrame, name: str, as_: str = "value") -> DataFrame:
    """The attribute's value; a node without it gives no row."""
    return nodes.where(has_attr(name)).withColumn(as_, attr_value(name))


def is_white_space() -> Column:
    return is_kind("text") & F.col("value").rlike(r"^\s*$")


# filters by the results of another stage


def guards(df: DataFrame, test: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows for which the test has a result."""
    return df.join(test.select(*key).distinct(), list(key), "left_semi")


def neg(df: DataFrame, test: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows for which the test has none."""
    return df.join(test.select(*key), list(key), "left_anti")


containing, not_containing, filter_a = guards, neg, guards


def if_a(df: DataFrame, test: DataFrame, then: Callable[[DataFrame], DataFrame], other: Callable[[DataFrame], DataFrame], key: Sequence[str] = KEY) -> DataFrame:
    return then(guards(df, test, key)).unionByName(other(neg(df, test, key)))


def when(df: DataFrame, test: DataFrame, then: Callable[[DataFrame], DataFrame], key: Sequence[str] = KEY) -> DataFrame:
    return if_a(df, test, then, lambda x: x, key)


def choice(df: DataFrame, cases: Sequence[tuple[DataFrame, Callable[[DataFrame], DataFrame]]], key: Sequence[str] = KEY) -> DataFrame:
    """The first case whose test has a result; rows without one go."""
    out, rest = [], df
    for test, then in cases:
        out.append(then(guards(rest, test, key)))
        rest = neg(rest, test, key)
    return reduce(DataFrame.unionByName, out)


def or_else(first: DataFrame, second: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The first stage's results of each input, or the second's where the first has none."""
    return first.unionByName(second.join(first.select(*key), list(key), "left_anti"))


def tag(df: DataFrame, test: DataFrame, key: Sequence[str] = KEY, as_: str = "tagged") -> DataFrame:
    """All rows, with whether the test has a result."""
    marks = test.select(*key).distinct().withColumn(as_, F.lit(True))
    return df.join(marks, list(key), "left").withColumn(as_, F.coalesce(as_, F.lit(False)))


# lists


def single(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first result of each input."""
    return take_n(df, key, order, 1)


def take_n(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def list_a(inputs: DataFrame, results: DataFrame, key: Sequence[str], order: str, value: str, as_: str = "items") -> DataFrame:
    """A list of each input's results in order; an empty one where there are none."""
    lists = results.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value)))), lambda x: x[value]).alias(as_))
    empty = F.array().cast(lists.schema[as_].dataType)
    return inputs.join(lists, list(key), "left").withColumn(as_, F.coalesce(as_, empty))


def unlist(df: DataFrame, column: str, as_: str = "item") -> DataFrame:
    return df.select(*[c for c in df.columns if c != column], F.posexplode(column).alias("ord", as_))


def aggregate(inputs: DataFrame, results: DataFrame, key: Sequence[str], what: Column, as_: str, empty) -> DataFrame:
    """One value of each input's results; `empty` where there are none."""
    return inputs.join(results.groupBy(*key).agg(what.alias(as_)), list(key), "left").withColumn(as_, F.coalesce(as_, F.lit(empty)))


def with_default(inputs: DataFrame, results: DataFrame, key: Sequence[str], value: str, default) -> DataFrame:
    """The results, and for inputs without one a row with the default."""
    return inputs.select(*key).distinct().join(results.select(*key, value, F.lit(True).alias("_has")), list(key), "left").withColumn(value, F.when(F.col("_has"), F.col(value)).otherwise(F.lit(default))).drop("_has")


def cat(*stages: DataFrame) -> DataFrame:
    """All results, in the stages' order (branch is the leading order)."""
    return reduce(DataFrame.unionByName, [s.withColumn("branch", F.lit(k)) for k, s in enumerate(stages)])


def seq(df: DataFrame, *stages: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return reduce(lambda x, f: x.transform(f), stages, df)


def none(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def span(items: Column, test: Callable[[Column], Column]) -> tuple[Column, Column]:
    """A list's longest leading part whose items pass, and the rest."""
    bad = F.array_position(F.transform(items, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))
    n = F.when(bad == 0, F.size(items)).otherwise(bad - 1).cast("int")
    return F.slice(items, F.lit(1), n), F.slice(items, n + 1, F.greatest(F.size(items) - n, F.lit(0)))


def partition(items: Column, test: Callable[[Column], Column]) -> tuple[Column, Column]:
    """A list's items that pass, and the others."""
    return F.filter(items, test), F.filter(items, lambda x: ~F.coalesce(test(x), F.lit(False)))


# trees


def children(ctx: DataFrame, nodes: DataFrame, test: Column | None = None) -> DataFrame:
    """ctx /> test."""
    return axis(ctx, nodes, "child", test, positions=False)


def multi(nodes: DataFrame, test: Column) -> DataFrame:
    """All nodes that pass, nested ones too."""
    return nodes.where(test)


def _nested(nodes: DataFrame, test: Column) -> DataFrame:
    """Nodes that pass, with _above (a passing ancestor exists) and _below (a passing descendant exists).

    One pass in document order: the furthest end of passing nodes before tells whether one of them is still open.
    """
    hit = nodes.where(test)
    w = Window.partitionBy("doc_id").orderBy("pre")
    end = F.max(F.col("pre") + F.col("size")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead("pre").over(w)
    return hit.withColumn("_above", F.coalesce(end >= F.col("pre"), F.lit(False))).withColumn("_below", F.coalesce(after <= F.col("pre") + F.col("size"), F.lit(False)))


def deep(nodes: DataFrame, test: Column) -> DataFrame:
    """The topmost nodes that pass, one on each path."""
    return _nested(nodes, test).where(~F.col("_above")).drop("_above", "_below")


def deepest(nodes: DataFrame, test: Column) -> DataFrame:
    """The innermost nodes that pass."""
    return _nested(nodes, test).where(~F.col("_below")).drop("_above", "_below")


def deep_below(ctx: DataFrame, nodes: DataFrame, test: Column) -> DataFrame:
    """ctx //> test: the topmost passing nodes below each context node."""
    found = axis(ctx, nodes, "descendant", test, positions=False)
    w = Window.partitionBy("doc_id", "c_node_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    open_to = F.max(F.col("pre") + F.col("size")).over(w)
    return found.withColumn("_end", open_to).where(F.col("_end").isNull() | (F.col("_end") < F.col("pre"))).drop("_end")


def having_child(ctx: DataFrame, nodes: DataFrame, test: Column) -> DataFrame:
    """ctx </ test: context nodes with a child that passes."""
    kids = nodes.where(test).select("doc_id", F.col("parent_id").alias("node_id"))
    return guards(ctx, kids)


def tree_stats(nodes: DataFrame) -> DataFrame:
    """doc_id, depth and number of nodes of each tree."""
    return nodes.groupBy("doc_id").agg((F.max("level") + 1).alias("depth"), F.count(F.lit(1)).alias("card"))


# edits that keep to single rows or whole subtrees


def change(nodes: DataFrame, test: Column, **columns: Column) -> DataFrame:
    """New payloads of the nodes that pass."""
    return nodes.withColumns({k: F.when(test, v).otherwise(F.col(k)) for k, v in columns.items()})


def remove(nodes: DataFrame, test: Column) -> DataFrame:
    """The nodes without the subtrees whose top passes, renumbered."""
    w = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    end = F.max(F.when(test, F.col("pre") + F.col("size"))).over(w)
    return renumber(nodes.withColumn("_end", end).where(F.col("_end").isNull() | (F.col("_end") < F.col("pre"))).drop("_end"))


def renumber(nodes: DataFrame) -> DataFrame:
    """Fresh node_id, pre, size, parent_id and sib where whole subtrees have gone, from the old numbers.

    A row's new number is its rank; its new size is the number of rows left within its old subtree, a range count by
    old number. Both are windows on a document in order.
    """
    doc = Window.partitionBy("doc_id").orderBy("pre")
    new = nodes.withColumn("_new", F.row_number().over(doc).cast("long") - 1)
    left = new.select("doc_id", F.col("pre").alias("_at"), F.lit(0).alias("_q"), F.col("pre").alias("_of"))
    ends = new.select("doc_id", (F.col("pre") + F.col("size")).alias("_at"), F.lit(1).alias("_q"), F.col("pre").alias("_of"))
    upto = F.sum(1 - F.col("_q")).over(Window.partitionBy("doc_id").orderBy("_at", "_q").rowsBetween(Window.unboundedPreceding, 0))
    count = left.union(ends).withColumn("_upto", upto).where("_q = 1").select("doc_id", F.col("_of").alias("pre"), "_upto")
    parents = new.select("doc_id", F.col("node_id").alias("parent_id"), F.col("_new").alias("_up"))
    linked = new.join(count, ["doc_id", "pre"]).join(parents, ["doc_id", "parent_id"], "left")
    sib = F.row_number().over(Window.partitionBy("doc_id", "_up").orderBy("_new")) - 1
    return linked.select("doc_id", F.col("_new").alias("node_id"), F.col("_new").alias("pre"), (F.col("_upto") - 1 - F.col("_new")).alias("size"), "level", F.col("_up").alias("parent_id"), F.when(F.col("_up").isNull(), 0).otherwise(sib).alias("sib"), *NODE.fieldNames()[7:])
