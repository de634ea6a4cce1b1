"""The tree model: Node in a document, and NODE, the row that a node becomes.

Rows carry the pre-order number, subtree size, level, parent and place among siblings, so that each axis is an
equi-join on doc_id with a range or equality on these columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

KINDS = ("root", "element", "text", "cdata", "comment", "pi", "charref", "entityref", "dtd", "attr", "error")

NODE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("node_id", T.LongType()),
        T.StructField("pre", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("parent_id", T.LongType()),
        T.StructField("sib", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("prefix", T.StringType()),
        T.StructField("local", T.StringType()),
        T.StructField("ns_uri", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    ]
)
_ARROW = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.int32()] + [pa.string()] * 6 + [pa.map_(pa.string(), pa.string())]
NAMED = frozenset(("element", "attr", "pi", "entityref", "dtd", "root"))


class Node:
    """A node: kind, name, value (text of a leaf), attributes and children. ns: the namespace URI, once resolved."""

    __slots__ = ("kind", "name", "value", "attrs", "children", "ns", "up", "at")

    def __init__(self, kind: str, name: str | None = None, value: str | None = None, attrs: dict[str, str] | None = None, children: list[Node] | None = None, ns: str = ""):
        self.kind, self.name, self.value, self.ns = kind, name, value, ns
        self.attrs: dict[str, str] = attrs if attrs is not None else {}
        self.children: list[Node] = children if children is not None else []
        self.up: Node | None = None
        self.at = 0

    @property
    def prefix(self) -> str:
        return self.name.split(":", 1)[0] if self.name and ":" in self.name else ""

    @property
    def local(self) -> str:
        return self.name.split(":", 1)[-1] if self.name else ""

    def copy(self) -> Node:
        return Node(self.kind, self.name, self.value, dict(self.attrs), [c.copy() for c in self.children], self.ns)

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in document order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def text(self) -> str:
        """The string value."""
        if self.kind in ("element", "root"):
            if len(self.children) == 1 and self.children[0].kind == "text":
                return self.children[0].value or ""
            return "".join(n.value or "" for n in self.walk() if n.kind in ("text", "cdata"))
        return self.value or ""

    def same(self, other: Node) -> bool:
        return (self.kind, self.name, self.value, self.attrs) == (other.kind, other.name, other.value, other.attrs) and len(self.children) == len(other.children) and all(a.same(b) for a, b in zip(self.children, other.children, strict=True))

    def __repr__(self) -> str:
        from .sources.serialize import to_xml

        return f"<{self.kind} {to_xml(self)!r}>"


def text(value: str) -> Node:
    return Node("text", None, value)


def elem(name: str, attrs: dict[str, str] | None = None, *children: Node | str) -> Node:
    return Node("element", name, None, attrs or {}, [text(c) if isinstance(c, str) else c for c in children])


def root(*children: Node) -> Node:
    return Node("root", "/", None, {}, list(children))


def link(tree: Node) -> Node:
    """Sets the parents and document order of a whole tree."""
    for k, n in enumerate(tree.walk()):
        n.at = k
        for c in n.children:
            c.up = n
    return tree


class _Parts(dict):
    """Prefix and local part of each name."""

    def __missing__(self, name: str | None) -> tuple[str, str]:
        if len(self) > 10_000:
            self.clear()
        own = self[name] = (name.split(":", 1)[0] if name and ":" in name else "", name.split(":", 1)[-1] if name else "")
        return own


_parts = _Parts()


def rows(doc_id: int | None, tree: Node) -> list[tuple]:
    """NODE rows of a tree in document order."""
    found: list[tuple] = []  # node, level, parent and place
    stack: list[tuple] = [(tree, 0, None, 0)]
    while stack:
        item = stack.pop()
        kids = item[0].children
        if kids:
            level, pre = item[1] + 1, len(found)
            stack.extend([(kids[k], level, pre, k) for k in range(len(kids) - 1, -1, -1)])
        found.append(item)
    size = [0] * len(found)
    for k in range(len(found) - 1, 0, -1):
        size[found[k][2]] += size[k] + 1
    out = []
    for pre, (n, level, parent, sib) in enumerate(found):
        name = n.name
        if n.kind in NAMED:
            prefix, local = _parts[name]
            out.append((doc_id, pre, pre, size[pre], level, parent, sib, n.kind, prefix, local, n.ns, name, n.value, n.attrs or None))
        else:
            out.append((doc_id, pre, pre, size[pre], level, parent, sib, n.kind, None, None, None, None, n.value, n.attrs or None))
    return out


def unlink(tree: Node) -> None:
    """Takes a tree apart, so that its memory is free at once."""
    stack = [tree]
    while stack:
        n = stack.pop()
        n.up = None
        stack.extend(n.children)
        n.children = []


#: Rows of an Arrow batch.
BATCH_ROWS = 20_000


def batches(found: list[tuple]) -> Iterator[pa.RecordBatch]:
    """NODE rows as Arrow batches of bounded size."""
    for k in range(0, len(found), BATCH_ROWS):
        yield batch(found[k : k + BATCH_ROWS])


def batch(found: Iterable[tuple]) -> pa.RecordBatch:
    """NODE rows as an Arrow batch."""
    cols = list(zip(*found, strict=True)) or [()] * len(NODE)
    cols[-1] = [None if a is None else list(a.items()) for a in cols[-1]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW, strict=True)], NODE.fieldNames())


def tree_of(found: pa.StructArray) -> Node:
    """The tree of one document's NODE rows, an Arrow array of structs in any order, read piece by piece."""
    made: dict[int, Node] = {}
    top: Node | None = None
    fields = ("node_id", "parent_id", "kind", "name", "value", "attrs", "ns_uri")
    order = pc.sort_indices(found.field("pre"))
    for k in range(0, len(found), BATCH_ROWS):
        part = found.take(order[k : k + BATCH_ROWS])
        for i, up, kind, name, value, attrs, ns in zip(*(part.field(c).to_pylist() for c in fields), strict=True):
            n = made[i] = Node(kind, name, value, dict(attrs or []), ns=ns or "")
            if up in made:
                made[up].children.append(n)
            elif top is None:
                top = n
    if top is None:
        raise ValueError("no rows")
    return link(top)


def tree(found: list) -> Node:
    """The tree of one document's NODE rows (Row or dict), in any order."""
    found = sorted(found, key=lambda r: r["pre"])
    made: dict[int, Node] = {}
    top: Node | None = None
    for r in found:
        n = Node(r["kind"], r["name"], r["value"], dict(r["attrs"] or {}), ns=r["ns_uri"] or "")
        made[r["node_id"]] = n
        if r["parent_id"] in made:
            made[r["parent_id"]].children.append(n)
        elif top is None:
            top = n
    if top is None:
        raise ValueError("no rows")
    return link(top)
