"""Batches of documents as columns: tags are split off and numbered for all documents of a batch at once, without a Python object for each node.

Plain documents (ASCII, no references, comments, instructions or sections) are read so; others, and those that are not well formed, by the given reader of rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from ..model import KINDS, NAMED, NODE, _ARROW

ROOT, ELEMENT, TEXT, CDATA = (KINDS.index(k) for k in ("root", "element", "text", "cdata"))
_QNAME = r"[A-Za-z_][A-Za-z0-9_.\-]*(?::[A-Za-z_][A-Za-z0-9_.\-]*)?"
_OPEN = re.compile(rf"""({_QNAME})((?:[ \t\n]+{_QNAME}[ \t\n]*=[ \t\n]*(?:"[^"\t\n]*"|'[^'\t\n]*'))*)[ \t\n]*(/?)""")
_CLOSE = re.compile(rf"/({_QNAME})[ \t\n]*")
_ATTR = re.compile(rf"""({_QNAME})[ \t\n]*=[ \t\n]*(?:"([^"]*)"|'([^']*)')""")
_TAG = re.compile("<([^<>]*)>")
_CONTROL = bytes(k for k in (*range(32), 127) if k not in (9, 10))
#: Levels beyond which a document is left to the reader of rows, and tags that are kept from batch to batch.
DEEP, KEPT = 64, 50_000
_TURN, _START, _END, _EMPTY = 3, 1, -1, 2


class Odd(ValueError):
    """Documents that are not plain, or not well formed."""


class Tags(dict):
    """The number of each tag's text, with what it says, and of each name."""

    def __init__(self):
        super().__init__()
        self.type: list[int] = []
        self.name: list[int] = []
        self.attrs: list[dict[str, str] | None] = []
        self.names: dict[str, int] = {}
        self["\0"] = self.add(_TURN, "/", None)

    def add(self, kind: int, name: str | None, attrs: dict[str, str] | None) -> int:
        self.type.append(kind)
        self.name.append(-1 if name is None else self.names.setdefault(name, len(self.names)))
        self.attrs.append(attrs)
        return len(self.type) - 1

    def __missing__(self, tag: str) -> int:
        if m := _CLOSE.fullmatch(tag):
            k = self.add(_END, m[1], None)
        elif m := _OPEN.fullmatch(tag):
            found = [(x[1], x[2] if x[2] is not None else x[3]) for x in _ATTR.finditer(m[2])] if m[2] else []
            attrs = dict(found)
            if len(attrs) < len(found):
                raise Odd("an attribute twice")
            k = self.add(_EMPTY if m[3] else _START, m[1], attrs or None)
        else:
            raise Odd("a tag")
        self[tag] = k
        return k


class Flat:
    """The nodes of some documents in order. parent: the place of the parent, -1 for a root; name, tag (of tags) and val (of texts): numbers, -1 for none."""

    def __init__(self, ids: list, tags: Tags, kind, level, parent, size, name, tag, texts, val):
        self.ids, self.tags, self.texts = ids, tags, texts
        self.kind, self.level, self.parent, self.size, self.name, self.tag, self.val = kind, level, parent, size, name, tag, val
        n = self.n = len(kind)
        start = np.flatnonzero(level == 0)
        self.doc = np.cumsum(level == 0) - 1
        self.pre = np.arange(n) - start[self.doc] if n else np.zeros(0, np.int64)
        order = np.argsort(parent, kind="stable")
        first = np.searchsorted(parent[order], parent[order])
        self.sib = np.empty(n, np.int64)
        self.sib[order] = np.arange(n) - first
        self.sib[level == 0] = 0

    def rows(self, at: np.ndarray) -> pa.RecordBatch:
        """NODE rows of some nodes."""
        names = list(self.tags.names)
        named = np.isin(self.kind[at], [KINDS.index(k) for k in NAMED])
        code = pa.array(np.where(named, self.name[at], 0).astype(np.int32), mask=~named | (self.name[at] < 0))
        up = self.parent[at]
        pre = pa.array(self.pre[at])
        tag = self.tag[at]
        used, where = np.unique(tag, return_inverse=True)
        attrs = pa.array([None if k < 0 or not self.tags.attrs[k] else list(self.tags.attrs[k].items()) for k in used.tolist()], _ARROW[-1]).take(pa.array(where))
        cols = [
            pa.array(self.ids, pa.int64()).take(pa.array(self.doc[at])), pre, pre, pa.array(self.size[at]), pa.array(self.level[at].astype(np.int32)),
            pa.array(self.pre[np.maximum(up, 0)], mask=up < 0), pa.array(self.sib[at].astype(np.int32)), pa.array(KINDS).take(pa.array(self.kind[at])),
            pa.array([x.split(":", 1)[0] if ":" in x else "" for x in names], pa.string()).take(code), pa.array([x.split(":", 1)[-1] for x in names], pa.string()).take(code), pa.array([""] * len(names), pa.string()).take(code), pa.array(names, pa.string()).take(code),
            pa.array([None if k < 0 else self.texts[k] for k in self.val[at].tolist()], pa.string()), attrs,
        ]
        return pa.RecordBatch.from_arrays(cols, NODE.fieldNames())


def _plain(ids: list, docs: list[str], tags: Tags) -> Flat:
    parts = _TAG.split("".join(["<\0>" + d for d in docs]))
    texts, found = parts[0::2], parts[1::2]
    joined = "".join(texts)
    if "<" in joined or ">" in joined:
        raise Odd("a stray bracket")
    code = np.fromiter(map(tags.__getitem__, found), np.int64, len(found))
    kind, name = np.array(tags.type, np.int8)[code], np.array(tags.name, np.int64)[code]
    opened, closed, turn = kind == _START, kind == _END, kind == _TURN
    depth = np.cumsum(opened.astype(np.int64) - closed)
    before = depth - opened + closed
    if depth.min() < 0 or depth.max() >= DEEP or depth[-1] or before[turn].any() or turn.sum() != len(docs):
        raise Odd("tags that do not match")
    tops = np.flatnonzero((opened | (kind == _EMPTY)) & (before == 0))
    if not np.array_equal(np.cumsum(turn)[tops] - 1, np.arange(len(docs))):
        raise Odd("not one element at the top")
    for k in range(int(depth.max()) if len(depth) else 0):
        if not np.array_equal(name[opened & (before == k)], name[closed & (depth == k)]):
            raise Odd("tags that do not match")
    full = np.fromiter(map(bool, texts[:-1]), bool, len(found))
    if any(texts[j].strip(" \t\n") for j in np.flatnonzero(full & (before == 0)).tolist()) or texts[-1].strip(" \t\n"):
        raise Odd("text outside")
    t, e = np.flatnonzero(full & (before > 0)), np.flatnonzero(~closed)
    order = np.argsort(np.concatenate([2 * t, 2 * e + 1]), kind="stable")
    none = np.full(len(t), -1)
    level = np.concatenate([before[t] + 1, np.where(turn[e], 0, before[e] + 1)])[order]
    kinds = np.concatenate([np.full(len(t), TEXT), np.where(turn[e], ROOT, ELEMENT)])[order]
    names, tag, val = np.concatenate([none, name[e]])[order], np.concatenate([none, code[e]])[order], np.concatenate([t, np.full(len(e), -1)])[order]
    n = len(order)
    parent, size = np.full(n, -1), np.zeros(n, np.int64)
    at = [np.flatnonzero(level == k) for k in range(int(level.max()) + 1)]
    for up, here in zip(at, at[1:], strict=False):
        parent[here] = up[np.searchsorted(up, here) - 1]
    for here in at[:0:-1]:
        size += np.bincount(parent[here], weights=size[here] + 1, minlength=n).astype(np.int64)
    return Flat(ids, tags, kinds, level, parent, size, names, tag, texts, val)


def of_rows(ids: list, found: list[list], tags: Tags) -> Flat:
    """Columns of NODE rows, which are whole documents in order."""
    kind = np.array([KINDS.index(r[7]) for r in found], np.int64)
    level, size = np.array([r[4] for r in found], np.int64), np.array([r[3] for r in found], np.int64)
    first = np.arange(len(found)) - np.array([r[2] for r in found], np.int64)
    parent = np.where(level == 0, -1, first + np.array([r[5] or 0 for r in found], np.int64))
    tag = np.array([tags.add(_EMPTY, r[11], r[13]) for r in found], np.int64)
    texts = [r[12] for r in found]
    return Flat(ids, tags, kind, level, parent, size, np.array(tags.name, np.int64)[tag], tag, texts, np.array([-1 if x is None else k for k, x in enumerate(texts)], np.int64))


def is_plain(s: str) -> bool:
    return s.isascii() and "&" not in s and "<!" not in s and "<?" not in s and "]]>" not in s and len(s) == len(s.encode().translate(None, _CONTROL))


def read(ids: list, docs: list[str | None], tags: Tags, other: Callable[[object, str | None], list[list]]) -> list[Flat]:
    """The documents in order of being plain; other gives the rows of one that is not."""
    odd = [k for k, d in enumerate(docs) if not d or not is_plain(d)]
    if odd:
        left = set(odd)
        plain = [k for k in range(len(docs)) if k not in left]
        rest = of_rows([ids[k] for k in odd], [r for k in odd for r in other(ids[k], docs[k])], tags)
        return [rest, *read([ids[k] for k in plain], [docs[k] for k in plain], tags, other)]
    if not docs:
        return []
    try:
        return [_plain(ids, docs, tags)]
    except Odd:
        if len(docs) == 1:
            return [of_rows(ids, other(ids[0], docs[0]), tags)]
        half = len(docs) // 2
        return read(ids[:half], docs[:half], tags, other) + read(ids[half:], docs[half:], tags, other)


def batches(found: pa.RecordBatch, other: Callable[[object, str | None], list[list]], rows: int = 60_000):
    """Columns of an Arrow batch's documents (ids and texts), of bounded size."""
    tags = Tags()
    ids, docs = found.column(0).to_pylist(), found.column(1).to_pylist()
    k = 0
    while k < len(docs):
        end, chars = k, 0
        while end < len(docs) and (end == k or chars + len(docs[end] or "") < 8 * rows):
            chars += len(docs[end] or "")
            end += 1
        yield from read(ids[k:end], docs[k:end], tags, other)
        if len(tags.type) > KEPT:
            tags = Tags()
        k = end
