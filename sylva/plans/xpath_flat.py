"""Location paths on the columns of a batch of documents: xpath_plan's steps and predicates with numpy, where the documents lie, without joins.

Contexts are rows (numbers from 0); a step gives pairs of a context's number and a node, in the axis's order. An attribute is its element's place and its number among names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..model import KINDS, NODE, _ARROW
from ..sources.flat import CDATA, ELEMENT, ROOT, TEXT, Flat, Tags, of_rows
from . import xpath as X
from .xpath_plan import _OPS, Unplanned

_REVERSE = frozenset(("parent", "ancestor", "ancestor-or-self", "preceding-sibling"))


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges, each with its range's number."""
    n = np.maximum(high - low, 0)
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of]


class _Numbers(dict):
    def __missing__(self, s: str) -> float:
        x = self[s] = X.to_number(s)
        return x


class Paths:
    def __init__(self, f: Flat, strict: bool = False):
        self.f, self.strict = f, strict
        self.numbers = _Numbers()
        self.tests: dict[tuple, np.ndarray] = {}

    def test(self, test: tuple) -> np.ndarray:
        """Whether each node passes as one that is not an attribute."""
        if test not in self.tests:
            f, kind = self.f, self.f.kind
            if test[0] == "any":
                ok = kind == ELEMENT
            elif test[0] == "name":
                ok = (kind == ELEMENT) & (f.name == f.tags.names.get(test[1], -2))
            elif test[0] == "prefix":
                ok = (kind == ELEMENT) & np.isin(f.name, [k for x, k in f.tags.names.items() if (x.split(":", 1)[0] if ":" in x else "") == test[1]])
            elif test[0] == "pi":
                ok = (kind == KINDS.index("pi")) & (f.name == f.tags.names.get(test[1], -2))
            else:
                of = {"node": (ROOT, ELEMENT, TEXT, CDATA, KINDS.index("comment"), KINDS.index("pi")), "text": (TEXT, CDATA), "comment": (KINDS.index("comment"),), "processing-instruction": (KINDS.index("pi"),)}[test[1]]
                ok = np.isin(kind, of)
            self.tests[test] = ok
        return self.tests[test]

    def attributes(self, at: np.ndarray, test: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Numbers into at, and the attribute's number among the sorted names of its element."""
        tag = np.where(self.f.kind[at] == ELEMENT, self.f.tag[at], -1)
        used, where = np.unique(tag, return_inverse=True)
        found: list[int] = []
        count = []
        for k in used.tolist():
            names = sorted(self.f.tags.attrs[k] or ()) if k >= 0 else []
            if test[0] == "name":
                own = [names.index(test[1])] if test[1] in names else []
            elif test == ("any",) or test == ("type", "node"):
                own = list(range(len(names)))
            elif test[0] == "prefix":
                own = [j for j, x in enumerate(names) if (x.split(":", 1)[0] if ":" in x else "") == test[1]]
            else:
                own = []
            found += own
            count.append(len(own))
        n = np.array(count, np.int64)
        low = (np.cumsum(n) - n)[where]
        of, k = _ranges(low, low + n[where])
        return of, np.array(found, np.int64)[k]

    def attribute_values(self, at: np.ndarray, k: np.ndarray) -> list[str]:
        known: dict[tuple, str] = {}
        out = []
        for key in zip(self.f.tag[at].tolist(), k.tolist(), strict=True):
            if key not in known:
                known[key] = sorted(self.f.tags.attrs[key[0]].items())[key[1]][1]
            out.append(known[key])
        return out

    def axis(self, at: np.ndarray, axis: str, test: tuple) -> tuple[np.ndarray, np.ndarray]:
        f, n = self.f, self.f.n
        ok = self.test(test)
        if axis == "self":
            of = np.flatnonzero(ok[at])
            return of, at[of]
        if axis == "parent":
            up = f.parent[at]
            of = np.flatnonzero((up >= 0) & ok[up])
            return of, up[of]
        if axis in ("ancestor", "ancestor-or-self"):
            of, now, got = np.arange(len(at)), at if axis.endswith("self") else f.parent[at], []
            while len(now):
                of, now = of[now >= 0], now[now >= 0]
                got.append((of[ok[now]], now[ok[now]]))
                now = f.parent[now]
            of, found = (np.concatenate(x) if got else np.zeros(0, np.int64) for x in (zip(*got, strict=True) if got else ((), ())))
            order = np.argsort(of, kind="stable")
            return of[order], found[order]
        if axis in ("descendant", "descendant-or-self"):
            own = np.flatnonzero(ok)
            of, k = _ranges(np.searchsorted(own, at + (axis == "descendant")), np.searchsorted(own, at + f.size[at], "right"))
            return of, own[k]
        if axis not in ("child", "following-sibling", "preceding-sibling"):
            raise Unplanned(axis)
        own = np.flatnonzero(ok & (f.parent >= 0))
        own = own[np.argsort(f.parent[own], kind="stable")]
        key = f.parent[own] * n + own
        up = at if axis == "child" else f.parent[at]
        low = np.searchsorted(key, up * n if axis != "following-sibling" else up * n + at, "right" if axis == "following-sibling" else "left")
        high = np.searchsorted(key, (up + 1) * n if axis != "preceding-sibling" else up * n + at)
        low, high = np.where(up < 0, 0, low), np.where(up < 0, 0, high)
        of, k = _ranges(low, high)
        if axis == "preceding-sibling":
            k = (low[of] + high[of] - 1) - k
        return of, own[k]

    def steps(self, at: np.ndarray, steps: list) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Pairs of a context's number and a node, each once, and the attributes' numbers if the last step leads to attributes."""
        of, now, k = np.arange(len(at)), at, 0
        while k < len(steps):
            axis, test, preds = steps[k]
            if steps[k] == X._ANY and k + 1 < len(steps) and steps[k + 1][0] in ("child", "descendant") and not steps[k + 1][2]:
                k += 1
                axis, test, preds = "descendant", steps[k][1], []
            k += 1
            if axis == "namespace":
                raise X.XPathError("the namespace axis is not supported")
            if axis == "attribute":
                if k < len(steps) or preds:
                    raise Unplanned("a step after an attribute")
                j, attr = self.attributes(now, test)
                return of[j], now[j], attr
            group, found = self.axis(now, axis, test)
            for p in preds:
                ends = np.searchsorted(group, [group, group + 1]) if len(group) else np.zeros((2, 0), np.int64)
                pos, last = np.arange(len(group)) - ends[0] + 1, ends[1] - ends[0]
                keep = self.mask(found, p, pos, last)
                group, found = group[keep], found[keep]
            of, now = of[group], found
            if axis not in ("self", "child"):
                both = np.unique(of * self.f.n + now)
                of, now = both // max(self.f.n, 1), both % max(self.f.n, 1)
        return of, now, None

    def values(self, at: np.ndarray, attr: np.ndarray | None) -> list[str]:
        """String values."""
        if attr is not None:
            return self.attribute_values(at, attr)
        f = self.f
        leaf = np.where((f.kind[at] == ELEMENT) & (f.size[at] == 1), at + 1, at)
        plain = (f.kind[leaf] != ELEMENT) & (f.kind[leaf] != ROOT)
        good = np.isin(f.kind[leaf], (TEXT, CDATA)) | (leaf == at)
        out: list[str] = []
        for i, k, v, own in zip(at.tolist(), leaf.tolist(), f.val[leaf].tolist(), (plain & good).tolist(), strict=True):
            if own:
                out.append(f.texts[v] or "" if v >= 0 else "")
            else:
                inner = np.arange(i, i + int(f.size[i]) + 1)
                out.append("".join(f.texts[x] or "" for x in f.val[inner[np.isin(f.kind[inner], (TEXT, CDATA))]].tolist() if x >= 0))
        return out

    def scalar(self, e, pos, last):
        if e[0] == "num":
            return np.full(len(pos), e[1])
        if e[0] == "call" and e[1] in ("position", "last"):
            return (pos if e[1] == "position" else last).astype(float)
        if e[0] == "op" and e[1] in ("+", "-", "*", "mod"):
            a, b = self.scalar(e[2], pos, last), self.scalar(e[3], pos, last)
            if a is None or b is None:
                return None
            with np.errstate(all="ignore"):
                return {"+": np.add, "-": np.subtract, "*": np.multiply, "mod": np.fmod}[e[1]](a, b)
        return None

    def mask(self, found: np.ndarray, pred, pos, last) -> np.ndarray:
        number = self.scalar(pred, pos, last)
        if number is not None:
            return pos == number
        if pred[0] == "op" and pred[1] in _OPS:
            a, b = self.scalar(pred[2], pos, last), self.scalar(pred[3], pos, last)
            if a is not None and b is not None:
                return _OPS[pred[1]](a, b)
        if pred[0] == "op" and pred[1] == "and":
            return self.mask(found, pred[2], pos, last) & self.mask(found, pred[3], pos, last)
        return self.holds(found, pred)

    def of_path(self, at: np.ndarray, path) -> tuple[np.ndarray, list[str]]:
        of, found, attr = self.steps(at, path[2])
        return of, self.values(found, attr)

    def number(self, values: list[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, values), float, len(values))

    def holds(self, at: np.ndarray, pred) -> np.ndarray:
        """Whether a predicate without positions holds for each node."""
        what, out = pred[0], np.zeros(len(at), bool)
        relative = lambda e: e[0] == "path" and e[1] is None
        if relative(pred):
            out[self.steps(at, pred[2])[0]] = True
            return out
        if what == "op" and pred[1] in ("or", "and"):
            a, b = self.holds(at, pred[2]), self.holds(at, pred[3])
            return a | b if pred[1] == "or" else a & b
        if what == "call" and pred[1] == "not":
            return ~self.holds(at, pred[2][0])
        if what == "call" and pred[1] == "true":
            return ~out
        if what == "call" and pred[1] in ("contains", "starts-with") and relative(pred[2][0]) and pred[2][1][0] == "str":
            of, values = self.of_path(at, pred[2][0])
            s = pred[2][1][1]
            out[of[np.fromiter((s in v if pred[1] == "contains" else v.startswith(s) for v in values), bool, len(values))]] = True
            return out
        if what == "op" and pred[1] in _OPS:
            op, a, b = pred[1], pred[2], pred[3]
            if a[0] in ("num", "str"):
                op, a, b = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op), b, a
            if a[0] == "call" and a[1] == "count" and relative(a[2][0]) and b[0] == "num":
                return _OPS[op](np.bincount(self.steps(at, a[2][0][2])[0], minlength=len(at)).astype(float), b[1])
            if relative(a) and b[0] in ("num", "str"):
                of, values = self.of_path(at, a)
                if b[0] == "str" and op in ("=", "!="):
                    hit = np.fromiter(((v == b[1]) == (op == "=") for v in values), bool, len(values))
                else:
                    hit = _OPS[op](self.number(values), X.to_number(b[1]))
                out[of[hit]] = True
                return out
            if relative(a) and relative(b):
                (left, va), (right, vb) = self.of_path(at, a), self.of_path(at, b)
                if op == "=":
                    code: dict[str, int] = {}
                    x, y = (o * (len(va) + len(vb) + 1) + np.fromiter((code.setdefault(v, len(code)) for v in vs), np.int64, len(vs)) for o, vs in ((left, va), (right, vb)))
                    out[left[np.isin(x, y)]] = True
                    return out
                if self.strict and op != "!=":
                    na, nb = self.number(va), self.number(vb)
                    left, va, right, vb = left[~np.isnan(na)], na[~np.isnan(na)].tolist(), right[~np.isnan(nb)], nb[~np.isnan(nb)].tolist()
                ends: list[dict] = [{}, {}]
                for side, (o, vs) in zip(ends, ((left, va), (right, vb)), strict=True):
                    for k, v in zip(o.tolist(), vs, strict=True):
                        low, high = side.get(k, (v, v))
                        side[k] = (min(low, v), max(high, v))
                for k in ends[0].keys() & ends[1].keys():
                    (a0, a1), (b0, b1) = ends[0][k], ends[1][k]
                    out[k] = {"!=": a0 != b1 or a1 != b0, "<": a0 < b1, "<=": a0 <= b1, ">": a1 > b0, ">=": a1 >= b0}[op]
                return out
        raise Unplanned(f"predicate {what}")

    def select(self, e) -> pa.RecordBatch:
        """NODE rows of a path or a union, from the roots."""
        nodes, owners, attrs = [], [], []
        for p in e[1] if e[0] == "union" else [e]:
            if p[0] != "path" or p[1] not in (None, "/"):
                raise Unplanned(p[0])
            _, found, attr = self.steps(np.flatnonzero(self.f.level == 0), p[2])
            if attr is None:
                nodes.append(found)
            else:
                owners.append(found)
                attrs.append(attr)
        out = [self.f.rows(np.unique(np.concatenate(nodes)))] if nodes else []
        if owners:
            both = np.unique(np.concatenate(owners) * (1 << 20) + np.concatenate(attrs))
            out.append(self.attribute_rows(both >> 20, both & ((1 << 20) - 1)))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if len(out) > 1 and sum(b.num_rows for b in out) else out[-1]

    def attribute_rows(self, at: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
        """As axes.attributes() makes them."""
        f = self.f
        pre = f.pre[at]
        known: dict[tuple, tuple] = {}
        items = []
        for key in zip(f.tag[at].tolist(), k.tolist(), strict=True):
            if key not in known:
                known[key] = sorted(f.tags.attrs[key[0]].items())[key[1]]
            items.append(known[key])
        names = [x[0] for x in items]
        n = len(names)
        cols = [
            pa.array(f.ids, pa.int64()).take(pa.array(f.doc[at])), -(pre << 20) - k - 1, pre, np.zeros(n, np.int64), (f.level[at] + 1).astype(np.int32), pre, k.astype(np.int32), ["attr"] * n,
            [x.split(":", 1)[0] if ":" in x else "" for x in names], [x.split(":", 1)[-1] for x in names], [""] * n, names, [x[1] for x in items], [None] * n,
        ]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, _ARROW, strict=True)], NODE.fieldNames())


def planned(e, strict: bool) -> bool:
    """Whether an expression can be evaluated so; its form alone decides."""
    try:
        Paths(of_rows([], [], Tags()), strict).select(e)
    except Unplanned:
        return False
    return True
