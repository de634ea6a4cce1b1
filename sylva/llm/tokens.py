"""Token ids of text batches with the tokenizers library.

An invented or rare word costs the library tens of microseconds and a common one no less, so each distinct unit
(a word, with the space before it for byte-level vocabularies) is encoded once and kept by its 64-bit hash. The units are
those at whose borders the pre-tokenizer always cuts, so the ids equal those of the whole text. Units of Latin letters, with one
mark at most after them, go straight to the library's model in their pre-tokenised form, which costs a quarter. A text with
white space that is not ASCII is encoded whole by a byte-level tokenizer. Other kinds of tokenizers encode whole texts.
A text that holds the content of an added token is encoded whole as well, as the library finds such tokens before it splits words.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from . import common

_EXOTIC = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_PROBE = "It's  a\n\nTest, of (units)!  \n 12x 'll\t do.\r\n é-ß ... end \n"
#: A unit whose pre-tokenised form is that of its letters, one after the other.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIMPLE = re.compile(f"( ?)([{_LETTERS}]+)([.,;:!?]?)").fullmatch
_SIMPLE_PROBE = ["the", "Ab", "Zürich", "ÀÉîõüß", "straße", "øæå", "internationalisation", "x", "Q", "ÿ", "end.", "Wörter,", "no;", "so:", "go!", "é?"]
_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a process and file, with its cache."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


class Encoder:
    def __init__(self, path: str, cache: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        added = [x["content"] for x in json.loads(self.tk.to_str())["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.vocab = self.tk.get_vocab_size(with_added_tokens=True)
        self.dtype = np.uint16 if self.vocab <= 1 << 16 else np.uint32
        self.cache = cache
        self.tokenize, self.form, self.marks, self.space = None, {}, {}, ""
        self.clear()
        kinds = json.dumps(json.loads(self.tk.to_str())["pre_tokenizer"])
        self.kind = "whole"
        for kind in ("word", "byte") if "ByteLevel" in kinds else ("word",):
            self.kind = kind
            ids, _ = self.encode(pa.array([_PROBE, _PROBE.strip()]))
            if ids.tolist() == self.plain(_PROBE) + self.plain(_PROBE.strip()):
                break
            self.kind = "whole"
        if self.kind != "whole":
            self.prepare()
        self.clear()

    def prepare(self) -> None:
        """Sets the direct way for simple units, unless it gives other ids than the whole tokenizer for the probes."""
        before, clean = self.tk.pre_tokenizer.pre_tokenize_str, self.tk.normalizer.normalize_str if self.tk.normalizer else str
        letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if re.match(f"[{_LETTERS}]", chr(c))]
        self.form = {ord(c): "".join(x for x, _ in before(clean(c))) for c in letters}
        self.space = before(" a")[0][0].removesuffix(self.form[ord("a")]) if self.kind == "byte" else ""
        self.marks = {c: self.plain(c) for c in ".,;:!?"} | {"": []}
        self.tokenize = self.tk.model.tokenize
        probes = _SIMPLE_PROBE + [f" {x}" for x in _SIMPLE_PROBE] * (self.kind == "byte")
        if any(self.direct(x) != self.tk.encode([x], is_pretokenized=True, add_special_tokens=False).ids for x in probes):
            self.tokenize = None

    def direct(self, unit: str) -> list[int] | None:
        """Ids of a simple unit, else None."""
        m = _SIMPLE(unit)
        if m is None:
            return None
        space, word, mark = m.groups()
        form = word.translate(self.form)
        return [t.id for t in self.tokenize(self.space + form if space else form)] + self.marks[mark]

    def encode_units(self, text: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after the other, and how many each has."""
        each = [self.direct(x) for x in text] if self.tokenize else [None] * len(text)
        rest = [k for k, x in enumerate(each) if x is None]
        for c in range(0, len(rest), 1 << 14):
            own = rest[c : c + (1 << 14)]
            e = self.tk.encode([text[k] for k in own], is_pretokenized=True, add_special_tokens=False)
            ids, n = e.ids, np.bincount(np.array(e.word_ids, np.int64), minlength=len(own))
            end = np.cumsum(n)
            for k, s, t in zip(own, (end - n).tolist(), end.tolist(), strict=True):
                each[k] = ids[s:t]
        n = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(chain.from_iterable(each), self.dtype, int(n.sum())), n

    def clear(self) -> None:
        self.h, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ptr, self.flat = np.zeros(1, np.int64), np.zeros(0, self.dtype)

    def plain(self, text: str) -> list[int]:
        return self.tk.encode(text, add_special_tokens=False).ids

    def units(self, b: np.ndarray, own: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows (from 0) of a byte-level vocabulary's units: words, each with a space right before it, and the white space left."""
        n = len(own) - 1
        prev = own[row].copy()
        if len(starts) > 1:
            same = row[1:] == row[:-1]
            prev[1:][same] = ends[:-1][same]
        spaced = (starts > prev) & (b[np.maximum(starts, 1) - 1] == 32)
        begin = starts - spaced
        gap = begin - prev
        cut = begin - ((gap >= 2) & ~spaced)
        one, two = gap > 0, cut < begin
        tail = own[:-1].copy()
        if len(ends):
            lastword = np.concatenate((np.flatnonzero(row[1:] != row[:-1]), [len(row) - 1]))
            tail[row[lastword]] = ends[lastword]
        left = np.flatnonzero(own[1:] > tail)
        s = np.concatenate((begin, prev[one], cut[two], tail[left]))
        e = np.concatenate((ends, cut[one], begin[two], own[1:][left]))
        r = np.concatenate((row, row[one], row[two], np.arange(n)[left]))
        order = np.argsort(s, kind="stable")
        return s[order], e[order], r[order]

    def look_up(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in order, and how many each has."""
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.h) + len(u) > max(self.cache, len(u)):
            self.clear()
        pos = np.searchsorted(self.h, u)
        known = np.zeros(len(u), bool)
        inside = pos < len(self.h)
        known[inside] = self.h[pos[inside]] == u[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            raw = b.tobytes()
            text = [raw[s:e].decode() for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            ids, sizes = self.encode_units(text)
            at = np.concatenate((self.at, np.arange(len(new)) + len(self.ptr) - 1))
            h = np.concatenate((self.h, u[new]))
            order = np.argsort(h, kind="stable")
            self.h, self.at = h[order], at[order]
            self.flat = np.concatenate((self.flat, ids))
            self.ptr = np.concatenate((self.ptr, self.ptr[-1] + np.cumsum(sizes)))
            pos = np.searchsorted(self.h, u)
        c = self.at[pos][inverse]
        n = self.ptr[c + 1] - self.ptr[c]
        total = int(n.sum())
        index = np.repeat(self.ptr[c] - (np.cumsum(n) - n), n) + np.arange(total)
        return self.flat[index], n

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column in one array, and the number of each text; a null is an empty text."""
        if self.kind == "whole":
            each = [self.plain(t) if t else [] for t in column.to_pylist()]
            return np.concatenate([np.zeros(0, self.dtype), *(np.array(x, self.dtype) for x in each)]), np.array([len(x) for x in each], np.int64)
        texts = column.to_pylist()
        odd = {k: self.plain(t) for k, t in enumerate(texts) if t and (self.kind == "byte" and _EXOTIC.search(t) or self.added and self.added.search(t))}
        if odd:
            column = pa.array(["" if k in odd else t for k, t in enumerate(texts)], column.type)
        b, off = common.text_buffer(column)
        out, count = [np.zeros(0, self.dtype)], np.zeros(len(off) - 1, np.int64)
        for i, j, s, e in common.segments(b, off):
            part, own = b[s:e], np.clip(off[i : j + 1] - s, 0, e - s)
            starts, ends = common.word_bounds(part, own)
            row = np.searchsorted(own, starts, "right") - 1
            if self.kind == "byte":
                starts, ends, row = self.units(part, own, starts, ends, row)
            if not len(starts):
                continue
            ids, n = self.look_up(part, starts, ends, common.slice_hash(part, starts, ends))
            out.append(ids)
            count[i:j] += np.bincount(row, weights=n, minlength=j - i).astype(np.int64)
        ids = np.concatenate(out)
        if odd:
            pieces = np.split(ids, np.cumsum(count)[:-1]) if len(count) else []
            for k, x in odd.items():
                pieces[k], count[k] = np.array(x, self.dtype), len(x)
            ids = np.concatenate(pieces)
        return ids, count

    def documents(self, column: pa.Array, end: int):
        """Yields the ids of each text, with the end id, as unsigned 32-bit little-endian arrays."""
        ids, count = self.encode(column)
        at = 0
        for n in count.tolist():
            doc = np.empty(n + 1, "<u4")
            doc[:n] = ids[at : at + n]
            doc[n] = end
            at += n
            yield doc
