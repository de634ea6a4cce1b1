"""Language identification with error-correcting output codes.

Each language has a codeword; for each bit, a binary byte n-gram classifier (two- and three-byte grams of the text with letters
lower-cased and all else one space) gives the mean log-odds of the languages with the bit against those without it.
Loss-weighted decoding adds, for each language, the logistic losses of its bits, weighted by the bits'
accuracies in training, and takes the nearest codeword. A text is ambiguous if the second is nearly as near.

The classifiers are fitted on a bounded sample: at most about `sample` documents a language (by a hash of the id; all of
them if there are fewer), each counting for at most `weight` grams. Tables of languages x 131072 counts are
all that reaches the driver. Every whole text is scored.

Defined cases: a null text or one without a letter is `und`, with score 0 and not ambiguous; so is every text
if no row has a language. Rows without a language take no part in training. Repeated rows count each. Only
doc_id, text and lang are read; lang and doc_id never enter a prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

GRAMS = 1 << 17
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
PIECE = 1 << 19


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of bits +1 and -1: all splits for up to five languages, else the best of random codes by least distance."""
    if n <= 5:
        bits = max(1, 2 ** (n - 1) - 1)
        return np.array([[1 if i == 0 or not (b >> (i - 1)) & 1 else -1 for b in range(1, bits + 1)] for i in range(n)])
    size = max(15, int(np.ceil(10 * np.log2(n))))
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(300):
        code = rng.choice((-1, 1), (n, size))
        code[0, np.abs(code.sum(axis=0)) == n] *= -1
        apart = int(((size - code @ code.T) // 2 + size * np.eye(n, dtype=int)).min())
        if apart > far:
            best, far = code, apart
    return best


def fold(b: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, other ASCII a space, Latin-1 capitals in lower case, other bytes as they are."""
    out = _FOLD[b]
    high = np.flatnonzero(b[:-1] == 0xC3) + 1
    capital = high[(b[high] >= 0x80) & (b[high] <= 0x9E)]
    out[capital] |= 0x20
    return out


def grams(b: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram ids at each byte: pairs and triples (0 if all white or over a row's end), and the rows' starts."""
    x = fold(b).astype(np.uint32)
    two, three = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    if len(x) > 1:
        two[:-1] = (x[:-1] << 8) | x[1:]
        two[:-1][(x[:-1] == 32) & (x[1:] == 32)] = 0
    if len(x) > 2:
        h = (((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(2654435761)) >> np.uint32(16)
        three[:-2] = h.astype(np.int64) | (1 << 16)
        three[:-2][(x[:-2] == 32) & (x[1:-1] == 32)] = 0
        three[:-2][(x[1:-1] == 32) & (x[2:] == 32)] = 0
    last = own[1:][own[1:] > 0]
    two[last - 1] = 0
    three[last - 1] = 0
    three[np.maximum(last, 2) - 2] = 0
    return two, three, own


def margins(column: pa.Array, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean log-odds of each bit (w: grams x bits) and the number of grams, for each text."""
    b, off = common.text_buffer(column)
    total, n = np.zeros((len(off) - 1, w.shape[1])), np.zeros(len(off) - 1)
    for i, j, s, e in common.segments(b, off, PIECE):
        if e == s:
            continue
        own = np.clip(off[i : j + 1] - s, 0, e - s)
        two, three, _ = grams(b[s:e], own)
        some = np.flatnonzero(own[1:] > own[:-1])
        for g in (two, three):
            total[i:j][some] += np.add.reduceat(w[g], own[:-1][some], axis=0)
            n[i:j][some] += np.add.reduceat(g > 0, own[:-1][some], dtype=np.int64)
    return total / np.maximum(n, 1)[:, None], n


def sampled(docs: DataFrame, train: Column, sample: int) -> DataFrame:
    """text and lang of about `sample` training documents a language, or of all if there are fewer."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    many = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row a language
    share = F.lit(0)
    for lang, n in many.items():
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, sample / n) * 1_000_000))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).select("text", "lang")


class Model:
    def __init__(self, langs: list[str], w: np.ndarray, weight: np.ndarray):
        self.langs, self.w, self.code, self.weight = langs, w, codewords(max(1, len(langs))), weight

    def decode(self, m: np.ndarray, n: np.ndarray, margin: float = 0.2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of exp(-loss), and whether the runner-up is within the margin."""
        scale = np.minimum(np.sqrt(n), 12)[:, None]
        loss = (np.logaddexp(0, -(m * scale)[:, None, :] * self.code[None]) * self.weight).sum(axis=2)
        best = loss.argmin(axis=1)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        order = np.sort(loss, axis=1)
        close = order[:, 1] - order[:, 0] < margin if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return best, 1 / p.sum(axis=1), close


def fit(docs: DataFrame, train: Column, sample: int = 4000, weight: int = 3000) -> Model | None:
    """The classifiers, or None if no training row has a language."""
    rows = common.write_table(sampled(docs, train, sample), "sample")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = batch.column(1).to_pylist()
            b, off = common.text_buffer(batch.column(0))
            for i, j, s, e in common.segments(b, off, PIECE):
                own = np.clip(off[i : j + 1] - s, 0, e - s)
                two, three, _ = grams(b[s:e], own)
                for k in range(i, j):
                    at = slice(int(own[k - i]), int(own[k - i + 1]))
                    g = np.concatenate((two[at], three[at]))
                    if len(g):
                        own_sum = sums.setdefault(lang[k], np.zeros(GRAMS))
                        own_sum += np.bincount(g, minlength=GRAMS) * min(1.0, weight / max(1, int(off[k + 1] - off[k])))
        for k, x in sums.items():
            used = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(x[used])], ["lang", "gram", "n"])

    got = rows.mapInArrow(common.lean(count), "lang string, gram int, n double").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column(0).to_pylist()))
    if not langs:
        return None
    c = np.zeros((len(langs), GRAMS))
    index = {x: k for k, x in enumerate(langs)}
    c[[index[x] for x in got.column(0).to_pylist()], got.column(1).to_numpy()] = got.column(2).to_numpy()
    c[:, 0] = 0
    p = (c + 0.05) / (c.sum(axis=1, keepdims=True) + 0.05 * GRAMS)
    code = codewords(len(langs))
    w = np.zeros((GRAMS, code.shape[1]), np.float32)
    if len(langs) > 1:
        for k in range(code.shape[1]):
            w[:, k] = np.log(p[code[:, k] > 0].mean(axis=0)) - np.log(p[code[:, k] < 0].mean(axis=0))
    w[0] = 0

    def check(batches):
        good, n = np.zeros(code.shape[1]), 0
        for batch in batches:
            m, _ = margins(batch.column(0), w)
            good += (np.sign(m) == code[[index[x] for x in batch.column(1).to_pylist()]]).sum(axis=0)
            n += len(m)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(good)), pa.int32()), pa.array(good), pa.array([float(n)] * len(good))], ["bit", "good", "n"])

    weight_of = np.ones(code.shape[1])
    for r in rows.mapInArrow(common.lean(check), "bit int, good double, n double").groupBy("bit").agg(F.sum("good"), F.sum("n")).collect():
        a = min(max((r[1] + 1) / (r[2] + 2), 0.51), 0.999)
        weight_of[r[0]] = np.log(a / (1 - a))
    return Model(langs, w, weight_of / weight_of.sum() * len(weight_of) if len(langs) > 1 else weight_of)


def identify(docs: DataFrame, train: Column, sample: int = 4000) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every document, by a model of the rows where train holds."""
    common.bound_batches(docs.sparkSession)
    model = fit(docs, train, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # grams x bits, whatever the corpus's size
    names = ["doc_id", "lang_pred", "score", "ambiguous"]

    def run(batches):
        model = shared.value
        for batch in batches:
            for k in range(0, max(batch.num_rows, 1), 1000):
                piece = batch.slice(k, 1000)
                letter = np.array([bool(t and _LETTER.search(t)) for t in piece.column(1).to_pylist()], bool)
                if model is None or not len(letter):
                    lang, score, close = ["und"] * len(letter), np.zeros(len(letter)), np.zeros(len(letter), bool)
                else:
                    best, score, close = model.decode(*margins(piece.column(1), model.w))
                    lang = [model.langs[x] if ok else "und" for x, ok in zip(best.tolist(), letter.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(lang, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(close & letter)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(common.lean(run), f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
