"""Quality by weak supervision.

Each rule votes good, bad or abstains on a whole text. The votes of all documents are counted by pattern
(at most 3 to the number of rules, whatever the corpus's size), expectation-maximisation on these counts
estimates the rules' accuracies and the share of good texts, and a document is kept if its posterior
probability of being good is at least one half. No labels are used.

Two passes over the texts: one counts vote patterns, the other applies the posteriors, a table of bounded size.

Defined cases: a null or empty text has no words, fails the base rule and is not kept. Every input row gives
one row, repeated rows too; on an empty table the model is the prior. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The first eight vote bad or abstain, the others good or abstain.
RULES = ("symbols", "capitals", "repeats", "lines", "separators", "marks", "word_length", "letters", "plain", "prose", "long")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_STRIP = " \t\n\x0b\x0c\r"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_lone", "n_marks", "dup_chars")


def features(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts for each text of an Arrow column; see FEATURES."""
    b, off = common.text_buffer(column)
    n = len(off) - 1
    out = {k: np.zeros(n, np.int64) for k in FEATURES}
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def repeats() -> None:
        if not held:
            return
        h, row = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        held.clear()
        if len(h) < 3:
            return
        t = common.mix(common.mix(common.mix(h[:-2]) + h[1:-1]) + h[2:]) ^ common.mix(row[:-2].astype(np.uint64) + np.uint64(1))
        ok = row[:-2] == row[2:]
        at = np.flatnonzero(ok)
        if not len(at):
            return
        t = t[at]
        order = np.argsort(t)
        s = t[order]
        same = np.zeros(len(s) + 1, bool)
        same[1:-1] = s[1:] == s[:-1]
        twice = same[:-1] | same[1:]
        cover = np.zeros(len(h), bool)
        hit = at[order[twice]]
        for k in range(3):
            cover[hit + k] = True
        np.add.at(out["n_repeat_words"], row[cover], 1)

    last = -1
    for i, j, part, starts, ends, h, row in common.words(b, off):
        if i != last:  # a new row starts here: earlier rows are whole
            repeats()
        held.append((h, row))
        last = j - 1
        out["n_words"] += np.bincount(row, minlength=n)
        lone = row[(ends - starts == 1) & ~(((part[starts] | 32) >= 97) & ((part[starts] | 32) <= 122)) & ~((part[starts] >= 48) & (part[starts] <= 57))] if len(starts) else row
        out["n_lone"] += np.bincount(lone, minlength=n)
        own = np.clip(off[i:j] - (off[i] if j > i + 1 else 0), 0, len(part)) if j > i + 1 else np.zeros(1, np.int64)
        sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.append(own, len(part))])  # noqa: B023, E731
        low = part | 32
        for k, x in (
            ("word_chars", ((part & 0xC0) != 0x80) & ~common.WS[part]),
            ("n_symbols", _SYMBOL[part]),
            ("n_marks", part == 33),
            ("n_letters", ((low >= 97) & (low <= 122)) | (part >= 0xC3)),
            ("n_upper", (part >= 65) & (part <= 90)),
        ):
            out[k][i:j] += sums(x)
    repeats()
    for k, text in enumerate(column.to_pylist()):
        if text and "\n" in text:
            seen, dup, chars, count = set(), 0, 0, 0
            for line in text.split("\n"):
                if line.strip(_STRIP):
                    count += 1
                    if line in seen:
                        dup += 1
                        chars += len(line)
                    else:
                        seen.add(line)
            out["n_dup_lines"][k], out["dup_chars"][k], out["n_lines"][k] = dup, chars, count
        elif text and text.strip(_STRIP):
            out["n_lines"][k] = 1
    return out


def votes(f: dict[str, np.ndarray]) -> np.ndarray:
    """Votes of the rules, 0 bad, 1 abstain, 2 good, one column for each of RULES."""
    words, chars, letters = (np.maximum(1, f[k]) for k in ("n_words", "word_chars", "n_letters"))
    bad, good = (lambda x: np.where(x, 0, 1)), (lambda x: np.where(x, 2, 1))
    some = f["n_words"] >= 10
    caps, rep = f["n_upper"] / letters, f["n_repeat_words"] / words
    lone, marks, mean, letter = f["n_lone"] / words, f["n_marks"] / words, f["word_chars"] / words, f["n_letters"] / chars
    return np.stack(
        [
            bad(f["n_symbols"] / words > 0.25),
            bad(some & (caps > 0.4)),
            bad(rep > 0.4),
            bad(f["dup_chars"] > 0.4 * f["word_chars"]),
            bad(some & (lone > 0.12)),
            bad(some & (marks > 0.2)),
            bad((mean < 2) | (mean > 25)),
            bad(letter < 0.6),
            good((f["n_symbols"] / words < 0.05) & (lone < 0.03)),
            good((letter > 0.8) & (caps < 0.25) & (marks < 0.02)),
            good((f["n_words"] >= 50) & (rep < 0.2)),
        ],
        axis=1,
    )


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def fit(counts: dict[int, int], rules: int = len(RULES), rounds: int = 200, prior: float = 0.01) -> tuple[float, np.ndarray, dict[int, float]]:
    """Share of good texts, P(rule votes | class) for bad and good texts, and the posterior of each pattern, by EM from the majority vote.

    An abstention is no evidence. prior: weight, as a share of all texts, of the prior that a rule is right four times in five.
    """
    keys = np.array(sorted(counts), np.int64)
    if not len(keys):
        return 0.5, np.full((2, rules), 0.5), {}
    w = np.array([counts[int(k)] for k in keys], float)
    v = keys[:, None] // (3 ** np.arange(rules)) % 3
    says = (v == 2).any(axis=0).astype(float) - (v == 0).any(axis=0)  # 1: votes good, -1: bad
    cast = (v != 1).astype(float)
    post = 1 / (1 + np.exp(2.0 * (v == 0).sum(axis=1) - 0.5 * (v == 2).sum(axis=1) - 0.5))
    base = prior * w.sum() + 1
    right, wrong = 0.04 * base, 0.01 * base
    share, rate = 0.5, np.zeros((2, rules))
    for _ in range(rounds):
        share = (np.dot(w, post) + 0.9 * base) / (w.sum() + base)
        good, bad = np.dot(w, post), np.dot(w, 1 - post)
        rate[1] = (cast.T @ (w * post) + np.where(says > 0, right, wrong)) / (good + base)
        rate[0] = (cast.T @ (w * (1 - post)) + np.where(says > 0, wrong, right)) / (bad + base)
        logit = cast @ np.log(rate[1] / rate[0]) + np.log(share / (1 - share))
        new = 1 / (1 + np.exp(np.clip(-logit, -700, 700)))
        done = float(np.abs(new - post).max()) < 1e-9
        post = new
        if done:
            break
    return float(share), rate, {int(k): float(p) for k, p in zip(keys, post, strict=True)}


def vote_counts(docs: DataFrame, text: str = "text") -> dict[int, int]:
    """Documents by vote pattern: at most 3 ** len(RULES) rows reach the driver."""

    common.bound_batches(docs.sparkSession)

    def run(batches):
        total: dict[int, int] = {}
        for batch in batches:
            keys, n = np.unique(pattern(votes(features(batch.column(0)))), return_counts=True)
            for k, x in zip(keys.tolist(), n.tolist(), strict=True):
                total[k] = total.get(k, 0) + x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["_p", "_n"])

    rows = docs.select(F.col(text).alias("_text")).mapInArrow(common.lean(run), "_p long, _n long").groupBy("_p").agg(F.sum("_n").alias("_n"))
    return {r[0]: r[1] for r in rows.collect()}


def _base_failed(f: dict[str, np.ndarray]) -> np.ndarray:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, p_good and kept for every document."""
    share, _, post = fit(vote_counts(docs))

    def run(batches):
        for batch in batches:
            f = features(batch.column(1))
            p = np.array([post.get(k, share) for k in pattern(votes(f)).tolist()], float)
            failed = _base_failed(f)
            cols = [batch.column(0), *(pa.array(f[k]) for k in FEATURES[:5]), pa.array(failed), pa.array(p, pa.float64()), pa.array((p >= 0.5) & ~failed)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *FEATURES[:5], "base_failed", "p_good", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(common.lean(run), f"doc_id {kind}, " + ", ".join(f"{k} long" for k in FEATURES[:5]) + ", base_failed boolean, p_good double, kept boolean")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that assess() keeps, with all their columns."""
    share, _, post = fit(vote_counts(docs))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            f = features(batch.column(at))
            p = np.array([post.get(k, share) for k in pattern(votes(f)).tolist()], float)
            yield batch.filter(pa.array((p >= 0.5) & ~_base_failed(f)))

    return docs.mapInArrow(common.lean(run), docs.schema)
