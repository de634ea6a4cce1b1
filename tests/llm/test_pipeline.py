"""The stages one after the other, each on all that its predecessor kept."""

import random
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from sylva.llm import neardup
from test_operators import brute_sets, passage, prose, union_find


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    shared, item = passage(1, 70), passage(2, 25)
    texts = [f"{prose(r, 80)}\n{prose(r, 30)}" for _ in range(30)]
    texts += [f"{prose(r, 70)}\n{shared}" for _ in range(4)]  # a passage in several documents
    texts += [texts[0], texts[0]]  # exact copies
    texts += [texts[1].replace(texts[1].split()[40], "other", 1)]  # a near copy
    texts += [f"{prose(r, 60)} {item} {prose(r, 20)}"]  # a leak
    texts += [" ".join(w + "###" for w in prose(r, 90).split()), "", None]  # junk
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, shared


def test_stages(spark, folder):
    path, texts, shared = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        kept[name] = {r["doc_id"]: r for r in out.collect()}
        docs = spark.createDataFrame(list(kept[name].values()), docs.schema)
    assert set(range(len(texts))) - set(kept["quality rules"]) == {38, 39, 40}
    lines = kept["line dedup"]
    assert [k for k, r in lines.items() if shared in r["text"]] == [30]
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values())
    assert 34 not in lines and 35 not in lines  # nothing of the copies was left
    assert set(range(30)) <= set(kept["near dedup"])
    assert set(kept["near dedup"]) - set(kept["decontamination"]) == {37}


def test_run(spark, folder):
    path, texts, _ = folder
    got = corpus_pipeline.run(spark, path).collect()
    assert set(range(30)) <= {r["doc_id"] for r in got} and 37 not in {r["doc_id"] for r in got}
    for s in {r["sequence_id"] for r in got}:
        assert sum(r["length"] for r in got if r["sequence_id"] == s) <= 2048
    assert all(0 <= r["ids_crc32"] <= zlib.crc32(b"") + 2**32 for r in got)


def test_near_copy_goes(spark, folder):
    """Text 36 has one word of text 1 replaced."""
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id in (1, 2, 36)")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, path).collect()} == {1, 2}


def test_near_dedup_by_simhash(spark):
    """Groups are those of all pairs of 2 differing bits or a similarity of 0.8, by brute force; some pairs are linked by SimHash alone and some by their sets alone."""
    r = random.Random(14)
    texts, w = [None, "", " \n", "one", "one two"], prose(r, 90).split()
    for k in range(1500):  # two edits each: a similarity of about 0.65 to 0.8, and some within 2 bits
        own = w[:]
        for at in r.sample(range(8, 82), 1 + k % 2):
            own[at] = f"edit{k}"
        texts.append(" ".join(own))
    sets = [brute_sets(t) for t in texts]
    hashes = list(neardup.shingle_sets(pa.array(texts, pa.string()), 5))
    assert [len(x) for x in hashes] == [len(x) for x in sets]
    bits = [[2 * sum(int(h) >> b & 1 for h in own) > len(own) for b in range(64)] for own in hashes]
    fp = np.array([sum(1 << b for b, x in enumerate(own) if x) for own in bits], np.uint64)
    # pairs of 2 bits at most that are less alike than 0.8
    near = [(i, j) for i in range(5, len(texts)) for j in (5 + np.flatnonzero(np.bitwise_count(fp[5:i] ^ fp[i]) <= 2)).tolist() if 5 * len(sets[i] & sets[j]) < 4 * len(sets[i] | sets[j])]
    assert near
    some = sorted({*range(5), *near[0], *near[-1], *range(5, 45)})
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    by_sets = [(i, j) for i in some for j in some if j < i and alike(sets[i], sets[j])]
    by_bits = [(i, j) for i in some for j in some if j < i and int(fp[i] ^ fp[j]).bit_count() <= 2]
    want = set(union_find(some, by_sets + by_bits).values())
    assert want != set(union_find(some, by_sets).values()) and want != set(union_find(some, by_bits).values())
    docs = spark.createDataFrame([(k, texts[k]) for k in some], "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert {g["doc_id"] for g in got} == want and len(got) == len(want)
    for i, j in (near[0], near[-1]):
        pair = docs.where(f"doc_id in ({i}, {j})")
        assert [g["doc_id"] for g in corpus_pipeline.near_dedup(spark, pair, "").collect()] == [min(i, j)]
