"""Axis joins against axes on trees, with small buckets, deep and wide documents; order of node sets; regular expressions without Python."""

import random

import pytest
from pyspark.sql import functions as F

from sylva import model
from sylva.functions import regex
from sylva.operators import axes
from sylva.plans import xpath, xpath_plan
from sylva.sources.documents import shred, state_of, store


def grown(rng, n):
    top = model.elem("r")
    made = [top]
    for k in range(n):
        up = made[-1] if rng.random() < 0.4 else rng.choice(made)
        made.append(model.elem(rng.choice("ab"), {"k": str(k)}))
        up.children.append(made[-1])
    return model.link(model.root(top))


@pytest.fixture(scope="module")
def trees():
    rng = random.Random(2)
    return {k: grown(rng, n) for k, n in enumerate((1, 30, 80))}


@pytest.fixture(scope="module")
def nodes(spark, trees):
    return spark.createDataFrame([r for k, t in trees.items() for r in model.rows(k, t)], model.NODE).cache()


@pytest.mark.parametrize("name", axes.NAMES[:-1])
def test_axis(nodes, trees, monkeypatch, name):
    monkeypatch.setattr(axes, "BUCKET", 7)
    got = axes.axis(nodes.where("name = 'a'"), nodes, name, F.col("kind") == "element")
    want = set()
    for k, t in trees.items():
        for c in t.walk():
            if c.name == "a":
                found = [n for n in xpath.axis_nodes(c, name) if n.kind == "element"]
                want |= {(k, c.at, n.at, p, len(found)) for p, n in enumerate(found, 1)}
    assert {(r["doc_id"], r["c_node_id"], r["node_id"], r["axis_pos"], r["axis_last"]) for r in got.collect()} == want


@pytest.mark.parametrize("path", ["//a//b", "//a/ancestor::b", "/r/*/b[2]", "//b[a]/following-sibling::*", "//a[.//b][1]/@k", "//a/../b"])
def test_planned_path(nodes, trees, monkeypatch, path):
    monkeypatch.setattr(axes, "BUCKET", 5)
    got = xpath_plan.compile(nodes, path).select("doc_id", F.coalesce(F.try_element_at("attrs", F.lit("k")), F.col("value")).alias("k")).collect()
    want = sorted((k, n.attrs.get("k", n.value)) for k, t in trees.items() for n in xpath.select(t, path))
    assert sorted(map(tuple, got)) == want


def test_order_of_node_sets(spark):
    docs = shred(spark.createDataFrame([(1, "<r><x><a>10</a><b>9</b></x></r>")], "doc_id long, text string"))
    assert xpath_plan.compile(docs, "//x[a < b]").count() == 1  # strings
    assert xpath_plan.compile(docs, "//x[a < b]", strict=True).count() == 0


def test_many_attributes_have_their_own_ids(spark):
    text = "<r>" + "".join("<e " + " ".join(f'a{k}="{k}"' for k in range(1200)) + "/>" for _ in range(3)) + "</r>"
    docs = shred(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    found = axes.attributes(docs)
    assert found.select("node_id").distinct().count() == found.count() == 3600


def test_stored_once_for_a_key(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    docs = shred(spark.createDataFrame([(1, "<r/>")], "doc_id long, text string"))
    key = ("test", *state_of(spark, str(tmp_path / "t")))
    assert store(docs, key).inputFiles() == store(docs, key).inputFiles()
    spark.range(4).write.mode("append").parquet(str(tmp_path / "t"))
    assert store(docs, ("test", *state_of(spark, str(tmp_path / "t")))).inputFiles() != store(docs, key).inputFiles()


def test_plain_patterns_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("ab12",), ("x",)], "s string")
    for pattern in ("[a-z]+[0-9]{2}", "(a|x).*"):
        plan = df.select(regex.match_col(F.col("s"), pattern))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
