"""Joins with hot keys: nothing is lost or doubled however a key is split."""

import pytest
from pyspark.sql import functions as F

from mathloom.llm import near, skew, spans
from mathloom.llm.components import connected_components


@pytest.fixture
def split(monkeypatch):
    """Every key with at least four rows is hot and cut into blocks of about four."""
    monkeypatch.setattr(skew, "BLOCK", 4)
    monkeypatch.setattr(skew, "SAMPLED", 1)


def keyed(spark):
    """One key holds a third of all rows, another a tenth; a null key and repeated rows of one id."""
    rows = [(i, 7 if i % 3 == 0 else 8 if i % 10 == 1 else i // 4, i % 2 == 0) for i in range(300)]
    rows += [(1000, None, True), (1001, None, True), (3, 7, False), (3, 7, True)]
    return rows, spark.createDataFrame(rows, "id long, k long, even boolean")


@pytest.mark.parametrize("hot", [True, False])
@pytest.mark.parametrize("sided", [True, False])
def test_pairs_within_equals_brute_force(spark, request, hot, sided):
    if hot:
        request.getfixturevalue("split")
    rows, df = keyed(spark)
    got = skew.pairs_within(df, ["k"], "id", len(rows), (F.col("x.id") + F.col("y.id")) % 5 != 0, ["id", "k"], (F.col("even"), ~F.col("even")) if sided else None)
    want = []
    for i, k, e in rows:
        for j, m, f in rows:
            if k is not None and k == m and i != j and (i + j) % 5 and ((e and not f) if sided else i < j):
                want.append((i, k, j, m))
    assert sorted((r.x_id, r.x_k, r.y_id, r.y_k) for r in got.collect()) == sorted(want)
    assert skew.pairs_within(df.limit(0), ["k"], "id", 0, None, ["id"]).count() == 0


def test_a_hot_key_is_cut(spark, split):
    """No task of the join gets more than a few blocks of the key that a third of all rows have."""
    rows, df = keyed(spark)
    plan = skew.pairs_within(df.where("k = 7").dropDuplicates(["id"]), ["k"], "id", 100, None, ["id"])._jdf.queryExecution().toString()
    assert "_i" in plan and "_j" in plan
    blocks = df.where("k = 7").select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(25)).alias("b")).groupBy("b").count()
    assert blocks.agg(F.max("count")).first()[0] < 20


@pytest.fixture(scope="module")
def texts(spark):
    """A tenth of all rows share a beginning and differ after it; as many are close to each other."""
    base = "a train leaves the station of the old town at noon and meets the other one after so many hours of travel over the plain and through the hills beyond it"
    rows = [(i, base + f" number {i} of the long list {i * i}" if i % 10 == 0 else f"question {i} " + " ".join(str(i * j % 9973) for j in range(30))) for i in range(400)]
    return spark.createDataFrame([(i, t, None, "train" if i % 20 else "test", "math") for i, t in rows], "pos long, original_text string, structure_text string, split string, source string").cache()


def test_problems_with_a_hot_group(spark, request, texts):
    plain = {tuple(r) for r in near.found_groups(texts).collect()}, {tuple(r) for r in near.found_overlaps(texts).collect()}
    docs = texts.select(F.col("pos").alias("doc_id"), F.concat("original_text", F.lit(" "), "original_text").alias("text"))
    shared = {tuple(r) for r in spans.found_pairs(docs).collect()}
    request.getfixturevalue("split")
    assert {tuple(r) for r in near.found_groups(texts).collect()} == plain[0] and len(plain[0]) >= 39
    assert {tuple(r) for r in near.found_overlaps(texts).collect()} == plain[1] and len(plain[1]) >= 300
    assert {tuple(r) for r in spans.found_pairs(docs).collect()} == shared and len(shared) >= 780


@pytest.mark.parametrize("edges,want", [([], {}), ([(1, 2), (2, 3), (5, 4), (7, 7), (9, None)], {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}), ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)})])
def test_components(spark, edges, want):
    df = spark.createDataFrame(edges, "x long, y long")
    assert {r.node: r.component for r in connected_components(df, "x", "y").collect()} == want
