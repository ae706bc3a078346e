from types import SimpleNamespace

from mathloom.functions import plain
from mathloom.plans import evaluation, retrieval, texts


def test_searches_ask_the_whole_sample(spark, tmp_path, monkeypatch):
    """search_samples asks every 50th row, sampled_eval 200 items; the searches themselves are left out."""
    rows = [(i, f"k{i // 2}", f"Find {i} of the apples.", f"find {i} of the apples", "ape") for i in range(1, 3001)]
    items = spark.createDataFrame(rows, "pos long, id string, original_text string, normalized_text string, source string")
    items.write.parquet(str(tmp_path / "items.parquet"))
    monkeypatch.setattr(retrieval, "_index", lambda s, d: SimpleNamespace(items=items))
    monkeypatch.setattr(retrieval.S, "search", lambda index, queries, *a: queries)
    assert sorted(r.qid for r in retrieval.search_samples(spark, str(tmp_path)).select("qid").collect()) == list(range(50, 3001, 50))
    none = "'' AS id", "1 AS place", "'original' AS relation"
    monkeypatch.setattr(retrieval.E, "search", lambda index, queries, *a: queries.limit(0).selectExpr("qid", *none))
    got = retrieval.sampled_eval(spark, str(tmp_path)).first()
    assert (got.samples, got.variant_samples) == (200, 200)


def test_task_sample_takes_the_whole_quota(spark, tmp_path):
    """Sources with more rows than their quota give the quota, others all rows."""
    have = {"ape": 1400, "cm17k": 4600, "geometry3k": 50, "math": 3321, "other": 9}
    rows = [(f"{s}-{i}", f" {s.upper()}", "algebra") for s, n in have.items() for i in range(n)]
    spark.createDataFrame([*rows, rows[0]], "id string, source string, kind string").write.parquet(str(tmp_path / "task_manifest.parquet"))
    got = evaluation.task_sample(spark, str(tmp_path)).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in got} == {"ape": 1328, "cm17k": 4554, "geometry3k": 50, "math": 3321}


def test_strip_items_takes_every_text(spark, tmp_path):
    found = [(1, r"Find $\frac{1}{2}$ of \sqrt{4}."), (2, "a b"), (3, None), (4, r"\angle A = 3")]
    spark.createDataFrame(found, "pos long, original_text string").write.parquet(str(tmp_path / "items.parquet"))
    got = {r.pos: r.normalized for r in texts.strip_items(spark, str(tmp_path)).collect()}
    assert got == {p: plain.normalize(t) for p, t in found if t is not None}
