import struct
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mathloom import storage
from mathloom.config import SearchConfig
from mathloom.functions import figure, formula, grams, plain
from mathloom.functions import text as T
from mathloom.operators import evaluate as E
from mathloom.operators import index as I
from mathloom.operators import nearest as N
from mathloom.operators import search as S

GALLERY = {
    "circle-a": "一个圆的半径是4米，如果半径增加1米，那么这个圆的面积增加多少平方米？",
    "circle-b": "一个圆的半径是6米，如果半径增加2米，那么这个圆的面积增加多少平方米？",
    "donate": "五年级同学捐书120本，六年级比五年级多捐20%，六年级捐书多少本？",
    "age": "爸爸今年36岁，小明今年8岁，几年后爸爸的年龄是小明的3倍？",
    "speed": "一辆汽车3小时行驶180千米，照这样计算，5小时行驶多少千米？",
    "school": "学校买来15个足球，每个45元，一共要付多少元？",
}
VARIANT = "学校买来28个足球，每个63元，一共要付多少元？"


@pytest.fixture(scope="module")
def index(spark):
    rows = [(i, k, t) for i, (k, t) in enumerate(GALLERY.items())]
    items = spark.createDataFrame(rows, "pos long, id string, original_text string").withColumn("normalized_text", T.normalize(F.col("original_text")))
    items = items.withColumn("structure_text", T.structure(F.col("normalized_text"))).cache()
    return I.Index.build(items)


def answers(spark, index, texts, **kw):
    q = S.prepare_queries(spark.createDataFrame(list(texts.items()), "qid string, text string"))
    out: dict = {k: [] for k in texts}
    for r in S.search(index, q, **kw).orderBy("qid", "place").collect():
        out[r.qid].append((r.id, r.relation))
    return out


@pytest.mark.parametrize("use_formula", [True, False])
def test_originals_first_then_variants(spark, index, use_formula):
    got = answers(spark, index, {"a": GALLERY["circle-a"], "b": GALLERY["circle-b"], "v": VARIANT, "e": " "}, use_formula=use_formula)
    assert got["a"] == [("circle-a", "original"), ("circle-b", "variant")]
    assert got["b"] == [("circle-b", "original"), ("circle-a", "variant")]
    assert got["v"] == [("school", "variant")] and got["e"] == []


def test_recall_equals_brute_force(spark, index):
    """TF-IDF scores of all pairs, by dictionaries."""
    from collections import Counter
    from math import log, sqrt

    texts = {k: plain.structure(plain.normalize(t)).lower() for k, t in GALLERY.items()}
    grams = {k: Counter(t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)) for k, t in texts.items()}
    df = Counter(g for c in grams.values() for g in c)
    vec = {k: {g: n * (log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in c.items()} for k, c in grams.items()}
    for v in vec.values():
        n = sqrt(sum(x * x for x in v.values()))
        for g in v:
            v[g] /= n
    q = S.prepare_queries(spark.createDataFrame([(k, t) for k, t in GALLERY.items()], "qid string, text string"))
    names = list(GALLERY)
    got = {(r.qid, names[r.pos]): r.retrieval for r in I.recall(index, q).collect()}
    for a in names:
        for b in names:
            want = sum(w * vec[b].get(g, 0) for g, w in vec[a].items())
            assert got.get((a, b), 0.0) == pytest.approx(want, abs=1e-9)


def test_save_and_load(spark, index, tmp_path):
    index.save(str(tmp_path / "x"))
    again = I.Index.load(spark, str(tmp_path / "x"))
    assert answers(spark, again, {"a": GALLERY["circle-a"]}) == {"a": [("circle-a", "original"), ("circle-b", "variant")]}


def test_figures_decide(spark):
    v, w = [1.0] + [0.0] * 255, [0.0] * 255 + [1.0]
    rows = [(0, "x", "Find x.", v), (1, "y", "Find x.", w), (2, "z", "Find x.", None)]
    items = spark.createDataFrame(rows, "pos long, id string, original_text string, diagram_vector array<double>").withColumn("normalized_text", T.normalize(F.col("original_text")))
    items = items.withColumn("structure_text", T.structure(F.col("normalized_text"))).withColumn("phash", F.lit(None).cast("string"))
    q = S.prepare_queries(spark.createDataFrame([("q", "Find x.", v)], "qid string, text string, diagram_vector array<double>"))
    c = {r.id: r.relation for r in S.candidates(I.Index.build(items), q).collect()}
    assert c == {"x": "original", "y": "unrelated", "z": "original"}


def test_vector_and_hash_distances(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 1.0], "ffff0000ffff0000", "FFFF0000FFFF0001"), ([0.0, 0.0], [1.0, 1.0], "x", "0" * 16), (None, [1.0], None, None), ([1.0], [1.0, 2.0], "", "")],
        "a array<double>, b array<double>, h string, k string",
    )
    out = df.select(F.round(I.cosine(F.col("a"), F.col("b")), 6), I.hamming(F.col("h"), F.col("k"))).collect()
    assert [tuple(r) for r in out] == [(0.707107, 1), (0.0, None), (None, None), (None, None)]


def test_scores_and_summaries(spark):
    tasks = spark.createDataFrame([(1, "g"), (2, "g")], "qid int, gold string")
    shown = spark.createDataFrame([(1, 1, "g", "original"), (1, 2, "o", "original")], "qid int, place int, id string, relation string")
    got = {r.qid: r for r in E.score(shown, tasks).collect()}
    assert (got[1].hit, got[1].first, got[1].gold_original, got[1].extra_originals, got[1].empty, got[1].returned) == (True, True, True, 1, False, 2)
    assert (got[2].hit, got[2].empty, got[2].returned) == (False, True, 0)
    log = spark.createDataFrame([(1, "a", "ape", True, True, True, False, 0, 1, 0.5), (2, "b", None, False, False, False, True, 2, 0, None)], "row_id int, id string, source string, hit boolean, first boolean, gold_original boolean, empty boolean, extra_originals int, returned int, elapsed_s double")
    s = E.summary(log).first()
    assert (s.samples, s.hit, s.hit_rate, s.avg_elapsed_s) == (2, 1, 0.5, 0.25)
    assert E.summary(log.limit(0)).first().hit_rate == 0.0
    by = {r.value: r.samples for r in E.summary_by(log, ["source"]).collect()}
    assert by == {"ape": 1, "unknown": 1}
    assert E.combined(E.summary_by(log, ["source"])).first().hit_rate == 0.5
    assert {(r.sample, r.n, r.id) for r in E.failures(log).collect()} == {("miss", 1, "b"), ("extra_original", 1, "b")}


def test_run_eval_finds_all(spark, index):
    r = E.run_eval(index, limit=3).first()
    assert r.samples == 3 and r.hit_rate == 1.0 and r.first_rate == 1.0 and r.max_returned <= SearchConfig().max_results


def test_figures():
    page = np.full((200, 300, 3), 255, np.uint8)
    page[60:120, 100:180] = 0
    page[70:110, 110:170] = 255
    a, b = figure.ink_vector(page), figure.ink_vector(page[40:150, 80:220])
    assert len(a) == 256 and abs(np.linalg.norm(a) - 1) < 1e-9 and np.dot(a, b) > 0.99
    assert len(figure.perceptual_hash(page)) == 16
    (x0, y0, x1, y1), *_ = figure.figure_crops(page)
    assert x0 < 100 and x1 > 180 and y0 < 60 and y1 > 120
    assert figure.figure_crops(np.full((100, 100), 255, np.uint8)) == []
    assert figure.merged_boxes([(0, 0, 5, 5), (8, 0, 12, 5), (100, 100, 110, 110)], 4) == [(0, 0, 12, 5), (100, 100, 110, 110)]
    assert len(figure.component_boxes(np.eye(5, dtype=bool))) == 1
    assert figure.mean_vector([]) is None and figure.fitted(page, 100).shape == (67, 100, 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=12), st.sampled_from(["", "a", "aaaa", "a\x00", "苔岚苔岚"])), max_size=6))
def test_grams_equal_a_dictionary(texts):
    got: dict = {}
    for owner, g, count, names in grams.counted(texts):
        for o, i, c in zip(owner.tolist(), g.tolist(), count.tolist()):
            assert (o, names[i]) not in got
            got[o, names[i]] = c
    want = Counter((o, t[i : i + n]) for o, t in enumerate(texts) if t for n in grams.SIZES for i in range(len(t) - n + 1))
    assert got == dict(want)


def test_grams_of_a_huge_alphabet():
    text = "".join(map(chr, range(0x20000, 0x30100)))
    (_, _, count, names), = grams.counted([text])
    assert count.sum() == 3 * len(text) - 6 and names[1] == text[1:3]


@pytest.mark.parametrize("text", ["[5x - 1] = [3x + 2]", "在[2, 6]内", r"\[x+1\]", "a–b − c", "[x\n1]", "[[x1]]", "[" + "x1" * 25 + "]", None, ""])
def test_repair_of_queries_equals_the_plain_rule(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(formula.repaired_text(F.col("t"))).first()[0]
    assert got == (None if text is None else formula.repaired(text))


def test_recall_by_figure_alone_and_all_items(spark):
    v, w = [1.0] + [0.0] * 255, [0.0] * 255 + [1.0]
    nan = [float("nan")] * 256
    rows = [(0, "abcd", None), (1, "wxyz", v), (2, "mnop", w), (3, "qrst", nan), (4, "", v), (5, "uvwx", [1.0, 2.0])]
    items = spark.createDataFrame(rows, "pos long, structure_text string, diagram_vector array<double>").withColumn("normalized_text", F.lit("x"))
    index = I.Index.build(items)
    q = spark.createDataFrame([("f", "1", v), ("t", "abcd", None), ("n", None, None)], "qid string, structure_text string, diagram_vector array<double>")
    got: dict = {}
    for r in I.recall(index, q).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.pos, round(r.retrieval, 4)))
    w2 = SearchConfig().visual_blend ** 2
    assert got["f"] == [(4, 1.0), (1, round(w2 / (w2 * (1 + w2)) ** 0.5, 4)), (0, 0.0), (2, 0.0), (3, 0.0), (5, 0.0)]
    assert got["t"] == [(0, 1.0)] + [(p, 0.0) for p in range(1, 6)] and got["n"] == [(p, 0.0) for p in range(6)]
    assert [r.pos for r in I.recall(index, q.where("qid = 'f'"), 2).orderBy("rank").collect()] == [4, 1]
    assert I.recall(index, q.limit(0)).count() == 0
    assert I.recall(I.Index.build(items.limit(0)), q).count() == 0


def test_recall_across_blocks_equals_one_block(spark, monkeypatch):
    rows = [(i, f"train {i % 13} runs {i % 7} hours for {i % 5}", [float(i % 3), 1.0, 0.0]) for i in range(400)]
    items = spark.createDataFrame(rows, "pos long, structure_text string, diagram_vector array<double>").withColumn("normalized_text", F.lit("x"))
    q = items.where("pos % 50 = 0").select(F.col("pos").alias("qid"), "structure_text", "diagram_vector")
    one = {(r.qid, r.rank): r.pos for r in I.recall(I.Index.build(items), q, 30).collect()}
    monkeypatch.setattr(I, "BLOCK_POSTINGS", 500)
    assert {(r.qid, r.rank): r.pos for r in I.recall(I.Index.build(items), q, 30).collect()} == one
    monkeypatch.setattr(I, "BLOCK_ITEMS", 37)
    monkeypatch.setattr(I, "TILE_QUERIES", 3)
    assert {(r.qid, r.rank): r.pos for r in I.recall(I.Index.build(items), q, 30).collect()} == one and len(one) == 8 * 30


def test_pruned_pairs_change_no_result(spark, index):
    q = S.prepare_queries(spark.createDataFrame([(k, t) for k, t in {**GALLERY, "v": VARIANT}.items()], "qid string, text string"))
    for use_formula in (True, False):
        whole, cut = (S.candidates(index, q, use_formula, a).where("is_original or is_variant").select("qid", "id", "relation", "surface", "stem") for a in (True, False))
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))


def test_responses_and_lookups(spark, index):
    q = S.prepare_queries(spark.createDataFrame([("a", GALLERY["circle-a"]), ("z", "zzzz")], "qid string, text string"))
    got = {r.qid: r for r in S.responses(index, q).collect()}
    assert (got["a"].recalled, got["a"].originals, got["a"].reranked, [r.id for r in got["a"].results]) == (6, 1, 2, ["circle-a", "circle-b"])
    assert (got["z"].recalled, got["z"].originals, got["z"].reranked, got["z"].results) == (6, 0, 0, [])
    assert index.get("age").first().pos == 3 and index.get("none").count() == 0
    items = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "id string, pos long, source string")
    ids = spark.createDataFrame([("a",), ("a",), ("q",), (None,)], "id string")
    assert [tuple(r) for r in I.lookup(items, ids).collect()] == [("a", 2, "y")]


class Lengths:
    def encode(self, texts):
        return np.array([[len(t), 1.0] for t in texts])


def test_dense_encoder(spark, tmp_path):
    items = spark.createDataFrame([(0, "a"), (1, "b" * 9), (2, "")], "pos long, structure_text string").withColumn("normalized_text", F.lit("x")).withColumn("original_text", F.col("structure_text"))
    index = I.Index.build(items, encoder=Lengths)
    index.save(str(tmp_path / "i"))
    again = I.Index.load(spark, str(tmp_path / "i"), encoder=Lengths)
    q = spark.createDataFrame([(7, "c" * 8)], "qid long, structure_text string")
    assert [r.pos for r in I.recall(again, q).orderBy("rank").collect()] == [1, 0, 2]
    with pytest.raises(ValueError):
        I.Index.load(spark, str(tmp_path / "i"))


def png(pixels):
    """A gray PNG file of an array."""
    h, w = pixels.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


class Reading:
    def read(self, image):
        return "```\n题目：" + GALLERY["age"] + "\n解答\nno```" if image[5, 5] < 128 else ""


def test_search_by_image(spark, index, tmp_path):
    page = np.full((60, 80), 255)
    (tmp_path / "empty.png").write_bytes(png(page))
    page[4:7, 4:7] = 0
    (tmp_path / "age.png").write_bytes(png(page))
    images = spark.read.format("image").load(str(tmp_path))
    got = S.search_images(index, images, Reading).collect()
    assert [(r.qid.rsplit("/", 1)[1], r.id, r.relation) for r in got] == [("age.png", "age", "original")]
    (tmp_path / "manifest.txt").write_text("# name and id\nage.png\tage\nempty.png\tspeed\nmissing.png\tage\n")
    log = {r.gold: (r.hit, r.empty) for r in E.run_image_eval(index, spark, str(tmp_path), Reading).collect()}
    assert log == {"age": (True, False), "speed": (False, True)}


def test_folder_of_intermediate_tables(spark):
    far = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="yarn", getConf=lambda: {}))
    with pytest.raises(ValueError):
        storage.shared_dir(far)
    with storage.temporary_tables(spark):
        path = storage.materialize(spark.range(3), "t")._mathloom_path
        assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_bounds_leave_out_pairs_and_change_no_result(monkeypatch):
    """Items of 20 templates with 15 names each: few pairs are scored, and the best are those of all scores."""
    rng, k, w2, n = np.random.default_rng(3), 10, 0.1225, 3000
    texts = [np.unique(np.concatenate([np.arange(30) + 30 * rng.integers(20), 600 + rng.integers(0, 3000, 15)])) for _ in range(n)]
    texts[7], texts[8] = texts[9], np.zeros(0, np.int64)
    idf, df = np.where(np.arange(3600) < 600, 2.0, 6.0), np.bincount(np.concatenate(texts), minlength=3600)
    lists = lambda rows, kind: pa.array([texts[i].astype(kind) if kind == np.int32 else np.ones(len(texts[i])) for i in rows], pa.list_(pa.from_numpy_dtype(kind)))
    figure = [rng.random(4).astype(np.float32) if i % 9 == 0 else None for i in range(n)]
    norm = np.array([max(1e-8, float(np.sqrt((idf[t] ** 2).sum()))) for t in texts])
    table = lambda rows: pa.table({"pos": pa.array(rows), "gids": lists(rows, np.int32), "ws": lists(rows, np.float64), "norm": norm[rows], "v": pa.array([figure[i] for i in rows], pa.list_(pa.float32()))})
    asked, scored = table(np.arange(0, n, 8)), [0]
    take, brute = N.Nearest._take, I.best_of_block
    monkeypatch.setattr(N.Nearest, "_take", lambda self, x, pos, lo, at, *a, **kw: (scored.append(len(at)), take(self, x, pos, lo, at, *a, **kw)))
    monkeypatch.setattr(I, "best_of_block", lambda items, queries, *a: (scored.append(items.num_rows * queries.num_rows), brute(items, queries, *a))[1])
    monkeypatch.setattr(N, "HEAD", 600)
    monkeypatch.setattr(N, "GROUPS", 40)
    found = N.Nearest(asked, k, w2, idf, N.head_groups([(t, np.ones(len(t))) for t in texts[:500]], df, n), np.full(asked.num_rows, -np.inf))
    for lo in range(0, n, 1000):
        found.add(table(np.arange(lo, lo + 1000)))
    q, pos, score = found.found()
    want = [(int(j[0]), b, s) for j, b, s in brute(table(np.arange(n)), asked, k, w2, idf)]
    assert pos.reshape(-1, k).tolist() == [b.tolist() for _, b, _ in want] and len(q) == k * asked.num_rows
    assert np.allclose(score.reshape(-1, k), [s for _, _, s in want], atol=1e-12)
    assert sum(scored) < 0.2 * n * asked.num_rows


def test_recall_by_bounds_equals_recall(spark, monkeypatch):
    rows = [(i, f"train {i % 13} runs {i % 7} hours for {i % 5}" if i % 11 else "", [float(i % 3), 1.0, 0.0] if i % 4 else None) for i in range(500)]
    items = spark.createDataFrame(rows, "pos long, structure_text string, diagram_vector array<double>").withColumn("normalized_text", F.lit("x"))
    q = items.where("pos % 50 = 0").select(F.col("pos").alias("qid"), "structure_text", "diagram_vector")
    index = I.Index.build(items)
    one = {(r.qid, r.rank): (r.pos, round(r.retrieval, 9)) for r in I.recall(index, q, 30).collect()}
    monkeypatch.setattr(I, "MANY_PAIRS", 0)
    monkeypatch.setattr(I, "TILE_QUERIES", 4)
    assert {(r.qid, r.rank): (r.pos, round(r.retrieval, 9)) for r in I.recall(index, q, 30).collect()} == one and len(one) == 10 * 30
    assert I.recall(index, q.limit(0)).count() == 0 and I.recall(I.Index.build(items.limit(0)), q).count() == 0
